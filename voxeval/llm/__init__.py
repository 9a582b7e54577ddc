"""Operators of a training-data pipeline, their registered queries and the SQL of those that SQL can express."""
