"""voxeval: voxel-table and prediction-table analytics as PySpark DataFrame operators."""
