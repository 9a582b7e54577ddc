"""Registered queries with their SQL equivalents, one module per operator family."""

from importlib import import_module

MODULES = ("scalars", "joins", "rasters", "masks", "templates", "features", "folds", "metrics", "ensembles", "fits", "calibration", "gates", "preprocess")


def load() -> None:
    for m in MODULES:
        import_module(f"voxeval.suite.{m}")
