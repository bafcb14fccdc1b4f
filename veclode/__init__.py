"""Datasets of one table and many vectors on Spark: storage, positional access and exact vector search."""

from .dataset import Dataset
from .view import View

__all__ = ["Dataset", "View"]
