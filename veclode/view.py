"""What read() returns: DataFrames that run nothing until used."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame


class View:
    """columns_list, tdata, vdata and all_entries of a selection."""

    def __init__(self, table, vectors: dict, columns: list[str], table_columns: list[str], chosen: bool):
        self.columns_list = columns
        self._table, self._vectors, self._table_columns, self._chosen = table, vectors, table_columns, chosen

    @cached_property
    def tdata(self) -> DataFrame | None:
        """The selected table columns in the requested order, None if there are none."""
        return self._table(self._table_columns) if self._table_columns else None

    @cached_property
    def _vector_frames(self) -> dict[str, DataFrame]:
        return {name: make() for name, make in self._vectors.items()}

    @property
    def vdata(self) -> DataFrame | dict[str, DataFrame] | None:
        """The selected vectors: one alone, several as a dict, None if there are none."""
        frames = self._vector_frames
        return None if not frames else next(iter(frames.values())) if len(frames) == 1 else frames

    @property
    def all_entries(self):
        """With a selection: the table part, the dict of vectors, or both. Without: both, None for a missing side."""
        table, vectors = self.tdata, self._vector_frames or None
        if self._chosen and (table is None or vectors is None):
            return vectors if table is None else table
        return None if table is None and vectors is None else (table, vectors)
