"""A stream's micro-batches as appends to a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..dataset import Dataset


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each micro-batch to the dataset at path; start it to run. The manifest holds
    the last batch of each checkpoint, so a batch that is delivered again after a failure changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Dataset(path, batch.sparkSession).append(batch, once=(checkpoint, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
