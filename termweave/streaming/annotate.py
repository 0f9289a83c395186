"""Annotation of streams: the batch plan on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.recognizer import Recognizer


def annotate_stream(stream: DataFrame, recognizer: Recognizer, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each micro-batch's annotations to ``sink``.

    Recognition keeps no state between documents. A micro-batch may be handed
    over again after a failure, with the same number, so ``sink`` should be
    idempotent by it, as ``parquet_sink`` is.
    """
    recognizer.initialize()
    return stream.writeStream.foreachBatch(lambda batch, number: sink(recognizer.annotate(batch), number))


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder, replacing an earlier attempt."""

    def write(annotations: DataFrame, number: int) -> None:
        annotations.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write
