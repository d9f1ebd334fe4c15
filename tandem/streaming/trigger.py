"""When a stream looks for new files."""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamWriter


def with_trigger(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """Take what is available and stop, or look again at the given interval."""
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
