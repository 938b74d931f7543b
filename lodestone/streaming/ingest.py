"""Triples from a stream of nested rows, appended to a folder as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.build import without_noise
from lodestone.sources.flatten import flatten


def stream_triples(rows: DataFrame, def_type: str, name_col: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that flattens each batch into target/defs and target/field_values.

    A batch goes to a folder of its number and overwrites it, so a batch that is tried again
    after a failure is written once. Entities are numbered within their batch.
    """

    def publish(batch: DataFrame, number: int) -> None:
        defs, values = flatten(batch, def_type, name_col)
        defs.write.mode("overwrite").parquet(f"{target}/defs/batch={number}")
        without_noise(values).write.mode("overwrite").parquet(f"{target}/field_values/batch={number}")

    writer = rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
