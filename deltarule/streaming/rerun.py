"""Runs a program again for each micro-batch of a stream.

Programs are batch programs; a stream's rows gather in a table and each trigger
evaluates the program over all rows so far. The table only grows by the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from deltarule.program import Program


def run_on_stream(program: Program, stream: DataFrame, relation: str, table: str, sink: Callable[[dict[str, DataFrame], int], None], checkpoint: str, inputs: dict[str, DataFrame] | None = None, **trigger: object):
    """Feeds ``relation`` from a streaming DataFrame; sink gets the results and the batch's number.

    table: a path in a shared folder. A batch is written to a folder of its own number, so a
    batch that is run again replaces itself. Returns the streaming query.
    """
    schema = stream.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        seen = spark.read.schema(schema).parquet(table).select(*schema.names)
        results = program.run(spark, {relation: seen, **(inputs or {})})
        sink(results, number)
        results.clear()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
