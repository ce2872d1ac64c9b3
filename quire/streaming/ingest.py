"""Ingestion of new books as they arrive: each micro-batch of files is converted whole, since a book's statistics need all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.plans.convert import Options, convert


def stream_books(spark: SparkSession, source: str, schema, to_lines: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, options: Options = Options(), fmt: str = "parquet") -> StreamingQuery:
    """Convert the files that lie in source and are not done yet; results and chapters are appended under out.

    A batch that runs again after a failure replaces its own folder, so that no book appears twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        made = convert(to_lines(df), options)
        made.results().write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        made.html(options.language).write.mode("overwrite").parquet(f"{out}/chapters/batch={number}")

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
