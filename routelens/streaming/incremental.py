"""Incremental scoring: the resumable batch job, fed by a file stream.

Each micro-batch is appended like a batch run, so a replayed micro-batch only scores what its
first attempt did not finish.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from routelens.operators.scoring import append_results


def score_stream(spark: SparkSession, source: str, schema: StructType, cache: str, checkpoint: str, factory, verifier: str):
    """Score every new input file once and stop when the backlog is done."""
    stream = spark.readStream.schema(schema).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, epoch: append_results(df.sparkSession, df, cache, factory, verifier, int(epoch)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
