"""Reading the tables, held-out folds, written intermediate tables and bounded Arrow batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.session import scratch_path

BATCH_BYTES = 16 << 20
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: a lost executor never costs more than the step that reads it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: all that was made from them is written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get Arrow batches of at most ``BATCH_BYTES``, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _width(df: DataFrame) -> Column:
    """Bytes of a row: what strings and binaries hold, and a fixed share for every column."""
    wide = [F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) for n, t in df.dtypes if t in ("string", "binary")]
    return reduce(lambda a, b: a + b, wide, F.lit(16 * len(df.columns))).cast("long")


def sized_broadcast(df: DataFrame, rows: int = 1_000_000, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (columns of plain types) with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes; beyond that Spark joins by shuffle."""
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(_width(df))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df
