"""Readers and writers for the annotated inputs and the result tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.operators.ordered import join_keys
from routelens.session import scratch_path


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; unparsable lines land in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


ARCHIVE_TYPE = "map<string,struct<label:string,sents:map<string,struct<text:string>>>>"


def parse_archive(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Keyed documents: ordered sentences joined by a blank, and the document's label."""
    x = df.select(*keep, F.explode(F.from_json(column, ARCHIVE_TYPE)).alias("doc_key", "doc"))
    ordered = F.array_sort(F.transform(F.map_entries("doc.sents"), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"]["text"].alias("t"))))
    return x.select(*keep, "doc_key", F.col("doc.label").alias("label"), F.size(ordered).alias("n_sentences"), F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"))


def read_archives(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Documents of keyed JSON archives, one object per file over as many lines as it likes; a file is parsed by one task, its documents are then dealt out."""
    return parse_archive(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"), "json", keep).repartition("doc_key")


EDIT_SCHEMA = "id string, source array<struct<txt:string>>, summary array<struct<pre_edit:string,post_edit:string,evidence:array<int>>>"


def parse_edits(df: DataFrame, column: str) -> DataFrame:
    """One row per edited summary sentence, with a check of its evidence positions."""
    return edit_rows(df.select(F.from_json(column, EDIT_SCHEMA).alias("d")).select("d.*"))


def edit_rows(docs: DataFrame) -> DataFrame:
    x = docs.select("id", F.size("source").alias("n_source"), F.posexplode("summary").alias("position", "s"))
    inside = F.forall(F.coalesce("s.evidence", F.array().cast("array<int>")), lambda e: (e >= 0) & (e < F.col("n_source")))
    return x.select("id", "position", F.col("s.pre_edit").alias("pre"), F.col("s.post_edit").alias("post"), inside.alias("evidence_ok"))


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Edited summary sentences of nested JSON files, each a list of documents over any number of lines."""
    return edit_rows(spark.read.schema(EDIT_SCHEMA).option("multiLine", True).json(path).repartition("id"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


class BrokenContract(ValueError):
    """A table that was about to be put in its place breaks its rules."""


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), rules: Mapping[str, Column] | None = None, unique: Sequence[str] = (), schema: T.StructType | None = None
) -> None:
    """All-or-nothing write: the table is written beside its place and then swapped in by two renames.

    With partitions only the partitions that ``df`` holds are replaced, each by its own swap. A job that fails while it
    writes leaves the old table as it was, and so does a table that breaks its contract: ``schema`` (names and types, in order)
    is compared before anything runs; ``rules`` are conditions that hold for every row (null: broken), counted in the pass that
    writes; ``unique`` names key columns, which are read back from the staged table. A broken contract raises ``BrokenContract``.
    """
    spark = df.sparkSession
    if schema is not None and [(f.name, f.dataType) for f in df.schema.fields] != [(f.name, f.dataType) for f in schema.fields]:
        raise BrokenContract(f"schema {df.schema.simpleString()} is not {schema.simpleString()}")
    staged = f"{path.rstrip('/')}._staged-{uuid.uuid4().hex}"
    seen = Observation() if rules else None
    out = df if seen is None else df.observe(seen, *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    (out.write.partitionBy(*partition_by) if partition_by else out.write).parquet(staged)
    jvm = spark.sparkContext._jvm
    to_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    broken = {} if seen is None else {name: n for name, n in seen.get.items() if n}
    if unique:
        copies = spark.read.schema(df.schema).parquet(staged).groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1)).first()[0]
        broken |= {"duplicate_keys": copies} if copies else {}
    if broken:
        fs.delete(to_path(staged), True)
        raise BrokenContract(f"rows that break a rule: {broken}")

    def swap(new: str, place: str) -> None:
        old = f"{place}._old-{uuid.uuid4().hex}"
        had = fs.exists(to_path(place))
        if had and not fs.rename(to_path(place), to_path(old)):
            raise OSError(f"cannot move {place} aside")
        fs.mkdirs(to_path(place).getParent())
        if not fs.rename(to_path(new), to_path(place)):
            if had:
                fs.rename(to_path(old), to_path(place))
            raise OSError(f"cannot move {new} to {place}")
        if had:
            fs.delete(to_path(old), True)

    if not partition_by:
        swap(staged, path)
        return
    parts = [""]
    for _ in partition_by:
        parts = [f"{p}/{s.getPath().getName()}" for p in parts for s in fs.listStatus(to_path(staged + p)) if s.isDirectory()]
    for part in parts:
        swap(staged + part, path.rstrip("/") + part)
    fs.delete(to_path(staged), True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what is read several times is made once, survives lost executors, and plans stay short."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``settled`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def part_coverage(expected: DataFrame, done: DataFrame, keys: Sequence[str], row_key: str) -> DataFrame:
    """Rows expected and found of each configuration, and rows that occur more than once."""
    want = expected.groupBy(*keys).agg(F.count_distinct(row_key).alias("expected"))
    per_row = done.groupBy(*keys, row_key).agg(F.count("*").alias("n"))
    have = per_row.groupBy(*keys).agg(F.count("*").alias("found"), F.sum(F.col("n") - 1).alias("duplicates"))
    zero = F.lit(0).cast("bigint")
    return join_keys(want, have, keys, "left").select(*keys, "expected", F.coalesce("found", zero).alias("found"), F.coalesce("duplicates", zero).alias("duplicates"))


def unfinished(expected: DataFrame, done: DataFrame, keys: Sequence[str], row_key: str) -> DataFrame:
    """Configurations whose part lacks rows or holds some twice."""
    return part_coverage(expected, done, keys, row_key).filter("found <> expected or duplicates > 0").select(*keys)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path below ``path``, length and SHA-256 of every file (part files, well below 2 GB each)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.element_at(F.split("path", re.escape(path.split(":", 1)[-1].rstrip("/")) + "/", 2), -1)
    return f.select(below.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def folder_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(folder, hash over the hashes of its files) of every folder below ``path`` that holds data files; names of part files do not count."""
    files = file_inventory(spark, path).filter(~F.substring_index("file", "/", -1).rlike("^[._]"))
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    return files.groupBy(folder.alias("file")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256"))


class BadRows(ValueError):
    """A scan found rows that do not parse."""


def strict(df: DataFrame) -> DataFrame:
    """``df`` of ``read_jsonl`` without its error column, after making sure that every line parsed."""
    bad = df.filter("_corrupt_record is not null").count()
    if bad:
        raise BadRows(f"{bad} lines are not objects of the schema")
    return df.drop("_corrupt_record")


def verify_inventory(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Files missing, added or changed since the inventory was taken."""
    c = current.select("file", F.col("sha256").alias("now"))
    j = recorded.select("file", F.col("sha256").alias("was")).join(c, "file", "full_outer")
    return j.agg(F.count("*").alias("files"), F.count_if(F.col("now").isNull()).alias("missing"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now") != F.col("was")).alias("changed"))
