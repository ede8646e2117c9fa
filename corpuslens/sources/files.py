"""File sources and sinks: CSV, JSON, text and XML through Spark's readers and writers, and the folds that follow a scan."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpuslens-")
        spark.sparkContext.setCheckpointDir(root)
    at = f"{root.rstrip('/')}/corpuslens-files/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{at}/{name}"


def read_csv(spark: SparkSession, path, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header; a byte order mark is skipped, empty cells are null."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=True, encoding="UTF-8", escape='"')


def write_csv(df: DataFrame, path: str, columns: list, sep: str = ",") -> None:
    """CSV parts with a header, columns in the given order, LF line ends."""
    df.select(*columns).write.csv(path, sep=sep, header=True, lineSep="\n", escape='"', emptyValue="")


def write_json(df: DataFrame, path: str, sort_keys: bool = True) -> None:
    """One JSON document a line, keys in alphabetical order if sort_keys."""
    df.select(*(sorted(df.columns) if sort_keys else df.columns)).write.json(path)


def read_json(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def write_log(lines: DataFrame, path: str) -> None:
    """A text file of lines (i, line) in the order of i; logs are short, so one part."""
    lines.coalesce(1).sortWithinPartitions("i").select("line").write.text(path)


def scan_folder(spark: SparkSession, pattern: str, schema: str, needed: tuple, skip: str = "errata_") -> DataFrame:
    """All CSV files of a glob but those whose name begins with `skip`, with file_name; an empty needed cell fails the job."""
    df = read_csv(spark, pattern, schema).withColumn("file_name", F.element_at(F.split("_metadata.file_path", "/"), -1))
    df = df.where(~F.startswith("file_name", F.lit(skip)))
    checks = [F.assert_true(F.col(c).isNotNull(), F.concat(F.lit(f"{c} is empty in "), F.col("file_name"))) for c in needed]
    return df.where(reduce(lambda a, b: a & b, [x.isNull() for x in checks])) if checks else df


def fold_keyed(df: DataFrame, key: str, order: str, first: tuple = (), either: tuple = (), concat: tuple = (), sep: str = " ") -> DataFrame:
    """One row a key: the first non-empty of some columns, in order, the OR of others, and others joined."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    firsts = [F.min_by(filled(F.col(c)), F.when(filled(F.col(c)).isNotNull(), F.col(order))).alias(c) for c in first]
    ors = [F.coalesce(F.bool_or(F.col(c)), F.lit(False)).alias(c) for c in either]
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(filled(F.col(c)).isNotNull(), F.struct(F.col(order).alias("o"), filled(F.col(c)).alias("x"))))), lambda s: s["x"]), sep).alias(c) for c in concat]
    return df.groupBy(key).agg(*firsts, *ors, *joined)


def union_sources(parts: dict) -> DataFrame:
    """Rows of several sources, each with its own projection, with src; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("src", F.lit(name)) for name, df in parts.items()])


def xml_field(text: Column, tag: str) -> Column:
    """The text of the first element of a name, without inner markup."""
    inner = F.regexp_extract(text, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]+>", ""), r"\s+", " "))


def scan_xml(spark: SparkSession, pattern: str) -> DataFrame:
    """(file_path, text) of whole small files, folders below included."""
    return spark.read.text(pattern, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def template_fields(text: Column) -> Column:
    """The parameters of a wiki template as a map; a line without | at its start continues the one before."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\{\{[^\n|]*", ""), r"\}\}$", "")
    parts = F.filter(F.split(body, r"\n\s*\|"), lambda p: F.contains(p, F.lit("=")))
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(F.substr(p, F.locate("=", p) + 1), r"\s*\n\s*", " ")).alias("value"))
    # Of a parameter given twice the first stands.
    pairs = F.transform(parts, pair)
    first = F.filter(pairs, lambda s, i: F.array_position(F.transform(pairs, lambda y: y["key"]), s["key"]) == i + 1)
    return F.map_from_entries(first)


def table_cells(page: Column) -> Column:
    """array<array<string>>: the rows of a page's tables and their cells, markup dropped; header cells count as cells."""
    rows = F.regexp_extract_all(page, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1)), clean))
