"""Sources: text and HTML files, manifests, ratings, sample folders."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.operators.normalize import newlines, visible
from proselens.operators.study import RATINGS

ITEM = "blind_id string, target string, brief string, condition string, profile string, kind string, draft string, source string"
MANIFEST = f"run string, brief string, writers array<string>, conditions array<string>, anchor boolean, seed bigint, items array<struct<{', '.join(x.replace(' ', ':', 1) for x in ITEM.split(', ')).replace(',', ', ')}>>"


def text_files(spark: SparkSession, paths, as_html: bool = False, strict: bool = False) -> DataFrame:
    """path, text of whole files; each path once. Bytes that are no UTF-8 are replaced, or under strict make text null with an error beside it.

    .html and .htm files are reduced to visible text."""
    paths = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    if strict:
        good = F.expr("try_validate_utf8(cast(content as string))")
        return raw.select("path", newlines(good).alias("text"), F.when(good.isNull(), F.lit("not UTF-8")).alias("error"))
    text = newlines(F.make_valid_utf8(F.col("content").cast("string")))
    return raw.select("path", visible(text, F.col("path"), as_html).alias("text")).dropDuplicates(["path"])


def named_files(spark: SparkSession, paths, as_html: bool = False, strict: bool = False, repeats: bool = False) -> tuple[DataFrame, list[str]]:
    """(ord, path, text and under strict error, of the files in the order named, each path once unless repeats; notes on those that cannot be read).

    - is standard input, which is HTML only if as_html says so. Paths stay as they are named."""
    paths = list(paths) if repeats else list(dict.fromkeys(paths))
    names, failed, typed = [], [], []
    jvm = spark.sparkContext._jvm
    for k, p in enumerate(paths):
        if p == "-":
            raw = sys.stdin.buffer.read()
            typed.append((k, p, bytearray(raw)))
            continue
        try:
            at = jvm.org.apache.hadoop.fs.Path(p)
            status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
            if status.isDirectory():
                failed.append(f"{p}: is a directory")
            else:
                names.append((k, p, status.getPath().toString()))
        except Exception as e:  # noqa: BLE001  the file system's own error, whatever its class
            failed.append(f"{p}: {str(e).splitlines()[-1] if not hasattr(e, 'java_exception') else e.java_exception.getMessage()}")
    schema = "ord int, path string, content binary"
    raw = spark.createDataFrame(typed, schema)
    if names:
        named = spark.createDataFrame(names, "ord int, path string, at string")
        files = spark.read.format("binaryFile").load(sorted({n[2] for n in names})).select(F.col("path").alias("at"), "content")
        raw = raw.unionByName(named.join(files, "at").select("ord", "path", "content"))
    text = F.col("content").cast("string")
    if strict:
        good = F.expr("try_validate_utf8(cast(content as string))")
        return raw.select("ord", "path", newlines(good).alias("text"), F.when(good.isNull(), F.lit("not UTF-8")).alias("error")), failed
    return raw.select("ord", "path", visible(newlines(F.make_valid_utf8(text)), F.col("path"), as_html).alias("text")), failed


def manifest_keys(spark: SparkSession, path: str) -> dict:
    """run, brief, writers, conditions, anchor and seed of a manifest."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).drop("items").first().asDict()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Items of a run, with its name."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return m.select("run", F.explode("items").alias("i")).select("run", "i.*")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rating rows in file order (row_no)."""
    return spark.read.schema(RATINGS).csv(path, header=True).withColumn("row_no", F.monotonically_increasing_id())


def samples(spark: SparkSession, root: str, kind: str = "samples") -> DataFrame:
    """writer, path, text of the samples (or holdout pieces) below root/<writer>/<kind>/; names that begin with a dot are none."""
    raw = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/{kind}/*").select("path", "content")
    return raw.select(F.element_at(F.split("path", "/"), -3).alias("writer"), "path", newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def holdouts(spark: SparkSession, root: str) -> DataFrame:
    """writer, holdout: the first held-out piece of each writer by path."""
    return samples(spark, root, "holdout").groupBy("writer").agg(F.min("path").alias("holdout"))
