"""Readers and writers. Schemas are given, never inferred; columns and filters reach the scans they can reach."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.fixed_width import PARTITION_BYTES, read_lists, read_records, write_lists, write_records
from quern.storage import materialize


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, pruned to the columns named."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def to_pandas(df: DataFrame, columns: list[str], most_rows: int = 1 << 20) -> pd.DataFrame:
    """A whole small table on the driver, by Arrow; an error beyond most_rows."""
    held = df.select(*columns).limit(most_rows + 1).toPandas()
    if len(held) > most_rows:
        raise ValueError(f"over {most_rows} rows are no small table")
    return held


def write_rows(spark: SparkSession, rows: list[tuple], like: T.StructType, path: str) -> None:
    """Write rows of the driver as a table with another's schema."""
    spark.createDataFrame(rows, like).coalesce(1).write.mode("overwrite").parquet(path)


def read_ranges(spark: SparkSession, path: str, value: str, ranges: list[tuple[float, float]], columns: list[str]) -> DataFrame:
    """Rows whose value lies in one of the ranges, ends included. Overlapping ranges are merged first.

    On a table that write_parquet has sorted by the value, each merged range is a contiguous read: the filter reaches the
    scan, which skips all other row groups.
    """
    merged: list[list[float]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    inside = F.lit(False)
    for low, high in merged:
        inside = inside | F.col(value).between(low, high)
    return spark.read.parquet(path).where(inside).select(*columns)


def write_parquet(df: DataFrame, path: str, like: T.StructType | None = None, sort: list[str] | None = None) -> None:
    """Write a table, cast to a borrowed schema, in the order of `sort` within files so that ranges of it prune row groups."""
    if like is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.fields])
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    df.write.mode("overwrite").parquet(path)


def bounded_globs(root: str, name: str, depth: int = 4) -> list[str]:
    """Path patterns for files of a name at most `depth` folders below root; Spark's readers expand them, whatever the store."""
    return [f"{root.rstrip('/')}/{'*/' * k}{name}" for k in range(depth + 1)]


def find_files(spark: SparkSession, root: str, name: str, depth: int = 4) -> DataFrame:
    """path and length of the files that bounded_globs finds, contents unread; none found: an empty table."""
    out = None
    for pattern in bounded_globs(root, name, depth):
        try:
            df = spark.read.format("binaryFile").load(pattern).select("path", "length")
        except AnalysisException:  # no file at this depth
            continue
        out = df if out is None else out.unionAll(df)
    return spark.createDataFrame([], "path string, length long") if out is None else out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with number, their place from 0 over all files in the order of their paths.

    Lines are counted per file block. The offsets of a file's blocks are sums within the file, those of files are sums over
    one row for each file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    blocks = materialize(lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first")), "blocks")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).select("file", before(Window.orderBy("file")).alias("start"))
    within = blocks.select("file", "block", (before(Window.partitionBy("file").orderBy("block")) - F.col("first")).alias("shift"))
    offsets = within.join(files, "file").select("file", "block", (F.col("start") + F.col("shift")).alias("shift"))
    return lines.join(offsets, ["file", "block"]).select((F.col("place") + F.col("shift")).alias("number"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def read_named_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines "name<tab>rest" with their number as key; a line without a tab is a name with an empty rest."""
    parts = F.split("value", "\t", 2)
    return read_lines(spark, path).select("number", parts[0].alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("rest"))


def read_last_field(spark: SparkSession, path: str, types: tuple[str, str] = ("bigint", "double")) -> DataFrame:
    """Tab-separated lines of two fields or more as (id: the first, value: the last)."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 2)
    return rows.select(F.col("p")[0].cast(types[0]).alias("id"), F.rtrim(F.element_at("p", -1), F.lit("\r")).cast(types[1]).alias("value"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and quoted fields; columns are found by the schema's names."""
    wanted = T._parse_datatype_string(schema)
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields])


def write_ranked_csv(df: DataFrame, path: str, query: str, lists: list[str], sep: str = ";") -> None:
    """A CSV with one row per query and each list joined in a cell."""
    df.select(query, *[F.array_join(F.col(c).cast("array<string>"), sep).alias(c) for c in lists]).write.mode("overwrite").option("header", True).csv(path)


def read_ranked_csv(spark: SparkSession, path: str, query: str, items: str, sep: str = ";") -> DataFrame:
    """query, item, place (from 1) of a CSV with lists in cells."""
    rows = read_csv(spark, path, f"{query} string, {items} string")
    rows = rows.where(F.length(items) > 0)
    return rows.select(query, F.posexplode(F.split(items, sep)).alias("place", "item")).withColumn("place", (F.col("place") + 1).cast("long"))


def read_ion_records(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Records between BEGIN IONS and END IONS: the keys asked for (null where missing), and peaks as arrays of (x, y).

    Files are split at END IONS by the reader, so records stream through many tasks. Lines are KEY=value or two numbers.
    """
    raw = spark.read.option("lineSep", "END IONS").text(path).where(F.col("value").contains("BEGIN IONS"))
    lines = F.split(F.element_at(F.split("value", "BEGIN IONS"), -1), r"\r?\n")
    peak = F.filter(lines, lambda s: s.rlike(r"^\s*[-+0-9.eE]+\s+[-+0-9.eE]+"))
    parts = lambda s: F.split(F.trim(s), r"\s+")
    made = F.transform(peak, lambda s: F.struct(parts(s)[0].cast("double").alias("x"), parts(s)[1].cast("double").alias("y")))
    value = lambda k: F.try_element_at(F.transform(F.filter(lines, lambda s: s.startswith(f"{k}=")), lambda s: F.trim(F.substring(s, len(k) + 2, 1 << 30))), F.lit(1))
    return raw.select(*[value(k).alias(k.lower()) for k in keys], made.alias("peaks"))


def read_dumps(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text dumps of a header "Q name truth n" and n rows of numbers, as (query, truth, candidate, <columns>).

    Files are split at headers by the reader. truth -1 becomes null; a field "x" is a missing term and becomes null.
    """
    raw = spark.read.option("lineSep", "\nQ ").text(path).where(F.length("value") > 0)
    lines = F.split(F.regexp_replace("value", "^Q ", ""), "\n")
    head = F.split(F.trim(lines[0]), r"\s+")
    rows = raw.select(head[0].alias("query"), F.nullif(head[1].cast("long"), F.lit(-1).cast("long")).alias("truth"), F.posexplode(F.slice(lines, F.lit(2), head[2].cast("int"))).alias("candidate", "line"))
    field = lambda i: F.when(F.get(F.split(F.trim("line"), r"\s+"), F.lit(i)) != "x", F.get(F.split(F.trim("line"), r"\s+"), F.lit(i)).cast("double"))
    return rows.select("query", "truth", F.col("candidate").cast("long"), *[field(i).alias(c) for i, c in enumerate(columns)])


HEAD = np.dtype([("precursor", "<f4"), ("mol", "<i4"), ("off", "<i4"), ("n", "<i4"), ("tag", "<i4")])


def head_tag(category: Column, instrument: Column) -> Column:
    """category * 16 + instrument, -1 standing for unknown."""
    return F.coalesce(category.cast("int"), F.lit(-1)) * 16 + F.coalesce(instrument.cast("int"), F.lit(-1))


def tag_parts(tag: Column) -> tuple[Column, Column]:
    """(category, instrument) of a tag, null: unknown. An unknown instrument has taken one from the category."""
    odd = F.pmod(tag, F.lit(16)) == 15
    kind = F.floor(tag / F.lit(16)).cast("int") + F.when(odd, 1).otherwise(0)
    return F.when(kind >= 0, kind), F.when(~odd, F.pmod(tag, F.lit(16)))


def read_heads(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """20-byte headers of a file or folder, read by as many tasks as there are byte ranges: precursor, mol, off, n, category, instrument."""
    category, instrument = tag_parts(F.col("tag"))
    return read_records(spark, path, HEAD, partition_bytes=partition_bytes).select("precursor", "mol", "off", "n", category.alias("category"), instrument.alias("instrument"))


def write_heads(df: DataFrame, path: str) -> None:
    """Rows (precursor, mol, off, n, category, instrument) as headers, a file for each task."""
    write_records(df.withColumn("tag", head_tag(F.col("category"), F.col("instrument"))), path, HEAD)


def pack_heads(rows: list[tuple[float, int, int, int, int | None, int | None]]) -> bytes:
    """Headers as bytes, with tag = category * 16 + instrument, -1 standing for unknown, as the files hold them."""
    return b"".join(struct.pack("<fiiii", p, mol, off, n, (-1 if c is None else c) * 16 + (-1 if i is None else i)) for p, mol, off, n, c, i in rows)


BIT_PLACES = np.dtype([("row", "<i8"), ("at", "<i8"), ("n", "<i4")])


def write_bit_rows(df: DataFrame, folder: str) -> None:
    """Rows (row, values: places of the bits) as 16-bit numbers, with a sidecar that says where each row's stand."""
    write_lists(df, f"{folder}/places", BIT_PLACES, f"{folder}/bits", "<u2", "at", "n")


def read_bit_places(spark: SparkSession, folder: str) -> DataFrame:
    """What write_bit_rows wrote, by as many tasks as there are ranges of the sidecar."""
    return read_lists(spark, f"{folder}/places", BIT_PLACES, f"{folder}/bits", "<u2", "at", "n", columns=["row"])


def read_bit_rows(spark: SparkSession, path: str) -> DataFrame:
    """Sparse bit sets of binary files without places, so that a file is read whole by one task: a count and a width as 32-bit numbers, then per row a 16-bit count and 16-bit places."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                n, _ = struct.unpack_from("<II", data)
                rows, at = [], 8
                for _ in range(n):
                    k = struct.unpack_from("<H", data, at)[0]
                    rows.append(np.frombuffer(data, "<u2", k, at + 2).astype("int32").tolist())
                    at += 2 + 2 * k
                yield pd.DataFrame({"row": np.arange(n, dtype="int64"), "bits": rows})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "row long, bits array<int>")


def value_counts(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most common values with their counts; ties by the value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def folder_digest(spark: SparkSession, path: str) -> DataFrame:
    """files, digest: a SHA-256 over the relative paths, lengths and contents' own SHA-256 of a folder's files.

    A file's line goes to one of 256 parts by the SHA-256 of its path; the digest is over the parts' digests, so no task
    holds the lines of all files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", F.lit("/" + path.rstrip("/").split("/")[-1] + "/")), -1)
    each = files.select(name.alias("name"), F.concat_ws(":", F.length(name), name, F.col("length").cast("string"), F.sha2("content", 256)).alias("line"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    parts = each.groupBy(F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 2).alias("part")).agg(F.count("*").alias("n"), F.sha2(joined("line"), 256).alias("sha"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sha2(joined(F.concat_ws(":", "part", "sha")), 256).alias("digest"))
