"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import materialize, shared_dir  # noqa: F401  operators take them from here

#: Bytes that an operator may broadcast. Beyond it each operator works in blocks or by a join.
BROADCAST_BYTES = 32 << 20

#: Rows that an operator works on at once. Spark bounds the Arrow batches that bring them by 64 MB.
BATCH_ROWS = 256

#: Bytes of such a batch, unless a single row has more.
BATCH_BYTES = 16 << 20

#: ASCII A-Z to a-z, everything else in the ASCII range that is no letter or digit to a blank. Bytes from 0x80 stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: ASCII A-Z to a-z only.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            steps = np.ones(size, np.uint64)
            steps[1:] = np.uint64(BASE)
            self.up = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(INVERSE)
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer used, which it does when their handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow in batches of at most `rows` rows and `most_bytes` bytes (or one row), as whole documents may be long; the session's settings stay as they are."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(part for b in batches for part in slices(b, rows, most_bytes))

    return df.mapInArrow(sliced, schema)


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and `most_bytes` bytes, or of one row, without copies; an empty one as it is."""
    for a in range(0, max(1, batch.num_rows), rows):
        part = batch.slice(a, rows)
        if part.num_rows > 1 and part.nbytes > most_bytes:
            yield from slices(part, (part.num_rows + 1) // 2, most_bytes)
        else:
            yield part


def rehashed(df: DataFrame, other: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) on a long or string column through another hash of it, so that both sides are shuffled for the join.

    A side that was just grouped by the column would be joined where it lies, and Spark can't split a common value then.
    """
    key = {f.name: f.dataType.typeName() for f in df.schema}[column]
    turned = (lambda c: F.bitwise_not(c)) if key == "long" else (lambda c: F.reverse(c))
    right = other.withColumnRenamed(column, f"_{column}")
    return df.join(right, turned(df[column]) == turned(right[f"_{column}"]), how).drop(f"_{column}")


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def filesystem(uri: str):
    """(pyarrow filesystem, path) for a folder that Spark names by a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def place_of(df: DataFrame, column: str) -> int:
    """Where the column stands, by Spark's rules for names: case counts only under spark.sql.caseSensitive; none or several is an error."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    found = [k for k, name in enumerate(df.columns) if name == column or not exact and name.lower() == column.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {column}")
    return found[0]


def by_place(df: DataFrame) -> DataFrame:
    """The same columns under names that can't clash; toDF(*df.columns) gives them their own back."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def keep_rows(df: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """Rows of df, all columns as they are, for which keep says so; keep gets the values of one column, batch by batch.

    The column is found as Spark finds it, whatever its case; other columns may share a name, the wanted one may not.
    """
    at = place_of(df, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    plain = by_place(df)
    return map_batches(plain, run, plain.schema).toDF(*df.columns)
