"""Binary files of fixed-width records, and of lists that a fixed-width sidecar locates, as Spark data sources.

Files are split by bytes at record bounds, so a large file is read by many tasks, each its own range. Only wanted columns are
turned into Arrow; ranges of a column that files are sorted by are found by bisection before any task starts, other ranges are
applied to the records as they are read. Ranges come as an option, or from Spark's own filters where
spark.sql.python.filterPushdown.enabled is set. Files are opened by pyarrow's file systems.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Bytes of a partition, and records that are turned into Arrow at once.
PARTITION_BYTES, BATCH_RECORDS = 64 << 20, 1 << 16

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_TYPES = {"f4": "float", "f8": "double", "i1": "short", "u1": "short", "i2": "short", "u2": "int", "i4": "int", "u4": "long", "i8": "long"}
_ARROW = {"float": pa.float32(), "double": pa.float64(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64()}


def spark_type(dtype: np.dtype) -> str:
    """The Spark type that holds a number of a record; unsigned 64-bit ones have none."""
    if dtype.str[1:] not in _TYPES:
        raise ValueError(f"no Spark type for {dtype}")
    return _TYPES[dtype.str[1:]]


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file, given by a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def files_of(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in the order of their names, without those that start with _ or a dot."""
    from pyarrow import fs

    store, path = filesystem(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in found)


class Records:
    """A file of records: `header` bytes, then records of one dtype; bytes behind the last whole record are an error."""

    def __init__(self, store, path: str, size: int, dtype: np.dtype, header: int):
        self.store, self.path, self.dtype, self.header = store, path, dtype, header
        self.n, rest = divmod(max(0, size - header), dtype.itemsize)
        if rest:
            raise ValueError(f"{path}: {rest} bytes behind the last record")

    def read(self, low: int, high: int) -> np.ndarray:
        with self.store.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at((high - low) * self.dtype.itemsize, self.header + low * self.dtype.itemsize), self.dtype)

    def within(self, column: str, low: float, high: float) -> tuple[int, int]:
        """First and last place + 1 of values from low to high, by bisection of a file that is sorted by the column."""

        def place(before) -> int:
            a, b = 0, self.n
            while a < b:
                k = (a + b) // 2
                a, b = (k + 1, b) if before(self.read(k, k + 1)[column][0]) else (a, k)
            return a

        return place(lambda x: x < low), place(lambda x: x <= high)


@dataclass
class Slice(InputPartition):
    """Records `low` to `high` of a file."""

    path: str
    size: int
    low: int
    high: int


def _ranges(text: str | None) -> dict[str, tuple[float, float]]:
    return {c: (float(a), float(b)) for c, a, b in json.loads(text or "[]")}


class FixedWidthReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.header = options["path"], int(options.get("header", 0))
        self.dtype = _dtype(options["fields"])
        self.columns = [c for c in options.get("columns", "").split(",") if c] or list(self.dtype.names)
        self.row, self.sorted_by = options.get("row_column"), options.get("sorted_by")
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.ranges = _ranges(options.get("ranges"))

    def partitions(self) -> list[InputPartition]:
        store, _ = filesystem(self.uri)
        each = max(1, self.bytes // self.dtype.itemsize)
        made = []
        for path, size in files_of(self.uri):
            file = Records(store, path, size, self.dtype, self.header)
            low, high = file.within(self.sorted_by, *self.ranges[self.sorted_by]) if self.sorted_by in self.ranges else (0, file.n)
            made += [Slice(path, size, a, min(a + each, high)) for a in range(low, high, each)]
        return made or [Slice("", 0, 0, 0)]

    def kept(self, part: Slice) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first place, records, which are in the ranges) of a slice, a bounded number at a time."""
        file = Records(filesystem(self.uri)[0], part.path, part.size, self.dtype, self.header)
        for a in range(part.low, part.high, BATCH_RECORDS):
            records = file.read(a, min(a + BATCH_RECORDS, part.high))
            keep = np.ones(len(records), bool)
            for column, (low, high) in self.ranges.items():
                keep &= (records[column] >= low) & (records[column] <= high)
            yield a, records, keep

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        for first, records, keep in self.kept(part):
            at = np.flatnonzero(keep)
            columns = [pa.array(np.ascontiguousarray(records[c][at]).astype(_native(self.dtype[c]))) for c in self.columns]
            names = list(self.columns)
            if self.row:
                columns, names = [*columns, pa.array(first + at)], [*names, self.row]
            yield pa.RecordBatch.from_arrays([c.cast(_ARROW[spark_type(self.dtype[n])]) if n in self.dtype.names else c for c, n in zip(columns, names, strict=True)], names=names)


def _native(dtype: np.dtype) -> np.dtype:
    return dtype.newbyteorder("=")


def _dtype(text: str) -> np.dtype:
    return np.dtype([(name, kind) for name, kind in json.loads(text)])


class ListReader(FixedWidthReader):
    """Lists of a payload file whose place and length stand in the records, the sidecar."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.payload, self.offset, self.count = options["payload"], options["offset"], options["count"]
        self.kind, self.unit, self.per = np.dtype(options["kind"]), int(options["unit"]), int(options.get("per", 1))
        self.text = options.get("text") == "true"

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = filesystem(self.payload)
        if store.get_file_info(path).type == fs.FileType.Directory:  # a payload file of the same name for each sidecar file
            path = f"{path}/{part.path.rsplit('/', 1)[-1]}"
        for batch, (_, records, keep) in zip(super().read(part), self.kept(part), strict=True):
            records = records[keep]
            at, n = records[self.offset].astype(np.int64) * self.unit, records[self.count].astype(np.int64) * self.per
            yield batch.append_column("values", self._lists(store, path, at, n))

    def _lists(self, store, path: str, at: np.ndarray, n: np.ndarray) -> pa.Array:
        """One read for each run of lists that lie behind each other, joined in the records' order."""
        if not len(at):
            return pa.array([], pa.string() if self.text else pa.list_(_ARROW[spark_type(self.kind)]))
        size = n * self.kind.itemsize
        order = np.argsort(at, kind="stable")
        data, reached = [b""] * len(at), np.maximum.accumulate((at + size)[order]) if len(at) else at
        first = 0
        with store.open_input_file(path) as f:
            while first < len(order):
                start = last = int(at[order[first]])
                stop = first
                while stop < len(order) and at[order[stop]] <= max(last, start) and reached[stop] - start <= PARTITION_BYTES or stop == first:
                    last = int(reached[stop])
                    stop += 1
                held = f.read_at(last - start, start)
                for k in order[first:stop].tolist():
                    data[k] = held[at[k] - start : at[k] - start + size[k]]
                first = stop
        if self.text:
            return pa.array([x.decode() for x in data], pa.string())
        values = np.frombuffer(b"".join(data), self.kind).astype(_native(self.kind))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values).cast(_ARROW[spark_type(self.kind)]))


@dataclass
class Written(WriterCommitMessage):
    """A task's file, under its temporary and its final name."""

    held: str
    final: str
    records: int


class FixedWidthWriter(DataSourceArrowWriter):
    """Each task writes a file under a temporary name; the commit gives those of successful attempts their own."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.uri, self.dtype, self.attempt = options["path"], _dtype(options["fields"]), uuid.uuid4().hex
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = filesystem(self.uri)
        held = f"{folder}/_{self.attempt}/{context.partitionId():05d}-{context.taskAttemptId()}"
        store.create_dir(f"{folder}/_{self.attempt}", recursive=True)
        n = 0
        with store.open_output_stream(held) as f, self._open(held.rsplit("/", 1)[-1]) as payload:
            for b in iterator:
                out = np.zeros(b.num_rows, self.dtype)
                self._records(b, out, payload)
                for name in self.dtype.names:
                    if b.schema.get_field_index(name) < 0:
                        continue
                    column = b.column(b.schema.get_field_index(name))
                    if column.null_count:
                        raise ValueError(f"{name} holds nulls, which records have no place for")
                    out[name] = column.to_numpy(zero_copy_only=False)
                f.write(out.tobytes())
                n += b.num_rows
        return Written(held, f"{folder}/part-{context.partitionId():05d}.bin", n)

    def _open(self, name: str):
        return contextlib.nullcontext()

    def _records(self, b: pa.RecordBatch, out: np.ndarray, payload) -> None:
        """What a record holds besides its columns."""

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = filesystem(self.uri)
        if self.overwrite:
            for path, _ in files_of(self.uri):
                store.delete_file(path)
        for m in messages:
            if m is not None:
                store.move(m.held, m.final)
        self._clear(store, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*filesystem(self.uri))

    def _clear(self, store, folder: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{folder}/_{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_{self.attempt}")


class Pushed:
    """What takes Spark's own filters; Spark refuses readers that do while its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of numbers narrow the ranges; Spark still applies every filter, so ends may count as included."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in self.dtype.names and isinstance(f.value, (int, float)):
                low, high = self.ranges.get(f.attribute[0], (-np.inf, np.inf))
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = max(low, float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = min(high, float(f.value))
                self.ranges[f.attribute[0]] = (low, high)
            yield f


class PushedReader(Pushed, FixedWidthReader):
    pass


class PushedListReader(Pushed, ListReader):
    pass


class ListWriter(FixedWidthWriter):
    """Each task writes a sidecar and a payload file; both get their names at the commit."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options, overwrite)
        self.payload, self.offset, self.count = options["payload"], options["offset"], options["count"]
        self.kind, self.text, self.at = np.dtype(options["kind"]), options.get("text") == "true", 0

    def _open(self, name: str):
        store, folder = filesystem(self.payload)
        store.create_dir(f"{folder}/_{self.attempt}", recursive=True)
        self.at = 0
        return store.open_output_stream(f"{folder}/_{self.attempt}/{name}")

    def _records(self, b: pa.RecordBatch, out: np.ndarray, payload) -> None:
        values = b.column(b.schema.get_field_index("values"))
        if values.null_count:
            raise ValueError("values holds nulls, which records have no place for")
        values = values.cast(pa.large_binary()) if self.text else values.cast(pa.large_list(values.type.value_type))
        n = np.diff(np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1])
        payload.write(b"".join(values.to_pylist()) if self.text else values.flatten().to_numpy(zero_copy_only=False).astype(self.kind).tobytes())
        size = 1 if self.text else self.kind.itemsize
        out[self.count], out[self.offset] = n, self.at + (np.cumsum(n) - n) * size
        self.at += int(n.sum()) * size

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = filesystem(self.payload)
        for m in messages:
            if m is not None:
                store.move(f"{folder}/_{self.attempt}/{m.held.rsplit('/', 1)[-1]}", f"{folder}/{m.final.rsplit('/', 1)[-1]}")
        self._clear(store, folder)
        super().commit(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*filesystem(self.payload))
        super().abort(messages)


class FixedWidthSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def schema(self) -> str:
        dtype = _dtype(self.options["fields"])
        names = [c for c in self.options.get("columns", "").split(",") if c] or list(dtype.names)
        row = [f"`{self.options['row_column']}` long"] if "row_column" in self.options else []
        return ", ".join([*(f"`{c}` {spark_type(dtype[c])}" for c in names), *row])

    def reader(self, schema) -> DataSourceReader:
        return (PushedReader if self.options.get("push") == "true" else FixedWidthReader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FixedWidthWriter(self.options, overwrite)


class ListSource(FixedWidthSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_width_lists"

    def schema(self) -> str:
        kind = "string" if self.options.get("text") == "true" else f"array<{spark_type(np.dtype(self.options['kind']))}>"
        return f"{super().schema()}, values {kind}"

    def reader(self, schema) -> DataSourceReader:
        return (PushedListReader if self.options.get("push") == "true" else ListReader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ListWriter(self.options, overwrite)


def _options(path: str, dtype: np.dtype, columns: list[str] | None, ranges: dict[str, tuple[float, float]] | None, sorted_by: str | None, header: int, partition_bytes: int) -> dict[str, str]:
    made = {"path": path, "fields": json.dumps([(n, dtype[n].str) for n in dtype.names]), "header": str(header), "partition_bytes": str(partition_bytes)}
    if columns:
        made["columns"] = ",".join(columns)
    if ranges:
        made["ranges"] = json.dumps([(c, a, b) for c, (a, b) in ranges.items()])
    if sorted_by:
        made["sorted_by"] = sorted_by
    return made


def read_records(
    spark: SparkSession,
    path: str,
    dtype: np.dtype,
    columns: list[str] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
    sorted_by: str | None = None,
    header: int = 0,
    row_column: str | None = None,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """Records of a file or of a folder's files: the wanted columns of those in all ranges, both ends included.

    sorted_by: a column that each file is sorted by; a range of it is found by bisection, and only its bytes are read.
    row_column: adds the record's place in its file. Empty files and folders have no rows; a NaN is in no range.
    """
    spark.dataSource.register(FixedWidthSource)
    options = _options(path, dtype, columns, ranges, sorted_by, header, partition_bytes) | {"push": spark.conf.get(PUSHDOWN, "false")}
    return spark.read.format("fixed_width").options(**options, **({"row_column": row_column} if row_column else {})).load()


def read_lists(
    spark: SparkSession,
    sidecar: str,
    dtype: np.dtype,
    payload: str,
    kind: str,
    offset: str,
    count: str,
    unit: int = 1,
    per: int = 1,
    text: bool = False,
    columns: list[str] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
    sorted_by: str | None = None,
    header: int = 0,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """The sidecar's records (see read_records) with values: the list that each locates in the payload file.

    A list starts at offset * unit bytes and has count * per numbers of `kind`, or is text of so many bytes. Lists that lie
    behind each other are read together.
    """
    spark.dataSource.register(ListSource)
    more = {"payload": payload, "kind": kind, "offset": offset, "count": count, "unit": str(unit), "per": str(per), "text": str(text).lower(), "push": spark.conf.get(PUSHDOWN, "false")}
    return spark.read.format("fixed_width_lists").options(**_options(sidecar, dtype, columns, ranges, sorted_by, header, partition_bytes), **more).load()


def write_records(df: DataFrame, path: str, dtype: np.dtype) -> None:
    """The dtype's columns of df as records, a file for each task in a folder; nulls are an error. Sort df before to be able to search the files."""
    df.sparkSession.dataSource.register(FixedWidthSource)
    df.select(*dtype.names).write.format("fixed_width").options(**_options(path, dtype, None, None, None, 0, PARTITION_BYTES)).mode("append").save()


def write_lists(df: DataFrame, sidecar: str, dtype: np.dtype, payload: str, kind: str, offset: str, count: str, text: bool = False) -> None:
    """df's column values as lists of `kind`, or as texts, in payload files, and the dtype's columns with each list's place in bytes and length in sidecar files.

    A task writes one file of either kind; read_lists finds a sidecar file's payload by its name. Nulls are an error.
    """
    df.sparkSession.dataSource.register(ListSource)
    more = {"payload": payload, "kind": kind, "offset": offset, "count": count, "unit": "1", "text": str(text).lower()}
    own = [c for c in dtype.names if c not in (offset, count)]
    df.select(*own, "values").write.format("fixed_width_lists").options(**_options(sidecar, dtype, None, None, None, 0, PARTITION_BYTES), **more).mode("append").save()
