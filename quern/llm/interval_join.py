"""Overlap joins of intervals per client by a global range partition, without listing pairs.

Sessions of one client never overlap, so that their starts and their ends rise together and every relation to a given sale holds
for a run of them. Sessions and sales are range-partitioned by client and start; a partition answers the sales of all clients
that lie wholly in it by differences of running sums. Clients that reach over a boundary leave their partition's sums: these are
carried into later partitions (sessions that still run, as sums and one session; sales, as a row at their end), and the sums at a
sale's start and end are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize, rehashed

HOUR = 3_600_000_000
GAP = 600_000_000

#: The end slot of what is open.
OPEN = 1 << 36

#: The sale starts earlier, equally, later; within each it ends earlier, equally, later.
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")

_CLOSED, _OPEN, _START, _END = range(4)


def micros(df: DataFrame, column: str) -> Column:
    """Whole microseconds since 1970 UTC; a timestamp without a zone is taken as UTC, whatever the session's zone."""
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_micros(F.col(column))
    since = F.col(column) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def slot(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)) if width & (width - 1) == 0 else ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


def sessions(clicks: DataFrame, gap: int = GAP) -> DataFrame:
    """(client_id, first_us, last_us, is_open) of each client's runs of clicks that follow each other within `gap` microseconds.

    clicks: client_id, ts and kind; rows without client_id or ts are ignored, repeated rows change nothing, an empty table gives
    an empty one. A session is open if one of the clicks at its last instant is a purchase (a null kind is none). Clicks of one
    stretch of `gap` microseconds belong together anyway and are combined before the shuffle; range partitions then build
    sessions, and the first and last ones of each partition are joined where they touch.
    """
    spark = clicks.sparkSession
    plain = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL").select(
        F.col("client_id").cast("long").alias("client_id"), micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("buys")
    )
    runs = plain.groupBy("client_id", slot(F.col("us"), gap).alias("stretch")).agg(F.min("us").alias("first_us"), F.max(F.struct("us", "buys")).alias("end"))
    dealt = (
        runs.select("client_id", "first_us", F.col("end.us").alias("last_us"), F.col("end.buys").alias("is_open"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "client_id", "first_us")
        .sortWithinPartitions("client_id", "first_us")
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, True
        for b in batches:
            if not b.num_rows:
                continue
            table = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                table = [np.concatenate([h, c]) for h, c in zip(held, table, strict=True)]
            client, first, last, _ = table
            starts = np.flatnonzero(np.concatenate([[True], (client[1:] != client[:-1]) | (first[1:] - last[:-1] > gap)]))
            ends = np.append(starts[1:], len(client)) - 1
            made = [client[starts], first[starts], last[ends], table[3][ends]]
            held = [c[-1:] for c in made]
            if len(starts) > 1:
                yield _batch([*(c[:-1] for c in made), np.arange(len(starts) - 1) == (0 if head else -1)], b.schema.names)
                head = False
        if held is not None:
            yield _batch([*held, np.array([True])], ["client_id", "first_us", "last_us", "is_open"])

    made = materialize(dealt.mapInArrow(pieces, "client_id long, first_us long, last_us long, is_open boolean, edge boolean"), "pieces")
    order = Window.partitionBy("client_id").orderBy("first_us")
    touching = made.where("edge").withColumn("new", F.coalesce((F.col("first_us") - F.lag("last_us").over(order) > gap).cast("long"), F.lit(1)))
    whole = (
        touching.withColumn("n", F.sum("new").over(order))
        .groupBy("client_id", "n")
        .agg(F.min("first_us").alias("first_us"), F.max(F.struct("last_us", "is_open")).alias("end"))
        .select("client_id", "first_us", "end.last_us", "end.is_open")
    )
    return made.where("NOT edge").drop("edge").unionAll(whole)


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*names, "edge"])


def sale_intervals(sales: DataFrame, lines: DataFrame, width: int = HOUR) -> DataFrame:
    """(sale_id, client_id, s, e) of every sale row with client_id and sold_at: first and last slot, OPEN as the last of an open sale.

    A sale ends at the latest of sold_at and its lines' shipped_at and is open if a line lacks shipped_at; no lines, or a null
    sale_id: it ends at sold_at. A repeated sale row is a row of its own, repeated lines change nothing.
    """
    ends = (
        lines.where("sale_id IS NOT NULL")
        .select(F.col("sale_id").cast("long").alias("sale_id"), micros(lines, "shipped_at").alias("shipped"))
        .groupBy("sale_id")
        .agg(F.max("shipped").alias("shipped"), F.max(F.col("shipped").isNull()).alias("is_open"))
    )
    sold = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL").select(
        F.col("sale_id").cast("long").alias("sale_id"), F.col("client_id").cast("long").alias("client_id"), micros(sales, "sold_at").alias("sold")
    )
    e = F.when(F.coalesce("is_open", F.lit(False)), OPEN).otherwise(slot(F.greatest("sold", "shipped"), width))
    return rehashed(sold.hint("merge"), ends, "sale_id", "left").select("sale_id", "client_id", slot(F.col("sold"), width).alias("s"), e.alias("e"))


class Sums:
    """Running sums over rows in order: of 1 and of each given column, before each place."""

    def __init__(self, n: int, *columns: np.ndarray):
        self.table = np.zeros((1 + len(columns), n + 1), np.int64)
        for k, c in enumerate((np.ones(n, np.int64), *columns)):
            np.cumsum(c, out=self.table[k, 1:])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return self.table[:, at]


def _latest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a[0] >= b[0], a, b)


def _earliest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a[0] <= b[0], a, b)


def relation_sums(s: np.ndarray, e: np.ndarray, at_start: np.ndarray, at_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, shared slots, crc sums), each of 9 relations x sales, from the running sums at the sales' starts and ends.

    at_start, 18 x sales: closed sessions that start before s, by s, and that end before s, four sums each (1, crc, start, end);
    open ones that start before s and by s, three each. at_end, 15 x sales: closed ones that start by e, end before e, end by e;
    open ones that start by e.
    """
    before, by, gone, o_before, o_by = np.split(at_start, [4, 8, 12, 15])
    reached, e_before, e_by, o_reached = np.split(at_end, [4, 8, 12])
    n, slots, crc = (np.zeros((9, len(s)), np.int64) for _ in range(3))
    starts = ((by, reached), (before, by), (gone, before))
    ends = ((e_by, reached), (e_before, e_by), (gone, e_before))
    for j, (lo, hi) in enumerate(starts):
        for k, (least, most) in enumerate(ends):
            d = _earliest(hi, most) - (low := _latest(lo, least))
            d = np.where(d[0] > 0, d, 0)
            right = e * d[0] if k == 0 else d[3]
            left = s * d[0] if j == 2 else d[2]
            n[3 * j + k], crc[3 * j + k], slots[3 * j + k] = d[0], d[1], np.where(d[0] > 0, right - left + d[0], 0)
    endless = e == OPEN
    for j, (lo, hi) in enumerate(((o_by, o_reached), (o_before, o_by), (np.zeros_like(o_before), o_before))):
        d = hi - lo
        left = s * d[0] if j == 2 else d[2]
        for k, which in ((0, ~endless), (1, endless)):
            n[3 * j + k] += np.where(which, d[0], 0)
            crc[3 * j + k] += np.where(which, d[1], 0)
            if k == 0:
                slots[3 * j] += np.where(which, e * d[0] - left + d[0], 0)
    return n, slots, crc


_RESULT = "client_id long, s long, e long, relation int, n long, slots long, crc long"


def _long_form(client: np.ndarray, s: np.ndarray, e: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[pa.Array]:
    n, slots, crc = sums
    at, relation = np.nonzero(n.T)
    both_open = (e[at] == OPEN) & (relation % 3 == 1)
    return [
        pa.array(client[at]), pa.array(s[at]), pa.array(e[at]), pa.array(relation.astype(np.int32)), pa.array(n[relation, at]),
        pa.array(slots[relation, at], mask=both_open), pa.array(crc[relation, at]),
    ]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range partition: results of clients wholly in it, sums of its first and last client, which may reach over its ends."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    client, at, kind, other, crc = (table.column(k).to_numpy() for k in range(5))
    del table
    rank = np.concatenate([[0], np.cumsum(client[1:] != client[:-1])])
    key = lambda rank, slot: (rank << 38) + slot + OPEN  # noqa: E731  slots lie within +-OPEN
    where = [np.flatnonzero(kind == k) for k in range(4)]
    closed, opened = where[_CLOSED], where[_OPEN]
    begun, ended, o_begun = key(rank[closed], at[closed]), key(rank[closed], other[closed]), key(rank[opened], at[opened])
    sums, o_sums = Sums(len(closed), crc[closed], at[closed], other[closed]), Sums(len(opened), crc[opened], at[opened])

    def before(r):  # what clients before r in this partition add
        k = key(r, np.full(len(r), -OPEN))
        return sums(np.searchsorted(begun, k, "left")), o_sums(np.searchsorted(o_begun, k, "left"))

    def at_start(r, s):
        k, (base, o_base) = key(r, s), before(r)
        found = [sums(np.searchsorted(*x)) - base for x in ((begun, k, "left"), (begun, k, "right"), (ended, k, "left"))]
        return np.concatenate([*found, *(o_sums(np.searchsorted(o_begun, k, x)) - o_base for x in ("left", "right"))])

    def at_end(r, e):
        k, (base, o_base) = key(r, e), before(r)
        found = [sums(np.searchsorted(*x)) - base for x in ((begun, k, "right"), (ended, k, "left"), (ended, k, "right"))]
        return np.concatenate([*found, o_sums(np.searchsorted(o_begun, k, "right")) - o_base])

    edge = (rank == 0) | (rank == rank[-1])
    rows = where[_START][~edge[where[_START]]]
    for part in np.array_split(rows, len(rows) // 65_536 + 1):
        s, e = at[part], other[part]
        found = relation_sums(s, e, at_start(rank[part], s), at_end(rank[part], e))
        yield _swept(_long_form(client[part], s, e, found), pid, None)
    for kind_of, f in ((_START, at_start), (_END, at_end)):
        rows = where[kind_of][edge[where[kind_of]]]
        for part in np.array_split(rows, len(rows) // 65_536 + 1):
            s, e = (at[part], other[part]) if kind_of == _START else (other[part], at[part])
            made = [pa.array(client[part]), pa.array(s), pa.array(e), pa.array(np.full(len(part), -1 - kind_of, np.int32)), *(pa.nulls(len(part), pa.int64()) for _ in range(3))]
            yield _swept(made, pid, f(rank[part], at[part]).T)
    last = np.unique([0, rank[-1]])
    totals = [b - a for a, b in zip(before(last), before(last + 1), strict=True)]
    final = np.searchsorted(begun, key(last + 1, np.full(len(last), -OPEN)), "left") - 1
    running = [np.where(totals[0][0] > 0, c[closed][final] if len(closed) else 0, 0) for c in (crc, at, other)]
    whose = client[np.searchsorted(rank, last)]
    made = [pa.array(whose), *(pa.array(np.zeros(len(last), np.int64)) for _ in range(2)), pa.array(np.full(len(last), -1, np.int32)), *(pa.nulls(len(last), pa.int64()) for _ in range(3))]
    yield _swept(made, pid, np.concatenate([*totals, running]).T)


def _swept(made: list[pa.Array], pid: int, own: np.ndarray | None) -> pa.RecordBatch:
    n = len(made[0])
    lists = pa.nulls(n, pa.list_(pa.int64())) if own is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * own.shape[1]), pa.array(np.ascontiguousarray(own).ravel()))
    return pa.RecordBatch.from_arrays([*made, pa.array(np.full(n, pid, np.int64)), lists], names=["client_id", "s", "e", "relation", "n", "slots", "crc", "pid", "sums"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            client, s, e = (b.column(k).to_numpy() for k in range(3))
            sums = [np.ascontiguousarray(b.column(k).flatten().to_numpy().reshape(b.num_rows, -1).T) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays(_long_form(client, s, e, relation_sums(s, e, *sums)), names=["client_id", "s", "e", "relation", "n", "slots", "crc"])


def interval_sums(intervals: DataFrame, runs: DataFrame) -> DataFrame:
    """(client_id, s, e, relation, n, slots, crc) of each distinct interval and relation, summed over the client's runs that share a slot.

    intervals: client_id, s, e; runs: client_id, a, b and crc, where a client's runs in order end no later than the next one
    starts, but for open ones. OPEN as an end is infinite. slots is null where both are open, relation a place in RELATIONS.
    Nothing is collected or broadcast, and a partition holds its own share of the rows alone; hot clients have many partitions.
    """
    spark = intervals.sparkSession
    row = lambda at, kind, other, crc: F.struct(at.alias("at"), F.lit(kind).alias("kind"), other.alias("other"), crc.alias("crc"))
    asked = intervals.select("client_id", "s", "e").distinct()
    asked = asked.select("client_id", F.explode(F.array(row(F.col("s"), _START, F.col("e"), F.lit(0).cast("long")), row(F.col("e"), _END, F.col("s"), F.lit(0).cast("long")))).alias("r")).select("client_id", "r.*")
    given = runs.select("client_id", F.col("a").alias("at"), F.when(F.col("b") == OPEN, _OPEN).otherwise(_CLOSED).alias("kind"), F.col("b").alias("other"), "crc")
    dealt = given.unionAll(asked).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "client_id", "at").sortWithinPartitions("client_id", "at", "kind", "other")
    swept = materialize(dealt.mapInArrow(_sweep, f"{_RESULT}, pid long, sums array<long>"), "swept")
    earlier = Window.partitionBy("client_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = swept.where("relation = -1")
    carry = ends.select(
        "client_id",
        "pid",
        *(F.coalesce(F.sum(F.col("sums")[k]).over(earlier), F.lit(0)).alias(f"t{k}") for k in range(7)),
        F.last(F.when(F.col("sums")[0] > 0, F.slice("sums", 8, 3)), ignorenulls=True).over(earlier).alias("running"),
    )
    crossing = swept.where("relation < -1").join(carry.hint("merge"), ["client_id", "pid"])
    # closed sessions of earlier partitions have ended before any slot of this one, but for the last
    session = F.array(F.lit(1).cast("long"), F.col("running")[0], F.col("running")[1], F.col("running")[2])
    carried = F.array(*(F.col(f"t{k}") for k in range(4)))
    o_carried = F.array(*(F.col(f"t{k}") for k in range(4, 7)))
    less = lambda still: F.when(F.coalesce(still, F.lit(False)), F.zip_with(carried, session, lambda x, y: x - y)).otherwise(carried)
    end = F.col("running")[2]
    add = F.when(F.col("relation") == -1 - _START, F.concat(carried, carried, less(end >= F.col("s")), o_carried, o_carried)).otherwise(
        F.concat(carried, less(end >= F.col("e")), less(end > F.col("e")), o_carried)
    )
    whole = crossing.withColumn("sums", F.zip_with("sums", add, lambda x, y: x + y)).groupBy("client_id", "s", "e").agg(
        F.max(F.when(F.col("relation") == -1 - _START, F.col("sums"))).alias("at_start"), F.max(F.when(F.col("relation") == -1 - _END, F.col("sums"))).alias("at_end")
    )
    return swept.where("relation >= 0").drop("pid", "sums").unionAll(whole.mapInArrow(_merged, _RESULT))


def overlap_join(sales: DataFrame, lines: DataFrame, clicks: DataFrame, width: int = HOUR, gap: int = GAP) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) of sales and their clients' click sessions that share a slot.

    See sale_intervals and sessions for rows that take no part; sales without any session have no row, sales rows of one
    sale_id (nulls included) are summed. Columns beside those named are not read.
    """
    sold = materialize(sale_intervals(sales, lines, width), "sales")
    runs = sessions(clicks, gap).select(
        "client_id",
        slot(F.col("first_us"), width).alias("a"),
        F.when(F.col("is_open"), OPEN).otherwise(slot(F.col("last_us"), width)).alias("b"),
        F.crc32(F.col("first_us").cast("string").cast("binary")).alias("crc"),
    )
    found = interval_sums(sold, runs)
    names = F.array(*map(F.lit, RELATIONS))
    return (
        sold.hint("merge")
        .join(found, ["client_id", "s", "e"])
        .groupBy("sale_id", "relation")
        .agg(F.sum("n").alias("n_pairs"), F.sum("slots").alias("overlap_slots"), F.sum("crc").alias("sessions_crc"))
        .select("sale_id", names[F.col("relation")].alias("relation"), "n_pairs", "overlap_slots", "sessions_crc")
    )
