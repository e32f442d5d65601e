"""Cheapest repairs of conversations, solved once for each distinct sequence of roles and faults.

A row becomes one character of its conversation's signature. Signatures are cut into blocks of BLOCK rows; each distinct block is
solved by memoised recursion for every pair of states before and after it, a fold over a conversation's blocks picks the states,
and the edits are joined back and replayed.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import map_batches, materialize, rehashed

#: Rows of a conversation that are solved together.
BLOCK = 128

BLANKS = " \t\n\x0b\x0c\r"

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States of role initials `(s?(ua)+)?`: nothing yet, after s, after u, after a. What may be inserted in each, and where it leads.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: ("u", _USER), _SYSTEM: ("u", _USER), _USER: ("a", _ASSISTANT), _ASSISTANT: ("u", _USER)}

#: What closes a conversation in each state.
_TAIL = {_START: "", _SYSTEM: "ua", _USER: "a", _ASSISTANT: ""}

#: More than any block of edits costs.
_NEVER = 1 << 40


def audit_of(plan: Column) -> Column:
    """Edits as initials: u and a insert a row of that role, U and A give a row that role, K keeps, D deletes."""
    return F.translate(plan, "uaUA", "IIRR")


@functools.lru_cache(maxsize=1 << 14)
def edits(signature: str, state: int) -> tuple[tuple[int, str, str] | None, ...]:
    """For each state after the signature's rows: (cost, audit, plan) of the cheapest edits, the ASCII-least of equals.

    s, u, a: a row of that role's initial, x: of another; capitals: truncated; d: to be deleted. Every row's part of a plan ends
    with its own edit, so no audit is the start of another, and least parts make least wholes.
    """
    if not signature:
        return tuple((0, "", "") if k == state else None for k in range(4))
    kind, role = signature[0], signature[0].lower()
    extra = TRUNCATED if kind.isupper() else 0
    found: list[tuple[int, str, str] | None] = [None] * 4
    at, inserted = state, ""
    for _ in range(3):
        steps = [(DELETE, "D", "D", at)]
        if kind != "d":
            fits, after = _NEXT[at]
            steps.append((REROLE + extra, "R", fits.upper(), after))
            if role == fits:
                steps.append((extra, "K", "K", after))
            elif role == "s" and at == _START:
                steps.append((extra, "K", "K", _SYSTEM))
        for cost, audit, plan, after in steps:
            head = (INSERT * len(inserted) + cost, "I" * len(inserted) + audit, inserted + plan)
            for k, rest in enumerate(edits(signature[1:], after)):
                if rest is not None:
                    whole = (head[0] + rest[0], head[1] + rest[1], head[2] + rest[2])
                    if found[k] is None or whole < found[k]:
                        found[k] = whole
        letter, at = _NEXT[at]
        inserted += letter
    return tuple(found)


def path(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int], str]:
    """(cost, states before each block and after the last, closing inserts) of the cheapest way through a conversation's blocks.

    costs and ranks: 16 numbers a block, by state before and after; ranks order the audits of one state before.
    """
    rest = [INSERT * len(_TAIL[q]) for q in range(4)]
    chosen = []
    for cost, rank in zip(reversed(costs), reversed(ranks), strict=True):
        best = [min((cost[4 * q + k] + rest[k], rank[4 * q + k], k) for k in range(4)) for q in range(4)]
        rest = [b[0] for b in best]
        chosen.append([b[2] for b in best])
    states = [_START]
    for after in reversed(chosen):
        states.append(after[states[-1]])
    return rest[_START], states, _TAIL[states[-1]]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(`conv_id:turn`) % 20: 0 drops, 1 empties, 2 strips `.!?`, 3 repeats, 4 makes the role user.

    Nulls in the key, in role and in text count as one space; conv_id and turn themselves stay.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"), by.alias("by")).where("by <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _keyed(df: DataFrame) -> list[Column]:
    """conv_id as two columns without nulls."""
    return [F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("void")]


_KEY = ["conv", "void"]


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, void, n, turn, role, text, fault, illegal, fresh): rows in order with their first fault.

    n counts from 0 by turn (nulls first), then role and text; fault is blank, duplicate, truncated or null; illegal: this and
    the role before are no su, ua or au; fresh: the turn is no null and not that of the row before.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(*_keyed(rows), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    order = Window.partitionBy(*_KEY).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    pair = F.concat(F.substring(F.lag("role").over(order), 1, 1), F.substring("role", 1, 1))
    placed = plain.select(
        "*",
        (F.row_number().over(order) - 1).cast("long").alias("n"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & F.coalesce(F.col("turn") != F.lag("turn").over(order), F.lit(True))).alias("fresh"),
    )
    again = F.row_number().over(Window.partitionBy(*_KEY, "role", "text").orderBy("n")) > 1
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", "blank").when(again, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return placed.withColumn("fault", fault)


def _solved(blocks: DataFrame) -> DataFrame:
    """Each distinct block signature once, with its 16 edits: cost, rank among those of one state before, plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for signature in b.column(0).to_pylist():
                found = []
                for q in range(4):
                    of = edits(signature, q)
                    ranks = {a: k for k, a in enumerate(sorted(x[1] for x in of if x))}
                    found += [{"cost": x[0], "rank": ranks[x[1]], "plan": x[2]} if x else {"cost": _NEVER, "rank": 4, "plan": ""} for x in of]
                out.append({"signature": signature, "edits": found})
            yield pa.RecordBatch.from_pylist(out, _SOLVED)

    return map_batches(blocks.select("signature").distinct(), run, "signature string, edits array<struct<cost: long, rank: int, plan: string>>")


_SOLVED = pa.schema([("signature", pa.string()), ("edits", pa.list_(pa.struct([("cost", pa.int64()), ("rank", pa.int32()), ("plan", pa.string())])))])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [path([x["costs"] for x in blocks], [x["ranks"] for x in blocks]) for blocks in b.column("blocks").to_pylist()]
        cost, states, tail = zip(*found, strict=True) if found else ((), (), ())
        made = [b.column("conv"), b.column("void"), pa.array(cost, pa.int64()), pa.array(states, pa.list_(pa.int32())), pa.array(tail, pa.string())]
        yield pa.RecordBatch.from_arrays(made, names=["conv", "void", "cost", "states", "tail"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the rows `role:text` of each conversation, which arrive in order; nothing but the running digest is kept."""
    held, digest = None, None
    for b in batches:
        made = []
        for conv, void, role, text in zip(*(b.column(k).to_pylist() for k in ("conv", "void", "role", "text")), strict=True):
            if held != (conv, void):
                if held is not None:
                    made.append((*held, digest.hexdigest()))
                held, digest = (conv, void), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield from _digest_rows(made)
    if held is not None:
        yield from _digest_rows([(*held, digest.hexdigest())])


def _digest_rows(made: list[tuple[int, bool, str]]) -> Iterator[pa.RecordBatch]:
    if made:
        conv, void, digest = zip(*made, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(void), pa.array(digest)], names=["conv", "void", "repaired_sha256"])


class Repair:
    """The repair of all conversations of a table (conv_id, turn, role, text).

    audits(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, a row per conversation with rows; repaired():
    conv_id, n, role, text, the rows after the edits; digests(): conv_id and the SHA-256 of its repaired rows.

    Null roles and texts count as one space, null turns come first, ties of turn go by role and text, a null conv_id is a
    conversation like any other, repeated rows are duplicates, further columns are not read, an empty table gives empty ones.
    A conversation's rows are numbered and digested in one task each, in a sort that spills: a digest over a conversation has to
    read it in order. Signatures go in blocks, whatever a conversation's length; copies of a signature are solved once, and the
    join that brings the edits back may be split where one signature is very common.
    """

    def __init__(self, rows: DataFrame):
        self.rows = materialize(numbered(rows).withColumn("block", F.floor(F.col("n") / BLOCK).cast("long")), "rows")
        role = F.substring("role", 1, 1)
        role = F.when(role.isin("s", "u", "a"), role).otherwise("x")
        kind = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
        letters = F.array_sort(F.collect_list(F.struct("n", kind.alias("kind"))))
        blocks = self.rows.groupBy(*_KEY, "block").agg(F.array_join(F.transform(letters, lambda x: x.kind), "").alias("signature"))
        blocks = materialize(blocks, "blocks")
        self.blocks = materialize(rehashed(blocks, _solved(blocks), "signature").drop("signature"), "edits")
        part = F.struct("block", F.transform("edits", lambda x: x.cost).alias("costs"), F.transform("edits", lambda x: x["rank"]).alias("ranks"))
        folded = self.blocks.groupBy(*_KEY).agg(F.array_sort(F.collect_list(part)).alias("blocks"))
        self.paths = materialize(map_batches(folded, _paths, "conv long, void boolean, cost long, states array<int>, tail string"), "paths")
        steps = self.paths.select(*_KEY, F.posexplode(F.slice("states", F.lit(1), F.size("states") - 1)).alias("block", "before"), "states")
        steps = steps.select(*_KEY, F.col("block").cast("long").alias("block"), (4 * F.col("before") + F.col("states")[F.col("block") + 1]).alias("way"))
        self.plans = materialize(self.blocks.join(steps.hint("merge"), [*_KEY, "block"]).select(*_KEY, "block", F.col("edits")[F.col("way")].plan.alias("plan")), "plans")

    def audits(self) -> DataFrame:
        count = lambda c: F.sum(c.cast("long"))
        of = lambda fault: count(F.coalesce(F.col("fault") == fault, F.lit(False))).alias(fault)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("fresh")), F.lit(0)).alias("gaps")
        faults = self.rows.groupBy(*_KEY).agg(gaps, of("blank"), of("duplicate"), of("truncated"), count(F.col("illegal")).alias("illegal"))
        whole = self.plans.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("block", "plan"))).alias("plans"))
        audit = audit_of(F.concat(F.array_join(F.transform("plans", lambda x: x.plan), ""), "tail")).alias("audit")
        return faults.join(self.paths, _KEY).join(whole, _KEY).select(self._id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit)

    @staticmethod
    def _id() -> Column:
        return F.when(~F.col("void"), F.col("conv")).alias("conv_id")

    def _replayed(self) -> DataFrame:
        own = F.regexp_extract_all("plan", F.lit("[ua]*[KDUA]"), F.lit(0))[(F.col("n") % BLOCK).cast("int")]
        letter = F.substring("edits", F.col("k") + 1, F.lit(1))
        edited = self.rows.join(self.plans.hint("merge"), [*_KEY, "block"]).select(*_KEY, "n", "role", "text", own.alias("edits"))
        each = edited.select("*", F.explode(F.sequence(F.lit(0), F.length("edits") - 1)).alias("k")).withColumn("edit", letter).where("edit <> 'D'")
        role = F.when(F.lower("edit") == "u", "user").when(F.lower("edit") == "a", "assistant").otherwise(F.col("role"))
        kept = each.select(*_KEY, "n", "k", role.alias("role"), F.when(F.col("edit").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))
        end = self.paths.where("tail <> ''").select(*_KEY, F.posexplode(F.split("tail", "")).alias("k", "edit")).where("edit <> ''")
        after = F.lit(1 << 62).cast("long")
        return kept.unionAll(end.select(*_KEY, after.alias("n"), "k", F.when(F.col("edit") == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))

    def repaired(self) -> DataFrame:
        order = Window.partitionBy(*_KEY).orderBy("n", "k")
        return self._replayed().select(self._id(), (F.row_number().over(order) - 1).cast("long").alias("n"), "role", "text")

    def digests(self) -> DataFrame:
        ordered = self._replayed().repartition(*_KEY).sortWithinPartitions(*_KEY, "n", "k").select(*_KEY, "role", "text")
        return map_batches(ordered, _digests, "conv long, void boolean, repaired_sha256 string").select(self._id(), "repaired_sha256")


def repair_report(damaged_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Audits and digests for every conv_id of `ids`; conversations without rows have zeros, an empty audit and the empty string's hash."""
    repair = Repair(damaged_rows)
    every = ids.select("conv_id").distinct().select(*_keyed(ids))
    found = repair.audits().select(*_keyed(ids), "*").drop("conv_id").join(repair.digests().select(*_keyed(ids), "repaired_sha256"), _KEY, "left")
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, _KEY, "left").select(
        Repair._id(),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
