"""Conversation repair, interval overlaps and byte-level BPE: edges, brute force, and parts of the methods."""

import base64
import collections
import datetime
import functools
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import byte_bpe, conversation_repair, interval_join
from quern.llm.conversation_sql import OP11_SQL
from quern.llm.interval_sql import OP12_SQL

# -- 11


def cheapest(rows):
    """(cost, audit) by a search over all edits. rows: (initial, fault)."""

    @functools.cache
    def go(i, state, inserted):
        out = []
        if i == len(rows):
            if state in ("", "a"):
                out.append((0, ""))
        else:
            initial, fault = rows[i]
            rest = go(i + 1, state, 0)
            out.append((2 + rest[0], "D" + rest[1]))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for role in "sua":
                    if not (role == "s" and state == "" or role == "u" and state in ("", "s", "a") or role == "a" and state == "u"):
                        continue
                    rest = go(i + 1, role, 0)
                    if initial == role:
                        out.append((more + rest[0], "K" + rest[1]))
                    if role != "s":
                        out.append((1 + more + rest[0], "R" + rest[1]))
        if inserted < 3:
            role = "a" if state == "u" else "u"
            rest = go(i, role, inserted + 1)
            out.append((5 + rest[0], "I" + rest[1]))
        return min(out, default=(10**9, ""))

    return go(0, "", 0)


def signature(rows):
    out = ""
    for initial, fault in rows:
        role = initial if initial in ("s", "u", "a") else "x"
        out += "d" if fault in ("blank", "duplicate") else role.upper() if fault == "truncated" else role
    return out


def solved(text, block):
    parts = [text[k : k + block] for k in range(0, len(text), block)]
    tables = [[conversation_repair.edits(p, q) for q in range(4)] for p in parts]
    costs = [[x[0] if x else 1 << 40 for of in t for x in of] for t in tables]
    ranks = [[sorted(y[1] for y in of if y).index(x[1]) if x else 4 for of in t for x in of] for t in tables]
    cost, states, tail = conversation_repair.path(costs, ranks)
    plan = "".join(tables[k][a][b][2] for k, (a, b) in enumerate(itertools.pairwise(states))) + tail
    return cost, plan.translate(str.maketrans("uaUA", "IIRR"))


def test_edits_are_the_cheapest_and_least():
    every = [(r, f) for r in ("s", "u", "a", "t") for f in ("", "blank", "truncated")]
    for n in range(4):
        for rows in itertools.product(every, repeat=n):
            assert solved(signature(rows), 128) == cheapest(rows), rows
    rnd = random.Random(4)
    for _ in range(400):
        rows = tuple(rnd.choice([*every, ("u", ""), ("a", "")]) for _ in range(rnd.randint(4, 14)))
        assert {solved(signature(rows), block) for block in (1, 2, 5, 128)} == {cheapest(rows)}


ODD = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, None, None), (1, None, "assistant", "no end"), (1, 5, "assistant", "yes! "), (1, 9, "system", "late."),
       (2, None, "user", ""), (None, 1, "user", "who?"), (None, 2, "assistant", "me."), (3, 1, "", "x."), (3, 1, "", "y."), (3, 2, "other", "\x0b \r")]


def talk(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("n", "conv", "void", "fault", "block", "cost", "by", "copy"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("block", [2, 128])
def test_repair_of_odd_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rnd = random.Random(9)
    rows = list(ODD)
    for conv in range(4, 120):
        for turn in range(rnd.randint(1, 9)):
            rows.append((conv, turn, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rnd.choice(["", "a.", "b?", "cut", "Yes! ", f"t{turn}."])))
    df = talk(spark, rows)
    got = sorted(map(tuple, conversation_repair.repair_report(conversation_repair.damaged(df), df).collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert got == sorted(con.execute(OP11_SQL).fetchall(), key=repr)
    empty = df.where("false")
    assert conversation_repair.repair_report(conversation_repair.damaged(empty), empty).count() == 0


def test_repaired_rows_are_those_of_the_audit(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "cut"), (1, 2, "user", "What?"), (2, 0, "system", "You help."), (2, 1, "user", "Go."), (3, 0, "assistant", "")]
    repair = conversation_repair.Repair(talk(spark, rows))
    got = collections.defaultdict(list)
    for r in repair.repaired().orderBy("conv_id", "n").collect():
        got[r.conv_id].append((r.n, r.role, r.text))
    digests = {r.conv_id: r.repaired_sha256 for r in repair.digests().collect()}
    for conv, held in got.items():
        assert [n for n, _, _ in held] == list(range(len(held)))
        assert digests[conv] == hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in held).encode()).hexdigest()
        assert "".join(role[0] for _, role, _ in held).replace("ua", "") in ("", "s")
    for r in repair.audits().collect():
        own = [(role[0], fault) for (c, _, role, text), fault in zip(rows, ("", "truncated", "", "", "", "blank"), strict=True) if c == r.conv_id]
        assert (r.cost, r.audit) == cheapest(tuple(own))


# -- 12


def at(seconds):
    return None if seconds is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def shop(spark, sales, lines, clicks):
    return (
        spark.createDataFrame([(a, b, at(c), "clash") for a, b, c in sales], "sale_id long, client_id long, sold_at timestamp_ntz, s string"),
        spark.createDataFrame([(a, at(b), "clash") for a, b in lines], "sale_id long, shipped_at timestamp_ntz, e string"),
        spark.createDataFrame([(a, at(b), c, "clash") for a, b, c in clicks], "client_id long, ts timestamp_ntz, kind string, crc string"),
    )


def by_sql(sales, lines, clicks):
    con = duckdb.connect()
    con.execute("create table sales (sale_id bigint, client_id bigint, sold_at timestamp)")
    con.execute("create table sale_lines (sale_id bigint, shipped_at timestamp)")
    con.execute("create table clicks (client_id bigint, ts timestamp, kind varchar)")
    for name, rows, marks in (("sales", [(a, b, at(c)) for a, b, c in sales], "?, ?, ?"), ("sale_lines", [(a, at(b)) for a, b in lines], "?, ?"), ("clicks", [(a, at(b), c) for a, b, c in clicks], "?, ?, ?")):
        if rows:
            con.executemany(f"insert into {name} values ({marks})", rows)
    return sorted(con.execute(OP12_SQL).fetchall(), key=repr)


@pytest.mark.parametrize("partitions", [1, 4, 29])
def test_overlaps_of_odd_rows(spark, partitions):
    """A third of all rows of one client and one slot, nulls, open ends, repeated rows, sessions and sales over many partitions."""
    rnd = random.Random(partitions)
    client = lambda: rnd.choice([7, None, rnd.randrange(6)]) if rnd.random() < 0.5 else rnd.randrange(6)
    when = lambda days: None if rnd.random() < 0.03 else rnd.choice([3600 * rnd.randrange(24 * days), rnd.randrange(86400 * days), 3600 * 30])
    sales = [(None if k % 50 == 0 else k % 330, client(), when(12)) for k in range(400)]
    lines = [(rnd.choice([None, 5, rnd.randrange(400)]), None if rnd.random() < 0.1 else when(20)) for _ in range(700)]
    clicks = [(client(), when(14), rnd.choice(["view", "purchase", None, "view"])) for _ in range(900)]
    start = 86400 * 3
    for k in range(900):  # one session of the hot client that lasts for days, and one that begins before 1970
        clicks.append((7, start + 500 * k, "view"))
    clicks += [(3, -(10**10), "view"), (3, -(10**10) + 60, "purchase"), *clicks[:40]]
    sales += [(1000, 3, -(10**10) + 5), (2000, 99, 86400 + 1800), *sales[:30]]
    clicks += [(99, 86400 + k, "view") for k in (-900, -400, 100)]  # a session that sale 2000 outlasts and starts in the last slot of
    lines.append((2000, 86400 * 19))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = sorted(map(tuple, interval_join.overlap_join(*shop(spark, sales, lines, clicks)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = by_sql(sales, lines, clicks)
    assert got == want and {r[1] for r in want} >= {"contains", "overlaps", "finished_by", "during", "finishes", "overlapped_by", "started_by"}


def test_overlaps_of_empty_tables(spark):
    tables = shop(spark, [(1, 2, 0)], [(1, 50)], [(2, 10, "view")])
    none = tuple(t.where("false") for t in tables)
    assert [tuple(r) for r in interval_join.overlap_join(*tables).collect()] == by_sql([(1, 2, 0)], [(1, 50)], [(2, 10, "view")])
    for k in range(3):
        mixed = [none[j] if j == k else tables[j] for j in range(3)]
        assert interval_join.overlap_join(*mixed).count() == (1 if k == 1 else 0)


def test_microseconds_do_not_depend_on_the_zone(spark):
    stamps = [datetime.datetime(2024, 3, 10, 2, 30, 0, 1), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(2024, 11, 3, 1, 30)]
    df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r.us for r in df.select(interval_join.micros(df, "ts").alias("us")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1) for t in stamps]


def test_crc_of_exact_first_timestamps(spark):
    (row,) = interval_join.overlap_join(*shop(spark, [(1, 2, 0)], [], [(2, 10, "view"), (2, 15, "purchase"), (2, 15, "view")])).collect()
    assert tuple(row) == (1, "starts", 1, 1, zlib.crc32(str((datetime.datetime(2024, 1, 1, 0, 0, 10) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)).encode()))


# -- 13


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: k for k, t in enumerate(byte_bpe.read_ranks(path))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Codec(path, public_tokenizers.PATTERN)


def test_ids_of_random_texts(plain):
    theirs, ours = plain
    rnd = random.Random(1)
    kinds = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(0xD800), lambda: rnd.randrange(0xE000, 0x110000), lambda: rnd.randrange(0x370, 0x600), lambda: rnd.choice([9, 10, 32, 160, 0x3000, 0x85, 0x1C, 0x2581])]
    for _ in range(3000):
        text = "".join(chr(rnd.choice(kinds)()) for _ in range(rnd.randint(0, 40)))
        ids = ours.encode(text)
        assert ids.tolist() == theirs.encode_ordinary(text) and ours.decode(ids).decode() == text


def test_letters_and_digits_are_those_of_tiktoken(plain):
    theirs, ours = plain
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for join in ("a{}b", "1{}2", " {}!"):
        text = "\n".join(join.format(c) for c in every)
        assert ours.encode(text).tolist() == theirs.encode_ordinary(text)


def test_chunks_windows_and_memory_of_words(plain, monkeypatch):
    theirs, ours = plain
    rnd = random.Random(2)
    monkeypatch.setattr(byte_bpe, "WINDOW", 40)
    monkeypatch.setattr(byte_bpe, "CHUNK", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    monkeypatch.setattr(byte_bpe, "WHOLE", 300)
    for _ in range(1500):
        alphabet = rnd.choice(["ab", "aaab", "abcdefghij", "éàab", "aAbBcC", "01", "-=+*", "thequickbrown ", " \n\t"])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 600)))
        assert ours.encode(text).tolist() == theirs.encode_ordinary(text)


def test_encoding_edges(spark):
    rows = [(1, None), (2, ""), (None, "alpha beta"), (None, None), (3, "ä é \U0001f600 ß"), (3, "ä é \U0001f600 ß"), (4, "x" * 200_000 + " y" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("data", F.lit("clash"))
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(df)).collect()
    assert sorted(((r.doc_id, bytes(r.data).decode()) for r in got), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert all((len(r.ids) > 0) == (len(r.data) > 0) for r in got)
    assert byte_bpe.encode_documents(df.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.data) for r in byte_bpe.decode_documents(odd).collect()) == [(1, None), (2, b"")]
    with pytest.raises(Exception, match="beyond the vocabulary"):
        byte_bpe.decode_documents(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")).collect()


def test_rank_file_needs_all_bytes(tmp_path):
    path = tmp_path / "r.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="lacks single bytes"):
        byte_bpe.read_ranks(str(path))
