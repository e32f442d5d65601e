"""DuckDB SQL for SimHash components: XXH64 by whole-number arithmetic, bits by sums, components by reachability."""

from __future__ import annotations

# The five primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
MODULUS = 1 << 64


def _number(x: int) -> str:
    return f"{x}::UHUGEINT"


def _times(a: str, p: int) -> str:
    return f"(({a}) * {_number(p)} % {_number(MODULUS)})"


def _rotated(x: str, bits: int) -> str:
    return f"(({x}) * {_number(1 << bits)} % {_number(MODULUS)} + ({x}) // {_number(1 << (64 - bits))})"


def _round(state: str, lane: str) -> str:
    return _times(_rotated(f"(({state}) + {_times(lane, PRIMES[1])}) % {_number(MODULUS)}", 31), PRIMES[0])


def _merged(h: str, state: str) -> str:
    return f"(xor({h}, {_round('0::UHUGEINT', state)}) * {_number(PRIMES[0])} + {_number(PRIMES[3])}) % {_number(MODULUS)}"


def _lane(start: str, size: int) -> str:
    """A little-endian number of `size` bytes; r: the text's bytes from the last to the first, in hexadecimal."""
    return f"('0x' || substr(r, 2 * (n - ({start}) - {size}) + 1, {2 * size}))::UBIGINT::UHUGEINT"


def xxh64_sql(source: str, seed: int = 42) -> str:
    """Common table expressions that end with x (shingle, h): the XXH64 of each distinct shingle of a source."""
    p1, p2, p3, _, p5 = PRIMES
    states = [(seed + p1 + p2) % MODULUS, (seed + p2) % MODULUS, seed, (seed - p1) % MODULUS]
    stripes = ", ".join(
        f"list_reduce(list_prepend({_number(s)}, list_transform(range(n // 32), lambda k: {_lane(f'32 * k + {8 * i}', 8)})), lambda a, k: {_round('a', 'k')}) AS v{i}" for i, s in enumerate(states)
    )
    joined = " + ".join(_rotated(f"v{i}", bits) for i, bits in enumerate((1, 7, 12, 18)))
    eight = f"({_rotated('xor(a, ' + _round('0::UHUGEINT', 'k') + ')', 27)} * {_number(p1)} + {_number(PRIMES[3])}) % {_number(MODULUS)}"
    four = f"({_rotated('xor(h, ' + _times(_lane('o', 4), p1) + ')', 23)} * {_number(p2)} + {_number(p3)}) % {_number(MODULUS)}"
    single = _times(_rotated("xor(a, " + _times("k", p5) + ")", 11), p1)
    mixed = lambda shift: f"xor(h, h // {_number(1 << shift)})"
    return f"""b AS (
  SELECT shingle, octet_length(encode(shingle)) AS n, reverse(regexp_replace(hex(encode(shingle)), '(.)(.)', '\\2\\1', 'g')) AS r FROM (SELECT DISTINCT shingle FROM {source})
), v AS (
  SELECT shingle, n, r, {stripes} FROM b
), m0 AS (
  SELECT *, ({joined}) % {_number(MODULUS)} AS h FROM v
), m1 AS (
  SELECT * REPLACE ({_merged("h", "v0")} AS h) FROM m0
), m2 AS (
  SELECT * REPLACE ({_merged("h", "v1")} AS h) FROM m1
), m3 AS (
  SELECT * REPLACE ({_merged("h", "v2")} AS h) FROM m2
), m4 AS (
  SELECT * REPLACE ({_merged("h", "v3")} AS h) FROM m3
), t AS (
  SELECT shingle, n, r, n - n % 32 AS o, ((CASE WHEN n >= 32 THEN h ELSE {_number((seed + p5) % MODULUS)} END) + n::UHUGEINT) % {_number(MODULUS)} AS h FROM m4
), t8 AS (
  SELECT shingle, n, r, o + n % 32 // 8 * 8 AS o, list_reduce(list_prepend(h, list_transform(range(n % 32 // 8), lambda k: {_lane("o + 8 * k", 8)})), lambda a, k: {eight}) AS h FROM t
), t4 AS (
  SELECT shingle, n, r, o + n % 8 // 4 * 4 AS o, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM t8
), t1 AS (
  SELECT shingle, list_reduce(list_prepend(h, list_transform(range(n % 4), lambda k: {_lane("o + k", 1)})), lambda a, k: {single}) AS h FROM t4
), f1 AS (
  SELECT shingle, {_times(mixed(33), p2)} AS h FROM t1
), f2 AS (
  SELECT shingle, {_times(mixed(29), p3)} AS h FROM f1
), x AS (
  SELECT shingle, {mixed(32)}::UBIGINT AS h FROM f2
)"""


BITS = " + ".join(f"CASE WHEN 2 * sum(h >> {b} & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))

OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT rid, array_to_string(words[i:i + 3], ' ') AS shingle FROM (SELECT rid, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS i FROM d WHERE len(words) > 0)
), {xxh64_sql("s")}, p AS (
  SELECT rid, {BITS} AS fp FROM s JOIN x USING (shingle) GROUP BY rid
), g AS (
  SELECT d.rid, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN p USING (rid)
), k AS (
  SELECT fp, min(doc_id) AS least FROM g GROUP BY fp
), e AS (
  SELECT a.fp AS a, b.fp AS b FROM k a JOIN k b ON bit_count(xor(a.fp, b.fp)) <= 4
), reach AS (
  SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
), c AS (
  SELECT reach.a AS fp, min(least) AS component_id FROM reach JOIN k ON k.fp = reach.b GROUP BY 1
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM g JOIN c USING (fp)
"""
