"""SQL of the interval overlap join, by pairs."""

#: One row: the CRC-32 table as a list.
CRC_TABLE = """crc_table AS (
  SELECT list(t ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) b(i))
)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, beside crc_table."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


OP12_SQL = f"""
WITH {CRC_TABLE}, k AS (
  SELECT client_id, epoch_us(ts) AS us, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS buys
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
), n AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= 600000000 THEN 0 ELSE 1 END AS new FROM k
), r AS (
  SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM n
), x AS (
  SELECT client_id, min(us) AS first_us, CAST(floor(min(us) / 3600000000) AS BIGINT) AS a,
         CASE WHEN arg_max(buys, us) = 1 THEN 1000000000 ELSE CAST(floor(max(us) / 3600000000) AS BIGINT) END AS b
  FROM r GROUP BY client_id, run
), l AS (
  SELECT sale_id, max(epoch_us(shipped_at)) AS shipped, bool_or(shipped_at IS NULL) AS is_open FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id
), s AS (
  SELECT sale_id, client_id, CAST(floor(epoch_us(sold_at) / 3600000000) AS BIGINT) AS s,
         CASE WHEN is_open THEN 1000000000 ELSE CAST(floor(greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) / 3600000000) AS BIGINT) END AS e
  FROM sales LEFT JOIN l USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), p AS (
  SELECT sale_id, first_us, CASE WHEN e = 1000000000 AND b = 1000000000 THEN NULL ELSE least(b, e) - greatest(a, s) + 1 END AS slots,
         CASE WHEN s < a THEN CASE WHEN e < b THEN 'overlaps' WHEN e = b THEN 'finished_by' ELSE 'contains' END
              WHEN s = a THEN CASE WHEN e < b THEN 'starts' WHEN e = b THEN 'equals' ELSE 'started_by' END
              ELSE CASE WHEN e < b THEN 'during' WHEN e = b THEN 'finishes' ELSE 'overlapped_by' END END AS relation
  FROM s JOIN x USING (client_id) WHERE a <= e AND b >= s
), h AS (
  SELECT first_us, {crc32_sql("CAST(first_us AS VARCHAR)")} AS crc FROM (SELECT DISTINCT first_us FROM x), crc_table
)
SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(slots) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc
FROM p JOIN h USING (first_us) GROUP BY sale_id, relation
"""
