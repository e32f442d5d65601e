"""Sources and sinks: tables written in a format and read back, compared with what went in."""

import numpy as np
from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.sources import records as S
from quern.storage import shared_dir


@query("s1_pruned_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1")
def s1(t):
    return t("lineitem").where("l_discount >= 0.05").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("s2_whole_table", "SELECT n_name, n_regionkey FROM nation")
def s2(t):
    """A small table in pandas, and back."""
    held = S.to_pandas(t("nation"), ["n_name", "n_regionkey"])
    return t("nation").sparkSession.createDataFrame(held, "n_name string, n_regionkey int")


@query("s4_typed_rows", "SELECT CAST(k AS INTEGER) AS r_regionkey, n AS r_name FROM (VALUES (90, 'NORTH'), (91, NULL), (NULL, '')) v(k, n)")
def s4(t):
    """Rows of the driver written with a table's schema."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/rows"
    S.write_rows(spark, [(90, "NORTH"), (91, None), (None, "")], t("region").schema, path)
    return S.read_parquet(spark, path, ["r_regionkey", "r_name"])


@query("s14_range_strings", "SELECT p_partkey, p_name FROM part WHERE p_retailprice BETWEEN 905 AND 907 OR p_retailprice BETWEEN 950 AND 951")
def s14(t):
    """Strings by merged ranges of a sorted table, each a contiguous read."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/sorted"
    S.write_parquet(t("part").select("p_partkey", "p_name", "p_retailprice"), path, sort=["p_retailprice"])
    return S.read_ranges(spark, path, "p_retailprice", [(950.0, 951.0), (905.0, 906.0), (905.5, 907.0)], ["p_partkey", "p_name"])


@query("s3_parquet_round_trip", "SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def s3(t):
    """A sorted, filtered copy with a borrowed schema; later range filters prune its row groups."""
    df = t("orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice")
    path = f"{shared_dir(df.sparkSession)}/orders"
    like = df.select("o_orderkey", F.col("o_totalprice").cast("float").alias("o_totalprice")).schema
    S.write_parquet(df, path, like, ["o_totalprice"])
    return S.read_parquet(df.sparkSession, path, ["o_orderkey", "o_totalprice"])


@query("s5_binary_heads", "SELECT CAST(p_partkey AS INTEGER) AS mol, CAST(p_size AS INTEGER) AS n, CAST(p_size % 10 AS INTEGER) AS category, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size % 5 AS INTEGER) END AS instrument FROM part")
def s5(t):
    """Fixed-width headers in binary files, read by byte ranges; unknown instruments survive."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/heads"
    S.write_heads(heads(t), path)
    return S.read_heads(spark, path).select("mol", "n", "category", "instrument")


def heads(t):
    size = F.col("p_size").cast("int")
    key = F.col("p_partkey").cast("int")
    known = F.when(F.col("p_size") % 3 != 0, size % 5)
    return t("part").select((key / 2).alias("precursor"), key.alias("mol"), F.lit(0).alias("off"), size.alias("n"), (size % 10).alias("category"), known.alias("instrument"))


@query("s6_binary_sink", "SELECT CAST(20 * count(*) AS BIGINT) AS n_bytes, CAST(count(*) AS BIGINT) AS n_heads FROM part")
def s6(t):
    """Headers of a fixed width as files, counted by their bytes and by their records."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/heads"
    S.write_heads(heads(t), path)
    files = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
    return files.crossJoin(S.read_heads(spark, path).agg(F.count("*").alias("n_heads")))  # one row each


@query("s7_named_lines", "SELECT n_nationkey AS number, 'N' || n_nationkey AS name, n_name AS rest FROM nation")
def s7(t):
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/names"
    t("nation").orderBy("n_nationkey").coalesce(1).select(F.concat_ws("\t", F.concat(F.lit("N"), "n_nationkey"), "n_name")).write.text(path)
    return S.read_named_lines(spark, path).select(F.col("number").cast("int").alias("number"), "name", "rest")


@query("s8_last_field", "SELECT p_partkey AS id, p_retailprice AS value FROM part")
def s8(t):
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/fields"
    four = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", "p_type", F.col("p_retailprice").cast("string"))
    two = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string"))
    t("part").select(F.when(F.col("p_partkey") % 2 == 0, two).otherwise(four)).write.text(path)
    return S.read_last_field(spark, path)


@query("s9_csv_quoted", "SELECT page_id, url || ',\"x\"' AS url FROM pages")
def s9(t):
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/csv"
    t("pages").select(F.lit("unused").alias("extra"), F.concat("url", F.lit(',"x"')).alias("url"), "page_id").write.option("header", True).option("escape", '"').csv(path)
    return S.read_csv(spark, path, "page_id long, url string")


@query("s10_ion_records", """
SELECT CAST(o_custkey AS VARCHAR) AS spectrumid, CAST(count(*) AS BIGINT) AS n_peaks, round(sum(o_totalprice), 3) AS total, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'M+H' END AS adduct FROM orders GROUP BY o_custkey
""")
def s10(t):
    """Records of key lines and peak lines, split by the text reader."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/ions"
    peaks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda p: F.concat_ws(" ", p.o_orderkey.cast("string"), p.o_totalprice.cast("decimal(18,6)").cast("string"))), "\n")
    rows = t("orders").groupBy("o_custkey").agg(peaks.alias("p"))
    adduct = F.when(F.col("o_custkey") % 4 == 0, F.lit("")).otherwise(F.lit("ADDUCT=M+H\n"))
    rows.select(F.concat(F.lit("BEGIN IONS\nSPECTRUMID="), F.col("o_custkey").cast("string"), F.lit("\n"), adduct, F.col("p"), F.lit("\nEND IONS\n"))).write.text(path)
    got = S.read_ion_records(spark, path, ["SPECTRUMID", "ADDUCT"])
    return got.select("spectrumid", F.size("peaks").cast("long").alias("n_peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p.y), 3).alias("total"), "adduct")


@query("s11_grouped_dump", """
WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS candidate, o_orderkey, o_orderstatus FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS query, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 0 END AS truth, candidate, CAST(o_orderkey AS DOUBLE) AS f0, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) END AS f1 FROM r
""")
def s11(t):
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/dumps"
    f1 = F.when(F.col("o_orderstatus") == "P", "x").otherwise((F.col("o_orderkey") % 10).cast("string"))
    line = F.struct("o_orderkey", F.concat_ws(" ", F.col("o_orderkey").cast("string"), f1).alias("l"))
    rows = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    head = F.concat_ws(" ", F.lit("Q"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 5 == 0, "-1").otherwise("0"), F.size("ls").cast("string"))
    rows.select(F.concat_ws("\n", head, F.array_join(F.transform("ls", lambda x: x.l), "\n"))).write.text(path)
    return S.read_dumps(spark, path, ["f0", "f1"]).withColumn("truth", F.col("truth").cast("int"))


@query("s12_sparse_bits", "SELECT vec_id AS row, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings")
def s12(t):
    """Sparse bit rows as 16-bit numbers in binary files, found through a sidecar of their places."""
    df = t("embeddings").select(F.col("vec_id").alias("row"), F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()).alias("values"))
    path = f"{shared_dir(df.sparkSession)}/bits"
    S.write_bit_rows(df, path)
    return S.read_bit_places(df.sparkSession, path).select("row", F.size("values").cast("long").alias("n"))


@query("s15_ranked_csv", """
SELECT p_brand, place, CAST(p_partkey AS VARCHAR) AS item FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 25
""")
def s15(t):
    """Lists joined in a CSV cell and read back with their places."""
    lists = t("part").groupBy("p_brand").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("s"), "p_partkey"))), lambda x: x.p_partkey), 1, 25).alias("items"))
    path = f"{shared_dir(lists.sparkSession)}/ranked"
    S.write_ranked_csv(lists, path, "p_brand", ["items"])
    return S.read_ranked_csv(lists.sparkSession, path, "p_brand", "items").select("p_brand", "place", "item")


@query("s16_aligned_lists", """
SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ';' ORDER BY p_partkey) AS items, string_agg(CAST(p_size AS VARCHAR), ';' ORDER BY p_partkey) AS sizes FROM part GROUP BY 1
""")
def s16(t):
    rows = t("part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("l"))
    lists = rows.select("p_brand", F.transform("l", lambda x: x.p_partkey).alias("items"), F.transform("l", lambda x: x.p_size).alias("sizes"))
    path = f"{shared_dir(lists.sparkSession)}/aligned"
    S.write_ranked_csv(lists, path, "p_brand", ["items", "sizes"])
    return S.read_csv(lists.sparkSession, path, "p_brand string, items string, sizes string")


@query("s17_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s17(t):
    df = t("events").select("event_id", F.from_json("props", "k long").alias("p"))
    path = f"{shared_dir(df.sparkSession)}/json"
    df.select("event_id", F.to_json("p").alias("p")).write.json(path)
    return df.sparkSession.read.schema("event_id long, p string").json(path).select("event_id", F.from_json("p", "k long").k.alias("k"))


@query("s18_file_discovery", "SELECT 3 AS n_files, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM nation UNION ALL SELECT count(*) FROM region UNION ALL SELECT count(*) FROM region)")
def s18(t):
    """Files of one name at several depths, found by bounded patterns and read as one table."""
    spark = t("region").sparkSession
    root = shared_dir(spark)
    for folder, table in (("a", "nation"), ("b/c", "region"), ("d/e/f", "region")):
        t(table).select(F.lit(table).alias("name")).coalesce(1).write.csv(f"{root}/{folder}")
    files = S.find_files(spark, root, "part-*.csv", 3)
    return files.agg(F.count("*").cast("int").alias("n_files"), F.lit(spark.read.csv([r.path for r in files.select("path").collect()]).count()).cast("long").alias("n_rows"))


@query("s19_folder_digest", """
WITH c AS (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS content FROM nation)
SELECT CAST(1 AS BIGINT) AS files, sha256(substr(sha256('names.txt'), 1, 2) || ':' || sha256('9:names.txt:' || strlen(content) || ':' || sha256(content))) AS digest FROM c
""")
def s19(t):
    """The digest of a folder does not depend on which task wrote or read what."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/folder"
    t("nation").orderBy("n_nationkey").coalesce(1).select("n_name").write.text(path)
    (part,) = S.find_files(spark, path, "part-*.txt", 0).collect()
    at = spark._jvm.org.apache.hadoop.fs.Path
    at(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(at(part.path), at(f"{path}/names.txt"))
    return S.folder_digest(spark, path)


@query("s20_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def s20(t):
    return S.value_counts(t("orders"), "o_orderpriority")


@query("s21_range_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 201000")
def s21(t):
    return t("orders").where("o_totalprice >= 200000 AND o_totalprice < 201000").select("o_orderkey", "o_totalprice")


PRICED = np.dtype([("o_orderkey", "<i8"), ("o_totalprice", "<f8")])


@query("s21_binary_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 201000")
def s21_binary(t):
    """A range of a binary file that is sorted by a column, found by bisection."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/priced"
    S.write_records(t("orders").where("o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL").select("o_orderkey", "o_totalprice").repartitionByRange("o_totalprice").sortWithinPartitions("o_totalprice"), path, PRICED)
    return S.read_records(spark, path, PRICED, ranges={"o_totalprice": (200_000.0, 201_000.0)}, sorted_by="o_totalprice").where("o_totalprice < 201000")


NAMED = np.dtype([("p_partkey", "<i8"), ("p_retailprice", "<f8"), ("at", "<i8"), ("n", "<i4")])


@query("s14_offset_strings", "SELECT p_partkey, p_name FROM part WHERE p_retailprice BETWEEN 905 AND 907 OR p_retailprice BETWEEN 950 AND 951")
def s14_offsets(t):
    """Strings in one binary file, read by the places that a sorted sidecar gives for two ranges."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark)}/named"
    df = t("part").where("p_name IS NOT NULL").select("p_partkey", "p_retailprice", F.col("p_name").alias("values"))
    S.write_lists(df.repartitionByRange("p_retailprice").sortWithinPartitions("p_retailprice"), f"{path}/places", NAMED, f"{path}/names", "u1", "at", "n", text=True)
    read = lambda low, high: S.read_lists(spark, f"{path}/places", NAMED, f"{path}/names", "u1", "at", "n", text=True, columns=["p_partkey"], ranges={"p_retailprice": (low, high)}, sorted_by="p_retailprice")
    return read(905.0, 907.0).unionAll(read(950.0, 951.0)).select("p_partkey", F.col("values").alias("p_name"))
