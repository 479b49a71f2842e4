"""Windows, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import paging as pg, scoring as sc, search, spaces as vs
from cadenza.sources import sinks
from cadenza.sources.tables import table
from cadenza.workload import sqlparts as sp
from cadenza.workload.cleaning import part_catalog
from cadenza.workload.registry import query
from cadenza.workload.similarity import AUDIO_STD, KNN_SQL, STD_COSINE_SQL, TOP_SQL, audio_space


@query(
    "f3_last_write_wins",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def f3(spark, sf):
    return sinks.last_per_key(table(spark, sf, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(
    "f7_first_match",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'A') WHERE n = 1",
)
def f7(spark, sf):
    hits = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    return sc.top_k(hits, ["l_orderkey"], order, 1).drop("rank")


@query("g1_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def g1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query(
    "g2_top_k_per_key",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 3",
)
def g2(spark, sf):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return sc.top_k(table(spark, sf, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query(
    "g3_relevance_order",
    """SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_size END AS relevance FROM part ORDER BY relevance DESC NULLS LAST, p_name, p_partkey LIMIT 50""",
)
def g3(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_size")).alias("relevance"))
    return search.page(rows, [F.desc_nulls_last("relevance"), "p_name", "p_partkey"])


@query(
    "g4_page_with_total",
    "SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_name ILIKE '%ring%') AS total FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 10 OFFSET 20",
)
def g4(spark, sf):
    hits = search.filtered(part_catalog(spark, sf), text="ring")
    total = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    paged = search.page(hits, ["track_name", "song_id"], 20, 10)
    return paged.select(F.col("song_id").alias("p_partkey"), F.col("track_name").alias("p_name"), total.alias("total"))


@query(
    "g4_deep_page",
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice, place FROM o, (SELECT count(*) * 3 // 4 AS skipped FROM lineitem) WHERE place > skipped AND place <= skipped + 50""",
)
def g4_deep(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    kept = pg.paged(lines, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], range_rows=5000)
    return kept.page(kept.total * 3 // 4, 50).select("l_orderkey", "l_linenumber", "l_extendedprice", "place")


@query(
    "g5_union_of_lists",
    f"""WITH {sp.SONGS}, {sp.LEADS}, {AUDIO_STD}, {STD_COSINE_SQL}, {KNN_SQL} SELECT seed_id, song_id, score, 'knn' AS method FROM knn
    UNION ALL SELECT seed_id, song_id, score, 'cosine' AS method FROM (SELECT *, {TOP_SQL.format('score')} FROM cosines) WHERE rank <= 5""",
)
def g5(spark, sf):
    space, seeds = audio_space(spark, sf)
    knn = vs.euclid_neighbours(space, seeds, 10).select("seed_id", "song_id", "score", F.lit("knn").alias("method"))
    cosine = vs.cosine_neighbours(space, seeds, 5).select("seed_id", "song_id", "score", F.lit("cosine").alias("method"))
    return knn.unionByName(cosine)


@query(
    "g6_key_sets",
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O')
    SELECT id, 'both' AS part FROM a WHERE id IN (SELECT id FROM b) UNION ALL SELECT id, 'only F' AS part FROM a WHERE id NOT IN (SELECT id FROM b)""",
)
def g6(spark, sf):
    orders = table(spark, sf, "orders")
    ids = {s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")).distinct() for s in ("F", "O")}
    both = ids["F"].join(ids["O"], "id", "left_semi").withColumn("part", F.lit("both"))
    return both.unionByName(ids["F"].join(ids["O"], "id", "left_anti").withColumn("part", F.lit("only F")))
