"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators import aggregates as ag, spaces as vs
from cadenza.sources import sinks
from cadenza.sources.tables import audio_vector, songs, table
from cadenza.workload import sqlparts as sp
from cadenza.workload.catalog import PART_KEY, TARGET_SQL, part_target
from cadenza.workload.registry import query
from cadenza.workload.similarity import AUDIO_STD


@query("e1_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05 AND l_quantity < 10) AS small_discounted FROM lineitem")
def e1(spark, sf):
    return ag.counts(
        table(spark, sf, "lineitem"), returned=F.col("l_returnflag") == "R",
        small_discounted=(F.col("l_discount") > 0.05) & (F.col("l_quantity") < 10),
    )


@query(
    "e2_cache_statistics",
    "SELECT count(*) AS total, count(props) AS with_url, count(*) FILTER (WHERE event_type <> 'error') AS valid, count(*) FILTER (WHERE event_type = 'error') AS invalid FROM events",
)
def e2(spark, sf):
    status = F.when(F.col("event_type") == "error", "invalid").otherwise("valid")
    return ag.counts(table(spark, sf, "events"), with_url=F.col("props").isNotNull(), valid=status == "valid", invalid=status == "invalid")


@query(
    "e3_catalog_quality",
    "SELECT count(*) AS total, count(*) < 18000 AS below_expected, count(*) FILTER (WHERE p_size = 7) AS missing_required, count(*) FILTER (WHERE p_retailprice < 1000) AS with_features, bool_or(p_name = 'hot ring') AS fuzzy_hit FROM part",
)
def e3(spark, sf):
    catalog = table(spark, sf, "part").select(
        F.when(F.col("p_size") != 7, F.col("p_name")).alias("track_name"), F.col("p_brand").alias("track_artist"), "p_retailprice"
    )
    return ag.catalog_quality(catalog, F.col("p_retailprice") < 1000, probe="hot ring")


@query(
    "e4_load_report",
    f"""WITH {TARGET_SQL}, d AS (SELECT DISTINCT p_name, p_brand FROM part), i AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.p_name = d.p_name AND t.p_brand = d.p_brand))
    SELECT 'input' AS stage, count(*) AS rows FROM part UNION ALL SELECT 'errors', count(*) FROM part WHERE p_size % 7 = 3 UNION ALL SELECT 'deduplicated', count(*) FROM d UNION ALL SELECT 'inserted', count(*) FROM i
    UNION ALL SELECT 'final', (SELECT count(*) FROM target) + (SELECT count(*) FROM i)""",
)
def e4(spark, sf):
    part, target = table(spark, sf, "part"), part_target(spark, sf)
    fresh = sinks.append_new(target, part, "p_partkey", PART_KEY)
    # Sizes as they come from a file: some are no numbers.
    raw = part.select(F.when(F.col("p_size") % 7 == 3, F.concat("p_size", F.lit(" in"))).otherwise(F.col("p_size").cast("string")).alias("size"))
    return ag.load_report(
        input=part, errors=ag.unparsed(raw, ["size"]), deduplicated=part.select(*PART_KEY).distinct(), inserted=fresh, final=target.unionByName(fresh)
    )


@query("e8_column_statistics", f"WITH {sp.SONGS}, {AUDIO_STD} SELECT (i - 1)::INTEGER AS component, round(m, 6) AS mean, round(s, 6) AS std FROM a_c")
def e8(spark, sf):
    stats = vs.vector_stats(songs(spark, sf).select(audio_vector().alias("v")), ["v"])
    long = stats.select(F.posexplode(F.arrays_zip("v.mean", "v.scale")).alias("component", "z"))
    return long.select("component", F.round("z.mean", 6).alias("mean"), F.round("z.scale", 6).alias("std"))


@query(
    "e9_keep_first",
    "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part p WHERE p_partkey = (SELECT min(p_partkey) FROM part q WHERE q.p_name = p.p_name AND q.p_brand = p.p_brand)",
)
def e9(spark, sf):
    return sinks.first_per_key(table(spark, sf, "part"), PART_KEY, "p_partkey").select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query(
    "e10_recent_ids",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY",
)
def e10(spark, sf):
    orders = table(spark, sf, "orders")
    latest = orders.agg(F.max("o_orderdate").alias("m")).scalar()
    return orders.where(F.col("o_orderdate") > latest - F.expr("INTERVAL 30 DAYS")).select("o_custkey").distinct()


@query(
    "e11_document_frequency",
    f"""SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({sp.word_tokens('text')}) AS term FROM documents) GROUP BY term
    HAVING count(*) >= 10 AND count(*) <= 0.4::DOUBLE * (SELECT count(*) FROM documents)""",
)
def e11(spark, sf):
    docs = table(spark, sf, "documents").select(tx.words(F.col("text")).alias("tokens"))
    return ag.document_frequency(docs, "tokens")


@query(
    "e13_track_aggregates",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT *, e[13:32] AS mfcc, list_filter(e[33:64], lambda x: x > 0) AS beats FROM v)
    SELECT vec_id, round(abs(e[1]), 6) AS energy, round(abs(e[2]), 6) AS harmonicity, round(len(beats) / CASE WHEN label > 0 THEN label ELSE 30 END::DOUBLE, 6) AS rhythm_strength,
    round(list_aggregate(mfcc, 'stddev_pop'), 6) AS complexity FROM m""",
)
def e13(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    beats = F.filter(F.slice("e", 33, 32), lambda x: x > 0)
    made = ag.track_aggregates(F.get("e", F.lit(0)), F.get("e", F.lit(1)), beats, F.slice("e", 13, 20), F.col("label"))
    return v.select("vec_id", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query(
    "e14_mean_pooling",
    f"""WITH t AS (SELECT doc_id, unnest({sp.word_tokens('text')}) AS term FROM documents), vocab AS (SELECT term FROM t GROUP BY term HAVING count(DISTINCT doc_id) BETWEEN 10 AND 0.4::DOUBLE * (SELECT count(*) FROM documents)),
    vectors AS (SELECT term, embedding FROM vocab JOIN embeddings ON vec_id = (length(term) * 31 + unicode(term)) % (SELECT count(*) FROM embeddings)),
    x AS (SELECT doc_id, i, avg(v) AS m FROM (SELECT doc_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM t JOIN vectors USING (term)) GROUP BY ALL),
    p AS (SELECT doc_id, list(round(m, 6) ORDER BY i) AS m FROM x GROUP BY doc_id)
    SELECT doc_id, coalesce(m, list_transform(range(64), lambda z: 0.0::DOUBLE)) AS vector FROM documents LEFT JOIN p USING (doc_id)""",
)
def e14(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("tokens"))
    vocabulary = ag.document_frequency(docs, "tokens").select("term")
    vectors = table(spark, sf, "embeddings")
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    at = F.pmod(F.length("term") * 31 + F.ascii("term"), n)
    given = vocabulary.withColumn("vec_id", at).join(vectors, "vec_id").select(
        "term", F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )
    pooled = ag.mean_pooled(docs, "doc_id", "tokens", given, 64)
    return pooled.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("i6_standardised_columns", f"WITH {sp.SONGS}, {AUDIO_STD} SELECT song_id, list_transform(v, lambda x: round(x, 6)) AS v FROM a")
def i6(spark, sf):
    space = vs.standardised(songs(spark, sf).select("song_id", audio_vector().alias("v")), ["v"])
    return space.select("song_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))
