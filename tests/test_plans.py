"""The physical strategies the design relies on."""

import pytest

from cadenza.sources.tables import table
from cadenza.workload.registry import QUERIES, load_all

load_all()


def plan_of(df, run=False):
    if run:
        df.collect()
        return df._jdf.queryExecution().executedPlan().finalPhysicalPlan().treeString()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_two_columns_and_pushes_the_filter(spark, sf):
    from cadenza.sources.catalog import scan_features

    plan = plan_of(scan_features(table(spark, sf, "embeddings"), "vec_id", "embedding"))
    assert "PushedFilters: [IsNotNull(embedding)]" in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


@pytest.mark.parametrize("name", ["g2_top_k_per_key", "f3_last_write_wins", "e9_keep_first", "t1_fixed_window_quota", "d1_audio_similarity"])
def test_ranks_are_limited_before_the_shuffle(spark, sf, name):
    lines = plan_of(QUERIES[name](spark, sf)).splitlines()
    final = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Final" in line)
    partial = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    assert any("Exchange" in line for line in lines[final:partial])


@pytest.mark.parametrize("name", ["g1_top_k", "g4_page_with_total", "b6_substring_search"])
def test_pages_take_ordered(spark, sf, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sf))


def test_lyrics_meet_by_the_seeds_terms(spark, sf):
    from cadenza.plans import similar
    from cadenza.workload.inputs import song_features
    from cadenza.workload.recommend import leads

    features = song_features(spark, sf)
    plan = plan_of(similar.score_pairs(features, leads(features)), run=True)
    # The catalog is scanned once for its numbers and once for its terms. A small request's postings
    # meet the terms in place, and a pair's sums combine before they are shuffled.
    assert plan.count("Scan parquet") == 4 and "BroadcastHashJoin" in plan
    assert "hashpartitioning(term" not in plan and "map_zip_with" not in plan
    assert "partial_sum" in plan and "hashpartitioning(seed_id" in plan


def test_term_counts_shuffle_nothing(spark, sf):
    from cadenza.operators.scoring import with_terms

    assert "Exchange" not in plan_of(with_terms(table(spark, sf, "documents"), "text"))


def test_sentiment_shuffles_once(spark, sf):
    from cadenza.operators.sentiment import lexicon_sentiment
    from cadenza.workload.inputs import feature_lexicon

    df = lexicon_sentiment(table(spark, sf, "documents"), "doc_id", "text", feature_lexicon(spark, sf))
    plan = plan_of(df)
    assert plan.count("BroadcastHashJoin") == 4 and plan.count("Exchange hashpartitioning(doc_id") == 1


def test_duplicates_block_before_they_fetch_terms(spark, sf):
    plan = plan_of(QUERIES["d31_find_duplicates"](spark, sf), run=True)
    assert plan.count("Scan parquet") < 6 and "Python" not in plan and "Arrow" not in plan


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from cadenza.session import work_root

    def session(master, folder=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default),
            sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
        )

    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="shared folder"):
            work_root(session(master))
        assert work_root(session(master, "hdfs://x")) == "hdfs://x"
    assert work_root(session("local[4]")) and work_root(session("local[*]"))
