"""The numbered queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import (
    bag_search, class_lm, disclosure, longest_match, minhash_join, multi_index, packing, piece_viterbi, quality_rules,
    sharding, url_filter, vector_codes, weak_labels,
)
from cadenza.llm.tables import given

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_PATTERN = public_tokenizers.PATTERN
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 8

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(action, host, path)")
    pages = given(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op2_url_filter"] = """
WITH rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM rest),
placed AS (
  SELECT r, page_id,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM split),
met AS (
  SELECT r, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM placed JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM placed LEFT JOIN (SELECT * FROM met WHERE n = 1) USING (r)
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(given(spark, sf_dir, "documents"), BYTE_RANKS, BYTE_PATTERN, BYTE_TOKENIZER)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(given(spark, sf_dir, "documents"), PIECES)


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(given(spark, sf_dir, "documents"), [1.0] * SHARDS)


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify_documents(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(given(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_match.count_tokens(given(spark, sf_dir, "documents"), PIECES, spell=True)


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.encode_documents(given(spark, sf_dir, "documents"), PIECES)


@query
def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(given(spark, sf_dir, "documents"))


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(given(spark, sf_dir, "embeddings"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(given(spark, sf_dir, "embeddings"))


def codes_sql(rounds: int = vector_codes.ROUNDS, parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES) -> str:
    """The codebooks' rounds one after the other, every part against every entry."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT r, part.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM part JOIN book{n} USING (p)) GROUP BY r, p)""")
        if n < rounds:
            steps.append(f"""mean{n} AS (
  SELECT p, e, list(c ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS c FROM (
      SELECT p, e, unnest(range(len(x))) AS i, unnest(x) AS v FROM near{n} JOIN part USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
book{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{n}.c, book{n}.c) AS c FROM book{n} LEFT JOIN mean{n} USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(1024::DOUBLE * x) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= {entries}),
{", ".join(steps)},
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


ORACLES["op11_vector_codes"] = codes_sql()


@query
def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))


TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op12_bag_search"] = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS terms FROM documents WHERE text IS NOT NULL),
filled AS (SELECT r, doc_id, terms, len(terms) AS n FROM doc WHERE len(terms) > 0),
stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM filled),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM filled) GROUP BY ALL),
asked AS (
  SELECT i, term, count(*) AS q FROM (
    SELECT row_number() OVER () AS i, unnest({TERMS_SQL}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
item AS (SELECT row_number() OVER () AS i, item_id FROM benchmark WHERE text IS NOT NULL),
scored AS (
  SELECT i, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN filled USING (r), stats GROUP BY i, r),
ranked AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
  FROM scored JOIN filled USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN item USING (i) WHERE rank <= 20
"""


@query
def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(disclosure.find_personal_data(given(spark, sf_dir, "documents")))
