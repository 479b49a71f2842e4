"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

A URL expands into (host suffix, path prefix) expressions, as browsers do for lists of
unsafe sites: every run of trailing host labels with every path prefix that ends in ``/``
(and the empty one). Expressions and rules meet in an equi-join on the first 32 bits of
their SHA-256 digests; a meeting counts only when the full digests agree. A rule whose path
does not end in ``/`` is keyed by its last such prefix, and the whole path is compared after
the digests, so any rule path works as a character prefix.

Only distinct (host, path) pairs are expanded, and only to the depth that some rule has:
deeper expressions cannot meet a rule. So a URL with very many labels or segments costs no
more than the rules call for. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.tables import ascii_lower, settle


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty for a null or a URL without ``://``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end (port and user
    name included), A-Z lower-cased; the path runs on to ``?``, ``#`` or the end.
    """
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw_host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = rest.substr(F.length(raw_host) + 1, F.length(rest))
    return pages.withColumns(
        {"host": ascii_lower(raw_host), "path": F.regexp_extract(after, "^[^?#]*", 0)}
    )


def _anchor(path: Column) -> Column:
    """The longest prefix that ends in ``/``, or nothing."""
    return F.regexp_extract(path, "(?s)^.*/", 0)


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), prefix), 256)


def _short(digest: Column) -> Column:
    """The first 32 bits, as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules (action, host, path) with the digest and short hash of host and anchor, and their depths.

    Host and path nulls count as empty; rules without a host or an action are no rules.
    """
    host = F.coalesce(ascii_lower(F.col("host")), F.lit(""))
    path = F.coalesce(F.col("path"), F.lit(""))
    clean = rules.select("action", host.alias("rule_host"), path.alias("rule_path")).where(
        F.col("action").isin("allow", "block") & (F.col("rule_host") != "")
    )
    digest = _digest(F.col("rule_host"), _anchor(F.col("rule_path")))
    return clean.distinct().select(
        "action", "rule_host", "rule_path", digest.alias("rule_digest"), _short(digest).alias("short"),
        F.size(F.split("rule_host", "[.]", -1)).alias("labels"),
        F.length(F.regexp_replace("rule_path", "[^/]", "")).alias("slashes"),
    )


def expressions(places: DataFrame, max_labels: int, max_slashes: int) -> DataFrame:
    """One row per (host suffix, path prefix) of each distinct (host, path), with its digest.

    ``max_labels`` and ``max_slashes`` are the deepest of the rules.
    """
    labels = F.split("host", "[.]", -1)
    # The path up to its k-th slash, for k = 0 (nothing) to the number of its slashes.
    slashes = F.length(F.regexp_replace("path", "[^/]", ""))
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max_labels))),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(slashes, F.lit(max_slashes))),
        lambda k: F.when(k == 0, "").otherwise(
            F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/"))
        ),
    )
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    return (
        places.where(F.col("host") != "")
        .select("host", "path", F.explode(pairs).alias("digest"))
        .withColumn("short", _short(F.col("digest")))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has (action, host, path); action is allow or block. A rule fits its host and
    all subdomains when the URL's path starts with the rule's. The longest rule (host and
    path together) wins; then the longer host, then block over allow. Without a rule,
    ``rule`` is null and the verdict is ``default``. Null, relative and empty URLs have an
    empty host and meet no rule. Repeated rows are judged alike and all kept; other columns
    pass through, but input columns named like the four results are replaced by them.

    The only values that reach the driver are the two depths of the rules.
    """
    located = with_host_and_path(pages.drop("host", "path", "rule", "verdict"), url)
    keyed = keyed_rules(rules)
    depth = keyed.agg(F.max("labels").alias("l"), F.max("slashes").alias("s")).first()
    if depth is None or depth["l"] is None:
        return located.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    places = located.select("host", "path").distinct()
    met = expressions(places, depth["l"], depth["s"]).join(keyed, "short").where(
        (F.col("digest") == F.col("rule_digest"))
        & F.startswith("path", "rule_path")
    )
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"),
        F.length("rule_host").alias("host_length"),
        F.col("action").alias("verdict"),  # "block" sorts after "allow"
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # Written, so that the join below deals out both sides itself and can split a hot URL.
    judged = settle(best.select("host", "path", "best.rule", "best.verdict"), "url-verdicts")
    return located.join(judged, ["host", "path"], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default))
    )
