"""Information-theoretic sanitisation of personal data, with DataFrame functions alone.

Base spans (addresses, numbers) are protected entities: they always go. Other terms may still
reveal one of them, as a name does that is written beside the same telephone number again and
again. How strongly is estimated from the corpus. With probabilities over distinct lines, a
term ``t`` tells of an entity ``e``

    PMI(e; t) = log2(p(e, t) / (p(e) p(t)))    out of    IC(e) = -log2 p(e)

bits; the quotient is 1 where the term occurs beside the entity only. Terms whose quotient for
some entity reaches ``remove`` are removed, from ``generalise`` on they are generalised to the
kind of word they are, wherever they occur.

A line counts once, however often it is copied. A term is beside an entity when at most
``reach`` terms of the line lie between them, so the pairs of a line grow with its entities and
not with their product; and it must have been met there in ``support`` different contexts (the
terms before and after it), so that a chance meeting, or one passage with small changes, tells
nothing.

Positions come from what lies between matches: a text split at a pattern has one piece more
than matches, and sums of the lengths before a match are its start. The sums run over the
matches of a text, which are shuffled without the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.tables import ascii_lower, settle

#: Share of an entity's information from which a term is generalised or removed.
GENERALISE = 0.85
REMOVE = 0.95
#: Different contexts beside the entity that a term needs.
SUPPORT = 3
#: Terms on either side of an entity that are beside it.
REACH = 8

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("generalise", "remove")
#: A term: letters with what joins them, and digits after the first letter.
TERM = r"\p{L}[\p{L}\p{M}\p{N}]*+(?:['’\-][\p{L}\p{M}\p{N}]++)*+"

# The patterns of the base spans. Possessive repeats and the look behind give the same matches as
# the plain forms, which would try every start inside a long run, or one stack frame a repeat: no
# repeat could give back what its continuation needs, and where a run's first character (or the
# end of the match before) starts no match, none of the run's later characters does.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ \-]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
}
#: What a text must hold to have a match at all.
_MARKS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid last check digit."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def is_entity(kind: str, match: Column) -> Column:
    """Whether a match of a kind's pattern stands: parts at most 255, the right number of digits, a valid check digit."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    size = F.length(_digits(match))
    if kind == "card":
        return F.when(size.between(16, 19), passes_luhn(_digits(match))).otherwise(False)
    return size.between(8, 15) if kind == "phone" else F.lit(True)


def entity_name(kind: Column, match: Column) -> Column:
    """One name for all ways of writing an entity."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(match)).otherwise(ascii_lower(match)))


def may_match(kind: str, text: Column) -> Column:
    """A cheap test that no text with a match of the kind fails."""
    mark = _MARKS[kind]
    return text.rlike("[0-9][ \\-]?[0-9]") if mark is None else F.contains(text, F.lit(mark))


def pieces(text: Column, pattern: str, kind: str) -> Column:
    """One entry per match, in order, and one for the rest: (kind, i, skipped: characters before it, match or null)."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    # The matches are found once: inside a lambda function they would be found anew for every piece.
    both = F.arrays_zip(between.alias("skipped"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    entry = lambda part, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), part["skipped"].alias("skipped"), part["match"].alias("match")
    )
    return F.transform(both, entry)


def each_kind(text: Column, made) -> Column:
    """The entries that ``made`` gives for every kind the text may hold, in one array."""
    kinds = F.array(*(F.when(may_match(kind, text), made(kind)) for kind in KINDS))
    return F.flatten(F.filter(kinds, lambda entries: entries.isNotNull()))


@dataclass
class Texts:
    """Rows as (key, name, body): the hash of a text tells rows of one key apart; a null text is empty."""

    rows: DataFrame


def texts_of(docs: DataFrame, key: str, text: str) -> Texts:
    body = F.coalesce(F.col(text), F.lit(""))
    return Texts(docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("name"), body.alias("body")))


def placed(found: DataFrame) -> DataFrame:
    """(key, name, kind, match, start, end) from (key, name, part); positions in characters, end exclusive.

    Rows that repeat a key and a text count once.
    """
    once = found.where(F.col("part.match").isNotNull()).groupBy("key", "name", "part.kind", "part.i").agg(
        F.first("part.skipped").alias("skipped"), F.first("part.match").alias("match")
    )
    # One text's matches of one kind: bounded by the text.
    order = W.partitionBy("key", "name", "kind").orderBy("i")
    upto = F.sum(F.col("skipped") + F.length("match")).over(order.rowsBetween(W.unboundedPreceding, 0))
    ended = once.withColumn("end", upto.cast("long"))
    return ended.select("key", "name", "kind", "match", (F.col("end") - F.length("match")).alias("start"), "end")


def stands(kind: Column, match: Column) -> Column:
    """Whether a match of one of the kinds passes that kind's test."""
    out = F.lit(False)
    for name in KINDS:
        out = F.when(kind == name, is_entity(name, match)).otherwise(out)
    return out


def base_spans(texts: Texts) -> DataFrame:
    """(key, name, kind, match, start, end) of all base spans of the distinct texts of each key.

    Leftmost matches per kind that do not overlap; those that fail their kind's test are dropped.
    """
    parts = each_kind(F.col("body"), lambda kind: pieces(F.col("body"), PATTERNS[kind], kind))
    found = texts.rows.select("key", "name", F.explode(parts).alias("part"))
    return placed(found).where(stands(F.col("kind"), F.col("match")))


def distinct_lines(texts: Texts) -> DataFrame:
    """(line): every different line of all texts once."""
    return texts.rows.select(F.explode(F.split("body", "\n")).alias("line")).where(F.col("line") != "").distinct()


def terms_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def entity_mentions(lines: DataFrame, reach: int = REACH) -> DataFrame:
    """(line, entity, before, after): every mention with the ``reach`` + 1 terms on either side of it.

    The terms stop at the next match of the same kind.
    """

    def near(kind: str) -> Column:
        matches = F.regexp_extract_all("line", F.lit(PATTERNS[kind]), F.lit(0))
        # What lies between two matches follows the one and comes before the other.
        terms = F.transform(F.split("line", PATTERNS[kind], -1), terms_in)
        last = lambda side: F.slice(side, -F.greatest(F.lit(1), F.least(F.lit(reach + 1), F.size(side))), reach + 1)
        mentions = F.transform(
            F.arrays_zip(matches.alias("match"), terms.alias("before"), F.slice(terms, 2, 1 << 30).alias("after")),
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m["match"].alias("match"), last(m["before"]).alias("before"),
                F.slice(m["after"], 1, reach + 1).alias("after"),
            ),
        )
        return F.filter(mentions, lambda m: m["match"].isNotNull())

    able = lines.where(F.greatest(*(may_match(kind, F.col("line")) for kind in KINDS)))
    met = able.select(F.xxhash64("line").alias("line"), F.explode(each_kind(F.col("line"), near)).alias("at"))
    met = met.select("line", "at.*").where(stands(F.col("kind"), F.col("match")))
    return met.select("line", entity_name(F.col("kind"), F.col("match")).alias("entity"), "before", "after")


def entity_neighbours(mentions: DataFrame, reach: int = REACH) -> DataFrame:
    """(line, entity, term, context): every term beside an entity of a line, with a name for the terms around it."""

    def side(name: str, first: Column) -> Column:
        around = lambda i: F.coalesce(F.get(name, i), F.lit(""))
        named = F.transform(
            name, lambda term, i: F.struct(term.alias("term"), F.xxhash64(around(i - 1), around(i + 1)).alias("context"))
        )
        return F.slice(named, first, F.lit(reach))

    last = F.greatest(F.lit(1), F.size("before") - reach + 1)
    both = F.concat(side("before", last), side("after", F.lit(1)))
    return mentions.select("line", "entity", F.explode(both).alias("at")).select("line", "entity", "at.*")


def disclosures(
    texts: Texts, reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """(term, entity, pmi, information, share, action): terms that tell of an entity beyond the thresholds.

    One row per term: its most revealing entity.
    """
    lines = settle(distinct_lines(texts), "distinct-lines")
    total = lines.count()
    mentions = settle(entity_mentions(lines, reach), "entity-mentions")
    entities = mentions.select("entity", "line").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("entity_lines"))
    beside = entity_neighbours(mentions, reach).distinct()
    pairs = beside.groupBy("entity", "term").agg(
        F.count_distinct("line").alias("both_lines"), F.count_distinct("context").alias("contexts")
    )
    likely = settle(pairs.where(F.col("contexts") >= support).drop("contexts"), "likely-pairs")
    known = likely.select("term").distinct()
    words = lines.select(F.explode(F.array_distinct(terms_in(F.col("line")))).alias("term"))
    told = words.join(known, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("term_lines"))
    joined = likely.join(told, "term").join(entities, "entity")
    pmi = F.log2(F.col("both_lines") * F.lit(float(total)) / (F.col("entity_lines") * F.col("term_lines")))
    information = F.log2(F.lit(float(total)) / F.col("entity_lines"))
    scored = joined.select("term", "entity", pmi.alias("pmi"), information.alias("information"))
    # An entity on every line has no information to give away.
    shared = scored.where(F.col("information") > 0).withColumn("share", F.col("pmi") / F.col("information"))
    best = shared.where(F.col("share") >= generalise).groupBy("term").agg(
        F.max_by(F.struct("entity", "pmi", "information", "share"), F.struct("share", "entity")).alias("best")
    )
    action = F.when(F.col("best.share") >= remove, "remove").otherwise("generalise")
    return best.select("term", "best.*", action.alias("action"))


def term_spans(texts: Texts, told: DataFrame) -> DataFrame:
    """(key, name, kind, match, start, end) of every occurrence of the terms in ``told`` (term, action)."""
    words = texts.rows.select("key", "name", F.explode(F.array_distinct(terms_in(F.col("body")))).alias("term"))
    hits = words.join(told.select("term"), "term", "left_semi").select("key", "name").distinct()
    marked = settle(hits, "revealed-texts").select(F.col("key").alias("hit_key"), F.col("name").alias("hit_name"))
    # Only texts with such a term are cut into all their terms.
    same = F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("name") == F.col("hit_name"))
    found = texts.rows.join(marked, same, "left_semi").select(
        "key", "name", F.explode(pieces(F.col("body"), TERM, "term")).alias("part")
    )
    spans = placed(found).withColumn("term", F.lower("match")).drop("kind")
    return spans.join(told.select("term", F.col("action").alias("kind")), "term").select(
        "key", "name", "kind", "match", "start", "end"
    )


def outside(spans: DataFrame, base: DataFrame) -> DataFrame:
    """The spans that overlap no base span of their text."""
    both = spans.withColumn("given", F.lit(False)).unionByName(base.withColumn("given", F.lit(True)))
    by_start = W.partitionBy("key", "name").orderBy("start", F.desc("given"))
    reached = F.max(F.when(F.col("given"), F.col("end"))).over(by_start.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("given"), F.col("start"))).over(by_start.rowsBetween(1, W.unboundedFollowing))
    marked = both.withColumns({"_reached": reached, "_ahead": ahead})
    free = (F.coalesce("_reached", F.lit(0)) <= F.col("start")) & (F.coalesce("_ahead", F.col("end")) >= F.col("end"))
    return marked.where(~F.col("given") & free).drop("given", "_reached", "_ahead")


def find_personal_data(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    reach: int = REACH,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """One row per document: key, name (hash of the text) and spans, an array of (kind, start, end).

    Kinds are email, ip, card and phone, and then generalise and remove for terms that reveal
    such an entity. Spans come in the order of the kinds, then by start; positions count
    characters, the end is exclusive. Term spans overlap no base span.

    A null text is empty; an empty text has no spans. Null and repeated keys are documents
    like any other, and repeated rows have the same spans. An empty table gives no rows; extra
    columns are ignored, whatever their names.
    """
    texts = texts_of(docs, key, text)
    base = settle(base_spans(texts), "base-spans")
    told = settle(disclosures(texts, reach, support, generalise, remove).select("term", "action"), "disclosures")
    more = settle(outside(term_spans(texts, told), base), "term-spans")
    order = F.array_position(F.array(*map(F.lit, (*KINDS, *MORE_KINDS))), F.col("kind"))
    gathered = base.unionByName(more).groupBy("key", "name").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("rank"), "start", "end", "kind"))).alias("spans")
    )
    shown = gathered.select(
        F.col("key").alias("of_key"), F.col("name").alias("of_name"),
        F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
    )
    same = F.col("key").eqNullSafe(F.col("of_key")) & (F.col("name") == F.col("of_name"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    rows = texts.rows.select("key", "name").join(shown, same, "left")
    return rows.select(F.col("key").alias(key), "name", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_base(span: Column) -> Column:
    return span["kind"].isin(*KINDS)


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of spans per row of ``find_personal_data``."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", is_base)
    return found.select(
        key, *map(count, (*KINDS, *MORE_KINDS)), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Key and text of every document with its spans replaced: ``<EMAIL>`` and the like, nothing for removed terms.

    A generalised term becomes the kind of word it is: ``<NAME>`` with a capital, else ``<WORD>``.
    A base span that overlaps an earlier one goes together with it, under the earlier one's kind.
    A null text stays null; all else is as in ``find_personal_data``.
    """
    found = find_personal_data(docs, key, text, **more).where(F.size("spans") > 0).distinct().select(
        F.col(key).alias("of_key"), F.col("name").alias("of_name"), "spans"
    )
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("name"), F.col(text).alias("body"))
    same = F.col("key").eqNullSafe(F.col("of_key")) & (F.col("name") == F.col("of_name"))
    by_start = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))

    def put(state: Column, span: Column) -> Column:
        word = F.substring(F.col("body"), (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        shown = (
            F.when(span["kind"] == "remove", "")
            .when(span["kind"] == "generalise", F.when(word.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>"))
            .otherwise(F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">")))
        )
        kept = F.substring(F.col("body"), (state["end"] + 1).cast("int"), (span["start"] - state["end"]).cast("int"))
        fresh = span["start"] >= state["end"]
        return F.struct(
            F.greatest(state["end"], span["end"]).alias("end"),
            F.when(fresh, F.concat(state["made"], kept, shown)).otherwise(state["made"]).alias("made"),
        )

    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("made"))
    joined = rows.join(found, same, "left").withColumn("spans", by_start)
    rest = lambda s: F.concat(s["made"], F.substring(F.col("body"), (s["end"] + 1).cast("int"), F.lit(2**31 - 1)))
    made = F.when(F.col("spans").isNull(), F.col("body")).otherwise(F.aggregate("spans", start, put, rest))
    return joined.select(F.col("key").alias(key), made.alias(text))
