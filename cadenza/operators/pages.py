"""Web pages: container text, outgoing links, embedded JSON."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.functions.arrays import bind

# Containers tried in order (tag, attribute, value, every match or the first);
# then any tag whose class contains the word, if its text is long enough.
CONTAINERS = [
    ("div", "data-lyrics-container", "true", True),
    ("div", "class", "lyrics", False),
    ("div", "class", "Lyrics__Container-sc-1ynbvzw-6", False),
]
CLASS_WORD = "lyric"
MIN_LENGTH = 100
LINK_TRIES = 3


# The named entities that texts use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&amp;": "&"}


def visible_text(html: Column) -> Column:
    """Text of a piece of HTML: scripts, styles and tags become line breaks, entities characters, white space one space."""
    plain = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>", "\n")
    for entity, character in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    return tx.clean_to_line(plain)


def _opening(tag: str, key: str | None = None, value: str | None = None, word: str | None = None) -> str:
    """The opening tag of an element: any, with an attribute, of a class, or with a word in its class."""
    if word is not None:
        return rf'(?is)^<{tag}\s[^>]*class="[^"]*{word}[^"]*"[^>]*>'
    if key is None:
        return rf"(?is)^<{tag}(?:\s[^>]*)?>"
    if key == "class":
        return rf'(?is)^<{tag}\s[^>]*class="(?:[^"]*\s)?{value}(?:\s[^"]*)?"[^>]*>'
    return rf'(?is)^<{tag}\s[^>]*{key}="{value}"[^>]*>'


def tag_stretches(body: Column, tag: str) -> Column:
    """A page cut before every opening and behind every closing tag of one name: ARRAY<STRUCT<html, step>>.

    ``step`` is what a stretch does to the depth of open elements: 1 more, 1 fewer, or both.
    """
    plain = F.regexp_replace(body, rf"(?i)</{tag}\s*>", f"</{tag}>")
    cut = F.split(plain, rf"(?i)(?=<{tag}(?:\s[^>]*)?>)|(?<=</{tag}>)", -1)

    def step(part: Column) -> Column:
        opens = part.rlike(_opening(tag)).cast("int")
        return opens - F.endswith(part, F.lit(f"</{tag}>")).cast("int")

    return F.transform(cut, lambda part: F.struct(part.alias("html"), step(part).alias("step")))


def element_content(stretches: Column, start: Column, tag: str) -> Column:
    """What stands between the opening tag of a stretch and the closing tag where its depth returns.

    An element that is never closed reaches to the page's end.
    """
    rest = F.slice(stretches, start + 1, F.size(stretches))
    zero = F.lit(0)
    length = F.aggregate(
        rest, F.struct(zero.alias("seen"), zero.alias("depth"), zero.alias("end")),
        lambda acc, part: F.struct(
            (acc["seen"] + 1).alias("seen"), (acc["depth"] + part["step"]).alias("depth"),
            F.when((acc["end"] == 0) & (acc["depth"] + part["step"] <= 0), acc["seen"] + 1).otherwise(acc["end"]).alias("end"),
        ),
        lambda acc: F.when(acc["end"] > 0, acc["end"]).otherwise(acc["seen"]),
    )
    whole = F.array_join(F.transform(F.slice(rest, F.lit(1), length), lambda part: part["html"]), "")
    return F.regexp_replace(F.regexp_replace(whole, _opening(tag), ""), rf"</{tag}>\z", "")


def elements(stretches: Column, tag: str, opening: str) -> Column:
    """The contents of all elements whose opening tag matches, in the order of their opening; inner ones too."""
    places = F.transform(stretches, lambda part, i: F.when(part["html"].rlike(opening), i))
    return F.transform(F.filter(places, lambda i: i.isNotNull()), lambda i: element_content(stretches, i, tag))


def container_text(html: Column, containers=CONTAINERS, class_word: str | None = CLASS_WORD) -> Column:
    """Text of the first container kind a page has; NULL without one.

    Scripts go first, since they may quote tags. An element ends where the depth of elements
    of its name returns, so containers hold others of the same name whole.
    """
    body = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n")
    wanted = [(tag, _opening(tag, key, value), every) for tag, key, value, every in containers]
    tags = sorted({tag for tag, _, _ in wanted} | ({"div"} if class_word else set()))
    # Each name's cuts are made once for all its containers.
    cuts = F.struct(*(tag_stretches(body, tag).alias(tag) for tag in tags))

    def chosen(cut: Column) -> Column:
        tried = []
        for tag, opening, every in wanted:
            texts = F.transform(elements(cut[tag], tag, opening), visible_text)
            tried.append(F.array_join(F.when(F.size(texts) > 0, texts), "\n") if every else F.get(texts, F.lit(0)))
        if class_word:
            texts = F.transform(elements(cut["div"], "div", _opening("div", word=class_word)), visible_text)
            tried.append(F.get(F.filter(texts, lambda t: F.length(t) > MIN_LENGTH), F.lit(0)))
        return F.coalesce(*tried)

    return bind(cuts, chosen)


def page_texts(pages: DataFrame, id_col: str, html_col: str, containers=CONTAINERS, class_word: str | None = CLASS_WORD) -> DataFrame:
    """(id, text): container text of every page; NULL without a container."""
    return pages.select(id_col, container_text(F.col(html_col), containers, class_word).alias("text"))


def matching_links(html: Column, page_url: Column, needles: list[str], redirect: str | None = None, tries: int = LINK_TRIES) -> Column:
    """First links whose target contains all ``needles``; relative ones resolved, redirects unwrapped."""
    found = F.regexp_extract_all(html, F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))
    host = F.regexp_extract(page_url, r"^(https?://[^/?#]+)", 1)
    found = F.filter(found, lambda link: reduce(and_, [F.contains(link, F.lit(n)) for n in needles]))
    if redirect:
        found = F.filter(F.transform(found, lambda link: F.regexp_extract(link, redirect, 1)), lambda link: link != "")
    return F.slice(F.transform(found, lambda link: F.when(F.startswith(link, F.lit("/")), F.concat(host, link)).otherwise(link)), 1, tries)


def embedded_json(html: Column, variable: str) -> Column:
    """JSON text assigned to a script variable, up to the end of its script."""
    found = F.regexp_extract(html, rf"(?s){variable} = (.*?);</script>", 1)
    return F.when(found != "", found)


PLAYER_SCHEMA = "videoDetails STRUCT<title STRING, author STRING, shortDescription STRING, viewCount STRING, lengthSeconds STRING, videoId STRING>"


def player_fields(html: Column) -> dict[str, Column]:
    """Fields of an embedded player response, with defaults."""
    details = F.from_json(embedded_json(html, "ytInitialPlayerResponse"), PLAYER_SCHEMA)["videoDetails"]
    return {
        "title": F.coalesce(details["title"], F.lit("Unknown")),
        "uploader": F.coalesce(details["author"], F.lit("Unknown")),
        "description": F.coalesce(details["shortDescription"], F.lit("")),
        "view_count": F.coalesce(details["viewCount"].try_cast("bigint"), F.lit(0).cast("bigint")),
        "duration": F.coalesce(details["lengthSeconds"].try_cast("bigint"), F.lit(0).cast("bigint")),
    }


_RUNS = "STRUCT<runs: ARRAY<STRUCT<text: STRING>>>"
SEARCH_SCHEMA = (
    "contents STRUCT<twoColumnSearchResultsRenderer: STRUCT<primaryContents: STRUCT<sectionListRenderer: STRUCT<contents: ARRAY<STRUCT<"
    f"itemSectionRenderer: STRUCT<contents: ARRAY<STRUCT<videoRenderer: STRUCT<videoId: STRING, title: {_RUNS}, ownerText: {_RUNS}>>>>>>>>>>"
)


def first_search_result(html: Column) -> dict[str, Column]:
    """Id, title, channel and link of the first video in an embedded search response."""
    data = F.from_json(embedded_json(html, "ytInitialData"), SEARCH_SCHEMA)
    sections = data["contents"]["twoColumnSearchResultsRenderer"]["primaryContents"]["sectionListRenderer"]["contents"]
    items = F.flatten(F.filter(F.transform(sections, lambda s: s["itemSectionRenderer"]["contents"]), lambda c: c.isNotNull()))
    videos = F.filter(F.transform(items, lambda i: i["videoRenderer"]), lambda v: v.isNotNull())
    first = F.get(videos, F.lit(0))
    return {
        "video_id": first["videoId"],
        "title": F.get(first["title"]["runs"], F.lit(0))["text"],
        "channel": F.get(first["ownerText"]["runs"], F.lit(0))["text"],
        "url": F.concat(F.lit("https://www.youtube.com/watch?v="), first["videoId"]),
    }
