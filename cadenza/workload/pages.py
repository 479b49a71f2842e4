"""Page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import pages as pg
from cadenza.sources.tables import spread_table, table
from cadenza.workload.registry import query


STRIP_SQL = "regexp_replace({0}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->{1}', chr(10), 'g')"


def visible_sql(expr: str) -> str:
    text = STRIP_SQL.format(expr, "|<[^>]*>")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return f"trim(regexp_replace(regexp_replace({text}, '\\[[^\\]\\n]*\\]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(
    "j1_container_text",
    f"""WITH b AS (SELECT page_id, {STRIP_SQL.format('html', '')} AS body FROM pages),
    c AS (SELECT page_id, regexp_extract_all(body, '(?is)<article(?:\\s[^>]*)?>(.*?)</article>', 1) AS found FROM b)
    SELECT page_id, CASE WHEN len(found) > 0 THEN {visible_sql('found[1]')} END AS text FROM c""",
)
def j1(spark, sf):
    return pg.page_texts(spread_table(spark, sf, "pages"), "page_id", "html", [("article", None, None, False)], None)


# Pages whose article is one of the containers, its paragraphs elements of the container's own name.
BOXES = ['data-lyrics-container="true"', 'class="x lyrics y"', 'class="Lyrics__Container-sc-1ynbvzw-6"', 'class="MyLyricBox"', 'class="box"']
BOXED_SQL = (
    "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN '<div {box}>'" for i, box in enumerate(BOXES)) + " END"
)


def tried_sql(kind: str, condition: str) -> str:
    """The contents of the elements whose opening tag meets a condition, by running depth over all div tags of a page."""
    return f"""{kind} AS (SELECT page_id, i, (SELECT string_agg(t.token, '' ORDER BY t.i) FROM depth t WHERE t.page_id = d.page_id AND t.i > d.i
      AND t.i < coalesce((SELECT min(e.i) FROM depth e WHERE e.page_id = d.page_id AND e.i > d.i AND e.after < d.after), 1000000000)) AS content
      FROM depth d WHERE step = 1 AND {condition})"""


@query(
    "j1_nested_containers",
    f"""WITH h AS (SELECT page_id, {STRIP_SQL.format("replace(replace(replace(replace(html, '<article>', " + BOXED_SQL + "), '</article>', '</div >'), '<p>', '<div class=\"p\">'), '</p>', '</div>')", '')} AS body FROM pages),
    k AS (SELECT page_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM (SELECT page_id, regexp_extract_all(body, '(?is)<div(?:\\s[^>]*)?>|</div\\s*>|[^<]+|<') AS tokens FROM h)),
    s AS (SELECT *, CASE WHEN regexp_matches(token, '^(?is)<div(\\s|>)') THEN 1 WHEN regexp_matches(token, '^(?is)</div\\s*>') THEN -1 ELSE 0 END AS step FROM k),
    depth AS MATERIALIZED (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) AS after FROM s),
    {tried_sql("a", "contains(token, 'data-lyrics-container=\"true\"')")}, {tried_sql("b", "regexp_matches(token, 'class=\"([^\"]*\\s)?lyrics(\\s[^\"]*)?\"')")},
    {tried_sql("c", "contains(token, 'class=\"Lyrics__Container-sc-1ynbvzw-6\"')")}, {tried_sql("d", "regexp_matches(token, '(?i)class=\"[^\"]*lyric[^\"]*\"')")},
    f AS (SELECT page_id, string_agg({visible_sql('content')}, chr(10) ORDER BY i) AS text, 1 AS kind FROM a GROUP BY page_id
      UNION ALL SELECT page_id, arg_min({visible_sql('content')}, i), 2 FROM b GROUP BY page_id UNION ALL SELECT page_id, arg_min({visible_sql('content')}, i), 3 FROM c GROUP BY page_id
      UNION ALL SELECT page_id, arg_min({visible_sql('content')}, i), 4 FROM d WHERE length({visible_sql('content')}) > 100 GROUP BY page_id)
    SELECT page_id, arg_min(text, kind) AS text FROM pages LEFT JOIN f USING (page_id) GROUP BY page_id""",
)
def j1_nested(spark, sf):
    box = F.element_at(F.array(*(F.lit(f"<div {b}>") for b in BOXES)), (F.col("page_id") % 5 + 1).cast("int"))
    html = F.col("html")
    for old, new in (("<article>", box), ("</article>", F.lit("</div >")), ("<p>", F.lit('<div class="p">')), ("</p>", F.lit("</div>"))):
        html = F.replace(html, F.lit(old), new)
    return pg.page_texts(spread_table(spark, sf, "pages").withColumn("html", html), "page_id", "html")


@query(
    "j2_outgoing_links",
    """WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, list_filter(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1), lambda x: contains(x, '/') AND contains(x, 'e')) AS links FROM pages)
    SELECT page_id, list_transform(links[1:3], lambda x: CASE WHEN starts_with(x, '/') THEN host || x ELSE x END) AS links FROM l""",
)
def j2(spark, sf):
    return table(spark, sf, "pages").select("page_id", pg.matching_links(F.col("html"), F.col("url"), ["/", "e"]).alias("links"))


TITLE_SQL = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    "j3_embedded_json",
    f"""SELECT page_id, CASE WHEN contains(url, '#') THEN 'Unknown' ELSE {TITLE_SQL} END AS title, CASE WHEN contains(url, '#') THEN 'Unknown' ELSE url END AS uploader,
    CASE WHEN contains(url, '#') THEN 0 ELSE page_id * 7 END::BIGINT AS view_count, 0::BIGINT AS duration, substr(md5(url), 1, 11) AS video_id, {TITLE_SQL} AS found_title FROM pages""",
)
def j3(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    details = F.struct(title.alias("title"), F.col("url").alias("author"), (F.col("page_id") * 7).cast("string").alias("viewCount"))
    player = F.concat(
        F.lit("<script>var ytInitialPlayerResponse = "), F.to_json(F.struct(details.alias("videoDetails"))), F.lit(";</script>")
    )
    runs = lambda c: F.struct(F.array(F.struct(c.alias("text"))).alias("runs"))
    video = F.struct(F.substring(F.md5("url"), 1, 11).alias("videoId"), runs(title).alias("title"), runs(F.col("url")).alias("ownerText"))
    nested = F.array(F.struct(video.alias("videoRenderer")))
    for name in ("contents", "itemSectionRenderer"):
        nested = F.struct(nested.alias(name))
    nested = F.array(nested)
    for name in ("contents", "sectionListRenderer", "primaryContents", "twoColumnSearchResultsRenderer", "contents"):
        nested = F.struct(nested.alias(name))
    search = F.concat(F.lit("<script>var ytInitialData = "), F.to_json(nested), F.lit(";</script>"))
    broken = F.when(F.contains("url", F.lit("#")), F.lit("<script>var ytInitialPlayerResponse = {oops;</script>")).otherwise(player)
    rows = table(spark, sf, "pages").select("page_id", F.concat("html", broken, search).alias("html"))
    fields, found = pg.player_fields(F.col("html")), pg.first_search_result(F.col("html"))
    return rows.select(
        "page_id", *[fields[n].alias(n) for n in ("title", "uploader", "view_count", "duration")],
        found["video_id"].alias("video_id"), found["title"].alias("found_title"),
    )
