"""Shared pieces of the SQL twins. They own their constants: nothing is imported from the code they check."""

from __future__ import annotations

# Fixed values of the published sentiment rules, whole and in their order.
UP_WORDS = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply",
    "effing", "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme",
    "extremely", "fabulously", "flipping", "flippin", "frackin", "fracking", "fricking", "frickin", "frigging",
    "friggin", "fully", "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely",
    "incredible", "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "total", "totally", "tremendous",
    "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very",
]
DOWN_WORDS = [
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally",
    "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sorta",
    "sortof", "sort-of",
]
NEGATING = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't",
    "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt",
    "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't",
    "mustn't", "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't",
    "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely",
    "seldom", "despite",
]

AUDIO = [
    "danceability", "energy", "key", "loudness", "mode", "speechiness",
    "acousticness", "instrumentalness", "liveness", "valence", "tempo", "duration_ms",
]


def u(i: int, alias: str = "e") -> str:
    return f"least(1.0, greatest(0.0, 0.5 + CAST({alias}.embedding[{i}] AS DOUBLE)))"


SONGS = f"""songs AS (
  SELECT d.doc_id AS song_id,
    array_to_string(list_slice(string_split(d.text, ' '), 1, 3), ' ') AS track_name,
    d.source AS track_artist, d.lang AS playlist_genre, d.text AS lyrics,
    {u(1)} AS danceability, {u(2)} AS energy,
    CAST(least(11, floor(12 * {u(3)})) AS INTEGER) AS key, -60 + 60 * {u(4)} AS loudness,
    CASE WHEN {u(5)} >= 0.5 THEN 1 ELSE 0 END AS mode,
    {u(6)} AS speechiness, {u(7)} AS acousticness, {u(8)} AS instrumentalness,
    {u(9)} AS liveness, {u(10)} AS valence, 60 + 140 * {u(11)} AS tempo,
    CAST(floor(120000 + 180000 * {u(12)}) AS INTEGER) AS duration_ms,
    list_transform(e.embedding[13:64], lambda x: CAST(x AS DOUBLE)) AS w2v,
    list_transform(e.embedding[55:64], lambda x: (1 + CAST(x AS DOUBLE))
      / list_sum(list_transform(e.embedding[55:64], lambda y: 1 + CAST(y AS DOUBLE)))) AS topics,
    e.label AS cluster
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""

# The catalog of all documents, for what needs names and texts alone.
TEXTS = """songs AS (
  SELECT doc_id AS song_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS track_name,
    source AS track_artist, lang AS playlist_genre, text AS lyrics FROM documents)"""

WORD_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def word_tokens(expr: str) -> str:
    return WORD_TOKENS.format(expr)


LEXICON = f"""lexicon AS MATERIALIZED (
  SELECT term, CAST(length(term) % 9 - 4 AS DOUBLE) AS valence,
    (length(term) % 9 - 4) / 4.0::DOUBLE AS polarity, abs(length(term) % 9 - 4) / 4.0::DOUBLE AS subjectivity
  FROM (SELECT term, count(*) AS n FROM (SELECT unnest({word_tokens('text')}) AS term FROM documents)
        GROUP BY term QUALIFY count(*) * 500 >= sum(count(*)) OVER ()))"""

# Phrases of two and three words from the benchmark texts.
IDIOMS = """idiom_words AS (SELECT item_id, regexp_split_to_array(lower(text), ' ') AS w FROM benchmark),
idioms AS (SELECT phrase, min(valence) AS valence FROM
  (SELECT array_to_string(w[i:i + 1], ' ') AS phrase, item_id % 7 - 3.0::DOUBLE AS valence FROM idiom_words, (SELECT unnest(range(1, 20, 3)) AS i) WHERE len(w) > i
   UNION ALL SELECT array_to_string(w[i:i + 2], ' '), item_id % 5 - 2.5::DOUBLE FROM idiom_words, (SELECT unnest(range(2, 20, 4)) AS i) WHERE len(w) > i + 1) GROUP BY phrase)"""


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_CAPS = "({0} = upper({0}) AND {0} <> lower({0}))"
_NEG = f"coalesce(lower({{0}}) IN ({quoted(NEGATING)}) OR contains(lower({{0}}), 'n''t'), false)"


def _step(distance: int, s: str) -> str:
    """One of the three preceding words applied to the running valence ``s``."""
    p, factor = f"p{distance}", {1: 1.0, 2: 0.95, 3: 0.9}[distance]
    boost = f"""(CASE WHEN lower({p}) IN ({quoted(UP_WORDS)}) THEN 0.293::DOUBLE
      WHEN lower({p}) IN ({quoted(DOWN_WORDS)}) THEN -0.293::DOUBLE END * CASE WHEN {s} < 0 THEN -1 ELSE 1 END
      + CASE WHEN {_CAPS.format(p)} AND caps_differ THEN CASE WHEN {s} > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END ELSE 0 END)"""
    boosted = f"({s} + coalesce({boost} * {factor}::DOUBLE, 0))"
    if distance == 1:
        rules = f"CASE WHEN {_NEG.format('p1')} THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END"
    elif distance == 2:
        rules = f"""CASE WHEN lower(p2) = 'never' AND lower(p1) IN ('so', 'this') THEN 1.25::DOUBLE
          WHEN lower(p2) = 'without' AND lower(p1) = 'doubt' THEN 1.0::DOUBLE
          WHEN {_NEG.format('p2')} THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END"""
    else:
        rules = f"""CASE WHEN lower(p3) = 'never' AND (lower(p2) IN ('so', 'this') OR lower(p1) IN ('so', 'this')) THEN 1.25::DOUBLE
          WHEN lower(p3) = 'without' AND (lower(p2) = 'doubt' OR lower(p1) = 'doubt') THEN 1.0::DOUBLE
          WHEN {_NEG.format('p3')} THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END"""
    return f"CASE WHEN {p} IS NOT NULL AND NOT {p}_known THEN {boosted} * {rules} ELSE {s} END"


def _phrase_joins(keys: list[str]) -> str:
    active = "p3 IS NOT NULL AND NOT p3_known"
    return " ".join(f"LEFT JOIN idioms j{i} ON {active} AND {test} AND lower({key}) = j{i}.phrase" for i, (key, test) in enumerate(keys))


def sentiment(source: str, id_col: str, text_col: str, name: str = "mood", idioms: bool = False) -> str:
    """CTEs giving neg, neu, pos, compound per row of ``source``; needs LEXICON, and IDIOMS if asked for."""
    phrases = [
        ("p1 || ' ' || word", "true"), ("p2 || ' ' || p1 || ' ' || word", "true"), ("p2 || ' ' || p1", "true"),
        ("p3 || ' ' || p2 || ' ' || p1", "true"), ("p3 || ' ' || p2", "true"),
        ("word || ' ' || n1", "n1 IS NOT NULL"), ("word || ' ' || n1 || ' ' || n2", "n2 IS NOT NULL"),
    ]
    spoken = "coalesce(j6.valence, j5.valence, j0.valence, j1.valence, j2.valence, j3.valence, j4.valence, s3)" if idioms else "s3"
    joins = _phrase_joins(phrases) if idioms else ""
    weak = "('just enough', 'kind of', 'sort of')"
    bare = r"regexp_replace(t, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+\z', '', 'g')"
    return f"""{name}_w AS (
  SELECT {id_col}, coalesce({text_col}, '') AS txt,
    list_transform(list_filter(regexp_split_to_array(coalesce({text_col}, ''), '[\\s\\p{{Z}}]+'), lambda t: t <> ''),
      lambda t: CASE WHEN length({bare}) <= 2 THEN t ELSE {bare} END) AS w FROM {source}),
{name}_d AS (
  SELECT {id_col}, w, len(w) AS n_words, coalesce(list_position(list_transform(w, lambda t: lower(t)), 'but'), 0) AS but_at,
    len(list_filter(w, lambda t: t = upper(t) AND t <> lower(t))) AS n_caps,
    least(length(txt) - length(replace(txt, '!', '')), 4) AS bangs,
    length(txt) - length(replace(txt, '?', '')) AS marks FROM {name}_w),
{name}_t AS (SELECT {id_col}, n_words, but_at, n_caps > 0 AND n_caps < n_words AS caps_differ, w, unnest(range(1, n_words + 1)) AS nth FROM {name}_d),
{name}_x AS (
  SELECT {id_col}, but_at, caps_differ, nth, w[nth] AS word, CASE WHEN nth > 1 THEN w[nth - 1] END AS p1,
    CASE WHEN nth > 2 THEN w[nth - 2] END AS p2, CASE WHEN nth > 3 THEN w[nth - 3] END AS p3,
    w[nth + 1] AS n1, w[nth + 2] AS n2 FROM {name}_t),
{name}_h AS (
  SELECT x.*, k1.term IS NOT NULL AS p1_known, k2.term IS NOT NULL AS p2_known, k3.term IS NOT NULL AS p3_known,
    CASE WHEN {_CAPS.format('word')} AND caps_differ
      THEN CASE WHEN l.valence > 0 THEN l.valence + 0.733::DOUBLE ELSE l.valence - 0.733::DOUBLE END ELSE l.valence END AS s0
  FROM {name}_x x JOIN lexicon l ON lower(word) = l.term AND lower(word) NOT IN ({quoted(UP_WORDS + DOWN_WORDS)})
  LEFT JOIN lexicon k1 ON lower(p1) = k1.term LEFT JOIN lexicon k2 ON lower(p2) = k2.term LEFT JOIN lexicon k3 ON lower(p3) = k3.term),
{name}_1 AS (SELECT *, {_step(1, 's0')} AS s1 FROM {name}_h),
{name}_2 AS (SELECT *, {_step(2, 's1')} AS s2 FROM {name}_1),
{name}_3 AS (SELECT *, {_step(3, 's2')} AS s3 FROM {name}_2),
{name}_4 AS (SELECT x.*, {spoken} - CASE WHEN p3 IS NOT NULL AND NOT p3_known THEN
    CASE WHEN lower(p3 || ' ' || p2) IN {weak} THEN 0.293::DOUBLE ELSE 0 END + CASE WHEN lower(p2 || ' ' || p1) IN {weak} THEN 0.293::DOUBLE ELSE 0 END ELSE 0 END AS s4
  FROM {name}_3 x {joins}),
{name}_5 AS (SELECT *, CASE WHEN lower(p1) = 'least' AND NOT p1_known AND NOT coalesce(lower(p2) IN ('at', 'very'), false) THEN s4 * -0.74::DOUBLE ELSE s4 END AS s5 FROM {name}_4),
{name}_s AS (SELECT {id_col}, CASE WHEN but_at > 0 AND nth < but_at THEN s5 * 0.5::DOUBLE WHEN but_at > 0 AND nth > but_at THEN s5 * 1.5::DOUBLE ELSE s5 END AS s FROM {name}_5),
{name}_a AS (
  SELECT d.{id_col}, d.n_words, d.bangs, d.marks, coalesce(sum(s), 0) AS total,
    coalesce(sum(CASE WHEN s > 0 THEN s + 1 END), 0) AS up, coalesce(sum(CASE WHEN s < 0 THEN s - 1 END), 0) AS down,
    count(CASE WHEN s <> 0 THEN 1 END) AS hit FROM {name}_d d LEFT JOIN {name}_s USING ({id_col}) GROUP BY ALL),
{name}_b AS (
  SELECT *, bangs * 0.292::DOUBLE + CASE WHEN marks > 3 THEN 0.96::DOUBLE WHEN marks > 1 THEN marks * 0.18::DOUBLE ELSE 0 END AS emph FROM {name}_a),
{name}_c AS (
  SELECT {id_col}, n_words - hit AS flat, CASE WHEN total > 0 THEN total + emph WHEN total < 0 THEN total - emph ELSE total END AS x,
    CASE WHEN up > -down THEN up + emph ELSE up END AS up, CASE WHEN up < -down THEN down - emph ELSE down END AS down FROM {name}_b),
{name} AS (
  SELECT {id_col},
    CASE WHEN up - down + flat > 0 THEN round(abs(down / (up - down + flat)) + 1e-9, 3) ELSE 0 END AS neg,
    CASE WHEN up - down + flat > 0 THEN round(flat / (up - down + flat) + 1e-9, 3) ELSE 1 END AS neu,
    CASE WHEN up - down + flat > 0 THEN round(abs(up / (up - down + flat)) + 1e-9, 3) ELSE 0 END AS pos,
    round(greatest(-1.0, least(1.0, x / sqrt(x * x + 15))), 4) AS compound FROM {name}_c)"""


TONE = f"""tone_t AS (SELECT song_id, unnest({word_tokens('lyrics')}) AS token FROM songs),
tone_a AS (SELECT song_id, count(*) AS n, avg(polarity) AS polarity, avg(subjectivity) AS subjectivity
  FROM tone_t LEFT JOIN lexicon ON token = term GROUP BY song_id),
tone AS (SELECT s.song_id, coalesce(polarity, 0) AS polarity,
  coalesce(subjectivity, CASE WHEN coalesce(n, 0) = 0 THEN 0.5 ELSE 0 END) AS subjectivity FROM songs s LEFT JOIN tone_a USING (song_id))"""

CLEANED = r"regexp_replace(regexp_replace(lower({0}), '\[[^\]\n]*\]', '', 'g'), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g')"


def cleaned(expr: str) -> str:
    return CLEANED.format(expr)


TERMS = f"""terms AS MATERIALIZED (SELECT song_id, term, count(*) AS tf FROM
  (SELECT song_id, unnest(regexp_extract_all({cleaned('lyrics')}, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM songs) GROUP BY ALL),
term_totals AS (SELECT song_id, sum(tf * tf) AS sq FROM terms GROUP BY song_id)"""

LEADS = """leads AS (SELECT song_id AS seed_id FROM (SELECT song_id, row_number() OVER (PARTITION BY playlist_genre
  ORDER BY track_name, song_id) AS r FROM songs) WHERE r = 1)"""

FEATURES = "features AS MATERIALIZED (SELECT s.*, neg, neu, pos, compound, polarity, subjectivity FROM songs s JOIN mood USING (song_id) JOIN tone USING (song_id))"



def base(leads: str = LEADS) -> str:
    """CTEs that the hybrid searches need, with the seeds as CTE ``leads``."""
    stored = SONGS.replace("songs AS (", "songs AS MATERIALIZED (", 1)
    return ",\n".join([stored, LEXICON, sentiment("songs", "song_id", "lyrics"), TONE, TERMS, leads, FEATURES])


BASE = base()

# Mood prototypes, the weights' order as in AUDIO; features not named are 0.
MOODS = {
    "happy": {"valence": 0.8, "energy": 0.7, "danceability": 0.7},
    "sad": {"valence": 0.2, "energy": 0.3, "danceability": 0.3},
    "energetic": {"valence": 0.6, "energy": 0.9, "danceability": 0.8},
    "relaxed": {"valence": 0.5, "energy": 0.2, "danceability": 0.3},
    "angry": {"valence": 0.3, "energy": 0.8, "danceability": 0.4},
    "romantic": {"valence": 0.6, "energy": 0.4, "danceability": 0.5},
    "melancholic": {"valence": 0.3, "energy": 0.4, "danceability": 0.3},
    "party": {"valence": 0.8, "energy": 0.8, "danceability": 0.9},
}

# Substrings deleted from a title, in this order.
TITLE_SUFFIXES = (
    "official audio, official video, music video, lyric video, lyrics, audio, video, hd, "
    "remastered, explicit, clean, visualizer, feat, ft, featuring"
).split(", ")

PROFILE = ["danceability", "energy", "valence", "acousticness", "instrumentalness", "liveness", "speechiness"]


def tempo(a: str, b: str) -> str:
    gap = f"least(abs({a} - {b}), abs({a} - 2 * {b}), abs({a} - 0.5::DOUBLE * {b}))"
    return (
        f"CASE WHEN {gap} <= 5 THEN 1.0::DOUBLE WHEN {gap} <= 20 THEN 1.0 - ({gap} - 5) / 15.0::DOUBLE "
        f"ELSE greatest(0.0, 1.0 - {gap} / 40.0::DOUBLE) END"
    )


STANDARD = {
    "danceability": 0.15, "energy": 0.15, "tempo": 0.15, "valence": 0.10, "acousticness": 0.10,
    "instrumentalness": 0.10, "loudness": 0.10, "speechiness": 0.10, "liveness": 0.05,
}
VIDEO = {
    "tempo": 0.25, "energy": 0.20, "loudness": 0.15, "valence": 0.15, "acousticness": 0.10,
    "danceability": 0.05, "speechiness": 0.05, "instrumentalness": 0.03, "liveness": 0.02,
}


def feature_sim(name: str, a: str, b: str) -> str:
    if name == "tempo":
        return tempo(f"{a}.tempo", f"{b}.tempo")
    span = 20.0 if name == "loudness" else 1.0
    return f"1.0 - least(1.0, abs({a}.{name} - {b}.{name}) / {span}::DOUBLE)"


def audio_sim(weights: dict[str, float], a: str = "q", b: str = "c") -> str:
    parts = " + ".join(f"{w}::DOUBLE * ({feature_sim(n, a, b)})" for n, w in weights.items())
    return f"(({parts}) / {sum(weights.values())}::DOUBLE)"


def vec(alias: str) -> str:
    return "[" + ", ".join(f"CAST({alias}.{n} AS DOUBLE)" for n in AUDIO) + "]"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def cos(a: str, b: str) -> str:
    return (
        f"CASE WHEN {dot(a, a)} > 0 AND {dot(b, b)} > 0 THEN {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) ELSE 0 END"
    )


def mood_cos(a: str = "q", b: str = "c") -> str:
    keys = ["neg", "neu", "pos", "compound"]
    d = lambda x, y: " + ".join(f"{x}.{k} * {y}.{k}" for k in keys)
    return f"CASE WHEN {d(a, a)} > 0 AND {d(b, b)} > 0 THEN ({d(a, b)}) / (sqrt({d(a, a)}) * sqrt({d(b, b)})) ELSE 0 END"


C2 = "1.9753321701094941::DOUBLE"


def lyric_legs(seeds: str = "leads", seed_terms: str = "terms", seed_totals: str = "term_totals", seed_key: str = "song_id") -> str:
    """CTE lyr(seed_id, song_id, lyrics) of unrounded pair cosines."""
    return f"""lyr AS (
  SELECT seed_id, song_id, dot / (sqrt(s11 + {C2} * (t11 - s11)) * sqrt(s22 + {C2} * (t22 - s22))) AS lyrics FROM (
    SELECT p.seed_id, b.song_id, sum(a.tf * b.tf)::DOUBLE AS dot, sum(a.tf * a.tf)::DOUBLE AS s11, sum(b.tf * b.tf)::DOUBLE AS s22,
      max(ta.sq)::DOUBLE AS t11, max(tb.sq)::DOUBLE AS t22
    FROM {seeds} p JOIN {seed_terms} a ON a.{seed_key} = p.seed_id JOIN terms b ON a.term = b.term
    JOIN {seed_totals} ta ON ta.{seed_key} = p.seed_id JOIN term_totals tb ON tb.song_id = b.song_id
    GROUP BY p.seed_id, b.song_id))"""


def scored(
    weights: tuple[float, float, float] = (0.7, 0.2, 0.1),
    audio_floor: str = "0.12", combined_floor: str = "0.12", feature_weights: dict[str, float] = STANDARD, among: str = "true",
) -> str:
    """CTEs lyr and scored for the leads against the catalog songs ``c`` that satisfy ``among``."""
    wa, wl, ws = weights
    return f"""{lyric_legs()},
raw AS (
  SELECT q.song_id AS seed_id, c.song_id, c.track_name, c.track_artist, {audio_sim(feature_weights)} AS ra,
    coalesce(lyr.lyrics, 0) AS rl, {mood_cos()} AS rs
  FROM leads l JOIN features q ON q.song_id = l.seed_id JOIN features c ON c.song_id <> q.song_id AND {among}
  LEFT JOIN lyr ON lyr.seed_id = q.song_id AND lyr.song_id = c.song_id),
scored AS (SELECT * FROM (SELECT seed_id, song_id, track_name, track_artist, round(ra, 6) AS audio, round(rl, 6) AS lyrics, round(rs, 6) AS sentiment,
    round({wa}::DOUBLE * ra + {wl}::DOUBLE * rl + {ws}::DOUBLE * rs, 6) AS combined FROM raw)
  WHERE audio >= {audio_floor}::DOUBLE AND combined >= {combined_floor}::DOUBLE)"""


def refined(
    k: int, keys: str = "seed_id", factor: int = 3, floor: str = "0.15", min_kept: int | None = None, source: str = "scored", audio_floor: str | None = None,
) -> str:
    """CTE ranked: refinement and top-k of ``scored``; floors are numbers or columns."""
    low = audio_floor or f"{floor}::DOUBLE"
    need = max(k, 3) if min_kept is None else min_kept
    return f"""stats AS (
  SELECT {keys}, count(*) AS n, median(audio) AS ma, stddev_pop(audio) AS sa, median(combined) AS mc, stddev_pop(combined) AS sc
  FROM {source} GROUP BY {keys}),
flagged AS (
  SELECT s.*, n > {factor * k} AS many,
    audio >= greatest({low}, ma * 0.85::DOUBLE, ma - sa) AND combined >= greatest({floor}::DOUBLE, mc * 0.85::DOUBLE, mc - sc) AS good
  FROM {source} s JOIN stats USING ({keys})),
enough AS (SELECT {keys}, count(*) FILTER (WHERE good) >= {need} AS ok FROM flagged GROUP BY {keys}),
ranked AS (
  SELECT * FROM (SELECT f.*, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY combined DESC, song_id) AS INTEGER) AS rank
    FROM flagged f JOIN enough USING ({keys}) WHERE NOT many OR NOT ok OR good) WHERE rank <= {k})"""


def normalised_title(expr: str) -> str:
    base = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({expr}), '\([^)\n]*\)', '', 'g'), '\[[^\]\n]*\]', '', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
    for suffix in TITLE_SUFFIXES:
        base = f"replace({base}, '{suffix}', '')"
    return f"trim({base})"
