"""Text cleaning, tokens, titles, links and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.arrays import bind

# A word character in both Java and RE2 syntax, with accented letters.
WORD = r"[\p{L}\p{N}_]"
SECTION = r"\[[^\]\n]*\]"
SPACE = r"[\s\p{Z}]"

# Substrings deleted from a normalised title, in this order.
TITLE_SUFFIXES = [
    "official audio", "official video", "music video", "lyric video", "lyrics", "audio", "video", "hd",
    "remastered", "explicit", "clean", "visualizer", "feat", "ft", "featuring",
]

# Patterns of an eleven-character video id, tried in this order.
VIDEO_ID_PATTERNS = [
    r"(?:v=|/)([0-9A-Za-z_-]{11}).*",
    r"(?:embed/)([0-9A-Za-z_-]{11})",
    r"(?:youtu\.be/)([0-9A-Za-z_-]{11})",
]


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def clean_to_words(text: Column) -> Column:
    """Lower case, punctuation and digit runs to spaces, words joined by one space."""
    spaced = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_\s\p{{Z}}]", " ")
    spaced = F.regexp_replace(spaced, r"\p{Nd}+", " ")
    return F.coalesce(F.array_join(F.regexp_extract_all(spaced, F.lit(f"{WORD}+"), F.lit(0)), " "), F.lit(""))


def clean_for_similarity(text: Column) -> Column:
    """Lower case, section markers and punctuation dropped."""
    plain = F.regexp_replace(F.lower(text), SECTION, "")
    return F.regexp_replace(plain, rf"[^\p{{L}}\p{{N}}_\s\p{{Z}}]", "")


def clean_to_line(text: Column) -> Column:
    """Section markers dropped, white space collapsed, trimmed."""
    plain = F.regexp_replace(text, SECTION, "")
    return F.trim(F.regexp_replace(plain, rf"{SPACE}+", " "))


def clean_lines(text: Column) -> Column:
    """Section markers dropped, lines trimmed, empty lines removed."""
    lines = F.split(F.regexp_replace(text, SECTION, ""), "\n")
    return F.array_join(F.filter(F.transform(lines, strip), lambda s: s != ""), "\n")


def words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case word tokens, stop words removed."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop_words))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def similarity_tokens(text: Column, cleaned: bool = True) -> Column:
    """Tokens of two or more word characters, as the TF-IDF legs count them."""
    source = clean_for_similarity(text) if cleaned else F.lower(text)
    return F.coalesce(
        F.regexp_extract_all(source, F.lit(f"{WORD}{{2,}}"), F.lit(0)), F.array().cast("array<string>")
    )


def run_lengths(tokens: Column, kind: str = "bigint") -> Column:
    """ARRAY<STRUCT<term, tf>> of one row's values, without a shuffle.

    Sorts the values and measures the length of each run.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda i, j: F.struct(
                    F.get(s, i).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - i).cast("bigint").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast(f"array<struct<term:{kind},tf:bigint>>")
    return bind(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def term_counts(tokens: Column) -> Column:
    """The run lengths of one row's tokens."""
    return run_lengths(tokens, "string")


def normalise_title(title: Column) -> Column:
    """Lower case, bracketed parts and punctuation dropped, suffix substrings deleted in order."""
    t = F.regexp_replace(F.lower(title), r"\([^)\n]*\)", "")
    t = F.regexp_replace(t, SECTION, "")
    t = F.regexp_replace(t, r"[^a-z0-9 ]", "")
    t = F.trim(F.regexp_replace(t, r" +", " "))
    for suffix in TITLE_SUFFIXES:
        t = F.replace(t, F.lit(suffix), F.lit(""))
    return F.trim(t)


def _captured(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def described_song(description: Column) -> Column:
    """Title named in a description: ``Music: artist - title`` wins over ``Song: title``."""
    music = _captured(description, r"(?i)Music:?\s*([^\-\n]+)-([^\n]+)", 2)
    return F.coalesce(F.trim(music), F.trim(_captured(description, r"(?i)Song:?\s*([^\n]+)")))


def described_artist(description: Column) -> Column:
    music = _captured(description, r"(?i)Music:?\s*([^\-\n]+)-([^\n]+)", 1)
    return F.coalesce(F.trim(music), F.trim(_captured(description, r"(?i)Artist:?\s*([^\n]+)")))


def split_artist_title(title: Column, uploader: Column) -> tuple[Column, Column]:
    """(artist, title) from "Artist - Title"; the uploader is the artist otherwise."""
    has_dash = F.contains(title, F.lit(" - "))
    artist = F.when(has_dash, F.trim(F.substring_index(title, " - ", 1))).otherwise(uploader)
    rest = F.substring(title, F.locate(" - ", title) + 3, F.length(title))
    return artist, F.when(has_dash, F.trim(rest)).otherwise(title)


def video_id(url: Column) -> Column:
    return F.coalesce(*[_captured(url, p) for p in VIDEO_ID_PATTERNS])


def thumbnail_url(url: Column) -> Column:
    found = video_id(url)
    return F.when(
        found.isNotNull(), F.concat(F.lit("https://img.youtube.com/vi/"), found, F.lit("/hqdefault.jpg"))
    )


def url_slug(name: Column) -> Column:
    """Lower case, everything but word characters, spaces and dashes dropped, then spaces dropped."""
    kept = F.regexp_replace(F.lower(name), rf"[^\p{{L}}\p{{N}}_\s\p{{Z}}\-]", "")
    return F.replace(kept, F.lit(" "), F.lit(""))


def title_from_file(name: Column) -> Column:
    """File name without folder, extension and leading digits, underscores, dashes and spaces."""
    base = F.regexp_replace(name, r"^.*/", "")
    base = F.regexp_replace(base, r"\.[^.]*\z", "")
    return F.regexp_replace(base, r"^[\d_\-\s]+", "")


def file_pattern(title: Column) -> Column:
    """What the file saved for a title contains: odd characters dropped, spaces as underscores."""
    kept = F.regexp_replace(title, rf"[^\p{{L}}\p{{N}}_\s\p{{Z}}\-]", "")
    return F.replace(kept, F.lit(" "), F.lit("_"))


def duration_text(ms: Column) -> Column:
    """m:ss with the minutes modulo 60."""
    seconds = F.floor(ms / 1000) % 60
    minutes = F.floor(ms / 60000) % 60
    return F.concat(minutes.cast("string"), F.lit(":"), F.lpad(seconds.cast("string"), 2, "0"))


# The wording of a recommendation's reason, for a strong and a weaker score.
REASON_START, REASON_JOIN, REASON_ELSE = "Recommended because of ", " and ", "overall similarity"
REASONS = {
    "audio": ("very similar sound profile", "similar sound profile"),
    "lyrics": ("very similar lyrical themes", "similar lyrical themes"),
    "sentiment": ("matching emotional tone", "similar emotional tone"),
}


def reason_text(audio: Column, lyrics: Column, sentiment: Column) -> Column:
    """Why a song was recommended; two cuts per component."""
    scores = {"audio": audio, "lyrics": lyrics, "sentiment": sentiment}
    parts = [
        F.when(scores[leg] > 0.7, F.lit(strong)).when(scores[leg] > 0.5, F.lit(weak)) for leg, (strong, weak) in REASONS.items()
    ]
    joined = F.concat_ws(REASON_JOIN, *parts)
    return F.concat(F.lit(REASON_START), F.when(joined == "", F.lit(REASON_ELSE)).otherwise(joined))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.7, F.lit("high")).when(score >= 0.4, F.lit("medium")).otherwise(F.lit("low"))


def search_text(title: Column, artist: Column) -> Column:
    return F.concat_ws(" ", title, artist, F.lit("official audio"))


def trigrams(text: Column) -> Column:
    """Distinct three-grams of every word, padded with two spaces before and one after."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(
        tokens,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard overlap of two trigram sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def section_markers(text: Column) -> Column:
    """ARRAY<STRUCT<marker, chorus>> of the bracketed section names, in order."""
    names = F.regexp_extract_all(text, F.lit(r"\[([^\]\n]*)\]"), F.lit(1))
    return F.transform(
        names, lambda n: F.struct(n.alias("marker"), F.contains(F.lower(n), F.lit("chorus")).alias("chorus"))
    )


def stanzas(text: Column) -> Column:
    """Blocks of lines separated by blank lines, empty ones dropped."""
    return F.filter(F.split(text, r"\n\s*\n"), lambda s: strip(s) != "")


def rename_keys(record: Column, names: dict[str, str]) -> Column:
    """Map with some keys renamed."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(record, lambda k, v: F.coalesce(F.try_element_at(table, k), k))


# Short sentiment keys and their long names.
LONG_SENTIMENT_KEYS = {"pos": "positive", "neg": "negative", "neu": "neutral"}
