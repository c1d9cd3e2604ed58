"""Text functions of catalogue resolution, as Column expressions inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing value.
NULL_TOKENS = ["", "none", "nan", "null"]
#: Words in a parenthesis that name a version of a title.
VERSION_WORDS = "version|mix|remaster|live|edit|mono|stereo|album|explicit|clean|instrumental|demo"


def clean_optional_text(c: Column) -> Column:
    """Without NULs and white space around; a null token becomes the empty string."""
    t = strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit("")))
    return F.when(F.lower(t).isin(NULL_TOKENS), F.lit("")).otherwise(t)


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(clean_optional_text(c), F.lit("")) for c in cols), F.lit(""))


def format_scalar(c: Column) -> Column:
    """Six decimals without trailing zeros; not finite or null: empty."""
    text = F.rtrim(F.rtrim(F.format_string("%.6f", c), F.lit("0")), F.lit("."))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit("")).otherwise(text)


def join_tags(tags: Column) -> Column:
    return F.array_join(F.filter(F.transform(tags, clean_optional_text), lambda x: x != ""), "|")


def normalize_search_text(c: Column) -> Column:
    """Lower case, ``&`` as "and", without parentheses, brackets and what is no ASCII letter or digit."""
    t = F.replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")), F.lit("_"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


#: Patterns of what is cut from titles and artists before a search.
TITLE_VERSION = rf"(?iu)\(([^)]*({VERSION_WORDS})[^)]*)\)"
ARTIST_GUEST = r"(?iu)\b(feat(?:uring)?|ft\.?|with)\b.*$"


def _plain(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))


def _collapsed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" -"))


def clean_title(c: Column) -> Column:
    """Without version notes in parentheses, brackets, and dashes around."""
    return _collapsed(F.regexp_replace(F.regexp_replace(_plain(c), TITLE_VERSION, " "), r"\[[^\]]*\]", " "))


def clean_artist(c: Column) -> Column:
    """Without guests, parentheses, and dashes around."""
    return _collapsed(F.regexp_replace(F.regexp_replace(_plain(c), ARTIST_GUEST, " "), r"\([^)]*\)", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind around."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sanitize_filename(c: Column) -> Column:
    return F.rtrim(strip(F.regexp_replace(c, r'[<>:"/\\|?*]', "_")), F.lit("."))


def truncate_component(c: Column, most: Column) -> Column:
    """A file name's part of ``most`` characters at most, with dots for what is cut."""
    t = sanitize_filename(c)
    cut = F.concat(F.rtrim(F.substr(t, F.lit(1), most - 3), F.lit(" ._")), F.lit("..."))
    return F.when(most <= 0, "").when(F.length(t) <= most, t).when(most <= 3, F.substr(t, F.lit(1), most)).otherwise(cut)


#: Characters of a file name at most, and of its base at least.
FILENAME, FILENAME_BASE = 180, 24


def build_filename(catalogue_id: Column, candidate_id: Column, artist: Column, title: Column) -> Column:
    """``Artist - Title [TR..] [deezer-..].mp3``, the base cut so that all fits."""
    ids = F.filter(F.array(catalogue_id, F.when(clean_optional_text(candidate_id) != "", F.concat(F.lit("deezer-"), clean_optional_text(candidate_id))).otherwise("")), lambda x: x != "")
    suffix = F.when(F.size(ids) > 0, F.concat(F.lit(" ["), F.array_join(ids, "] ["), F.lit("]"))).otherwise("")
    base = F.concat(first_non_blank(artist, F.lit("Unknown Artist")), F.lit(" - "), first_non_blank(title, F.lit("Unknown Title")))
    return F.concat(truncate_component(base, F.greatest(F.lit(FILENAME_BASE), FILENAME - F.length(suffix) - 4)), suffix, F.lit(".mp3"))


def stem(path: Column) -> Column:
    """A path's last part without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def parse_artist_title(filename: Column) -> tuple[Column, Column]:
    """What stands before and after the first dash, up to the first bracket."""
    s = stem(filename)
    s = F.when(s.contains("["), strip(F.substring_index(s, "[", 1))).otherwise(s)
    at = F.instr(s, " - ")
    return F.when(at > 0, strip(F.substr(s, F.lit(1), at - 1))).otherwise(""), strip(F.when(at > 0, F.substr(s, at + 3)).otherwise(s))


def search_queries(title: Column, artist: Column) -> Column:
    """Up to six distinct queries in order, the strictest first."""
    t, a = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(artist, F.lit("")))
    ct, ca = clean_title(t), clean_artist(a)
    strict = lambda x, y: F.when((x != "") & (y != ""), F.concat(F.lit('track:"'), x, F.lit('" artist:"'), y, F.lit('"'))).otherwise("")
    both = lambda x, y: strip(F.concat(x, F.lit(" "), y))
    return F.array_distinct(F.filter(F.array(strict(t, a), strict(ct, ca), both(ct, ca), both(t, ca), both(ct, a), ct), lambda q: q != ""))


def number(c: Column) -> Column:
    """A finite number or null."""
    x = clean_optional_text(c.cast("string")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def whole(c: Column) -> Column:
    """The integer part of a number or null."""
    x = number(c)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def boolean(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def clean_year(c: Column) -> Column:
    """A positive year as digits; what is no number stays."""
    t, year = clean_optional_text(c), whole(c)
    return F.when(t == "", "").when(year.isNull(), t).when(year <= 0, "").otherwise(year.cast("string"))


def track_digits(c: Column) -> Column:
    """An id such as ``123.0`` as digits; else empty."""
    return F.coalesce(whole(c).cast("string"), F.lit(""))


def song_id(catalogue_id: Column, candidate_id: Column, feature_path: Column, audio_path: Column, index: Column) -> Column:
    """The first id that there is: of the catalogue, of the candidate, of a file's stem, of the row's place."""
    other = clean_optional_text(candidate_id)
    return F.coalesce(
        F.nullif(clean_optional_text(catalogue_id), F.lit("")),
        F.when(other != "", F.concat(F.lit("deezer_"), other)),
        *(F.when(clean_optional_text(p) != "", stem(clean_optional_text(p))) for p in (feature_path, audio_path)),
        F.format_string("song_%05d", index),
    )


def shard_path(track: Column) -> Column:
    """``C/D/E/id.h5`` by an id's third to fifth characters; a shorter one has none."""
    at = lambda i: F.substr(track, F.lit(i), F.lit(1))
    return F.when(F.length(track) < 5, "").otherwise(F.concat_ws("/", at(3), at(4), at(5), F.concat(track, F.lit(".h5"))))


def slug(c: Column, default: str = "features") -> Column:
    """A name that is safe in paths."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), F.lit("_")), F.lit("")), F.lit(default))


def duration_text(seconds: Column) -> Column:
    """``1h02m03s``, ``2m03s`` or ``3s``."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def human_size(n: Column, largest: str = "TB") -> Column:
    """Bytes in the largest unit, up to ``largest``, that leaves one or more; ties between tenths go to the even one."""
    units = ["B", "KB", "MB", "GB", "TB"]
    units = units[: units.index(largest) + 1]
    whole = n.cast("double").cast("long")
    out = F.format_string("%d B", n)
    for k, unit in list(enumerate(units))[1:]:
        # exact in integers: a formatter that rounds halves up differs
        bits = 10 * k
        rest = whole.bitwiseAND(F.lit((1 << bits) - 1)) * 10
        tenths = F.shiftright(whole, bits) * 10 + F.shiftright(rest, bits)
        over, half = rest.bitwiseAND(F.lit((1 << bits) - 1)), 1 << (bits - 1)
        tenths = tenths + F.when((over > half) | ((over == half) & (tenths % 2 == 1)), 1).otherwise(0)
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1 << bits, text).otherwise(out)
    return out


def join_tag_counts(tags: Column, counts: Column) -> Column:
    """``tag:count`` by bars; blank tags go, a missing count is 0."""
    pairs = F.zip_with(tags, counts, lambda t, n: F.when(clean_optional_text(t) != "", F.concat(clean_optional_text(t), F.lit(":"), F.coalesce(n.cast("string"), F.lit("0")))))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "|")


def reason(cluster: Column, agreement: Column) -> Column:
    """Why a row is recommended: the algorithm whose cluster is shared (null: none), and how many agree."""
    same = F.when(cluster.isNotNull(), F.concat(F.lit("same "), F.upper(cluster), F.lit(" cluster")))
    noun = F.when(agreement == 1, "algorithm").otherwise("algorithms")
    agree = F.when(agreement > 0, F.format_string("%d clustering %s agree", agreement, noun))
    return F.concat_ws(", ", same, agree, F.lit("close in feature space"))


def tokens(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, " ")), lambda x: x != "")


def token_overlap(expected: Column, actual: Column) -> Column:
    """Share of the expected tokens that are there, after normalisation of both; none expected: 0."""
    e, a = tokens(normalize_search_text(expected)), tokens(normalize_search_text(actual))
    return F.when(F.size(e) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(e, a)) / F.size(e))


def exactish(expected: Column, actual: Column) -> Column:
    """Whether one holds the other after normalisation, neither being empty."""
    a, b = normalize_search_text(expected), normalize_search_text(actual)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


#: Weights of a candidate's agreement, and bands of the duration gap.
def candidate_score(title_exact: Column, artist_exact: Column, title_overlap: Column, artist_overlap: Column, preview: Column, delta: Column) -> Column:
    """Weighted agreement of a catalogue row and a candidate; ``delta`` is the duration gap, null where unknown."""
    band = F.when(delta <= 5, 2.0).when(delta <= 10, 1.0).when(delta >= 30, -4.0).when(delta >= 20, -2.0).otherwise(0.0)
    return 4.0 * title_exact.cast("int") + 3.0 * artist_exact.cast("int") + 3.0 * title_overlap + 2.5 * artist_overlap + F.when(preview, 1.0).otherwise(-5.0) + band


def confident(title_exact: Column, artist_exact: Column, title_overlap: Column, artist_overlap: Column, no_artist: Column, delta: Column) -> Column:
    near = delta.isNull() | (delta <= 12)
    strong = title_exact & (artist_exact | (artist_overlap >= 0.5))
    fair = (title_overlap >= 0.75) & (no_artist | (artist_overlap >= 0.6))
    return F.coalesce(delta <= 30, F.lit(True)) & (strong | fair) & near
