"""String and date expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as V

WHITESPACE = r"\s+"


def lookup(col: Column, table: dict) -> Column:
    """Value of `col` in a fixed table, null when absent.

    Built from arrays so that it folds to one map literal; a map of key-value
    pairs would be rewritten to a CASE too long to compile.
    """
    keys, values = F.array(*[F.lit(k) for k in table]), F.array(*[F.lit(v) for v in table.values()])
    return F.map_from_arrays(keys, values).getItem(col)


def clean(col: Column) -> Column:
    """Trimmed lower-case text, empty for null."""
    return F.lower(F.trim(F.coalesce(col, F.lit(""))))


def to_double(col: Column) -> Column:
    """Plain decimal text as a number; anything else is null."""
    plain = F.trim(col)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def parse_measure(raw: Column) -> Column:
    """A length in metres from "12", "12 m", "12,5", "40'", "40ft" or "3;4"."""
    first = F.replace(F.trim(F.split(F.trim(raw), ";").getItem(0)), F.lit(","), F.lit("."))
    feet = first.rlike(r"('|ft)$")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(first, r"'+$", ""), r"ft$", ""), r"m$", ""))
    value = to_double(body)
    return F.when(F.length(raw) > 0, F.when(feet, value * 0.3048).otherwise(value))


def first_word_number(raw: Column) -> Column:
    """The first whitespace-separated word as a number, decimal comma allowed."""
    word = F.split(F.trim(raw), WHITESPACE).getItem(0)
    return F.when(F.length(F.trim(raw)) > 0, to_double(F.replace(word, F.lit(","), F.lit("."))))


def leading_number(*candidates: Column) -> Column:
    """The first candidate that reads as a number."""
    return F.coalesce(*[first_word_number(c) for c in candidates])


def parse_population(raw: Column) -> Column:
    """A head count with thousands separators: "12,345 ; 2020" is 12345."""
    text = F.regexp_replace(F.split(raw, ";").getItem(0), r"[,\s]", "")
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))


def species_tokens(raw: Column) -> Column:
    """Lower-case species names, split on commas, semicolons and blanks."""
    text = F.lower(F.coalesce(raw, F.lit("")))
    return F.array_distinct(F.filter(F.split(F.regexp_replace(text, "[,;]", " "), WHITESPACE), lambda w: w != ""))


def version_key(raw: Column) -> Column:
    """Up to four integers of a version string; arrays compare element by element."""
    parts = F.slice(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), 1, 4)
    ints = F.transform(parts, lambda p: p.try_cast("int"))
    return F.when(F.size(ints) > 0, ints).otherwise(F.array(F.lit(0)))


def safe_name(raw: Column) -> Column:
    """A file-safe slug of at most 60 characters."""
    slug = F.substring(F.regexp_replace(raw, r"[^A-Za-z0-9_.-]+", "_"), 1, 60)
    return F.when(slug == "", F.lit("x")).otherwise(slug)


def piece_name(parent: Column, row: Column, col: Column) -> Column:
    return F.concat(parent, F.lit("__r"), row.cast("string"), F.lit("_c"), col.cast("string"))


def private_masks(user: str | None, home: str | None) -> list[tuple[str, str]]:
    """(pattern, what is shown instead) for whatever names a person, in the order of use.

    The folder that is somebody's home is known by its path, with either separator; any
    other home by the folder of users it lies in; and the name may stand by itself. Names
    and paths of a few letters would hide other words, so they are left.
    """
    quote = lambda part: r"\Q" + part + r"\E"
    masks = []
    if home and len(home) > 3:
        masks.append((r"[\\/]".join(quote(part) if part else "" for part in re.split(r"[\\/]", home)), "<home>"))
    masks.append((r"(?i)(?<=[\\/]users[\\/])[^\s\\/\"']+", "<you>"))
    if user and len(user) > 2:
        masks.append(("(?i)" + quote(user), "<you>"))
    return masks


def redact_user(text: Column, user: str | None = None, home: str | None = None) -> Column:
    """Text without the names of persons: see `private_masks`."""
    return reduce(lambda masked, mask: F.regexp_replace(masked, *mask), private_masks(user, home), text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


# Said on every page of the source, whatever it answers.
CREDITED = "openstreetmap.org"


def error_text(body: Column, limit: int = 400) -> Column:
    """What a web page says went wrong: its paragraphs about an error, else all of them; other bodies as they are.

    A page is told by its first characters. What follows an opening paragraph mark, up to
    the next closing one, is text with marks in it; the marks count as blanks.
    """
    opened = F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    said = F.transform(opened, lambda p: squeeze(F.regexp_replace(p, "<[^>]+>", " ")))
    said = F.filter(said, lambda p: (F.length(p) > 0) & ~F.contains(F.lower(p), F.lit(CREDITED)))
    wrong = F.filter(said, lambda p: F.contains(F.lower(p), F.lit("error")))
    told = F.left(F.array_join(F.when(F.size(wrong) > 0, wrong).otherwise(said), " | "), F.lit(limit))
    is_page = F.contains(F.lower(F.left(body, F.lit(400))), F.lit("<html"))
    return F.when(is_page & (told != ""), told).otherwise(F.left(squeeze(body), F.lit(limit)))


def name_override(name: Column, way_name: Column, renamed: Column, hidden: Column) -> Column:
    """A way's own name edit, else the renamed street, else the mapped name; hidden names are null."""
    shown = F.coalesce(way_name, renamed, name)
    return F.when(F.coalesce(hidden, F.lit(False)), F.lit(None)).otherwise(shown)


def needs_refresh(saved_at: Column, built_at: Column) -> Column:
    """An overlay is pending unless it was saved no later than the build that read it."""
    return ~F.coalesce(saved_at <= built_at, F.lit(False))


def still_fresh(stamped: Column, modified: Column, now: Column, hours: int = 20) -> Column:
    """A file without a stamp stays fresh for some hours; a stamped one must match."""
    young = (now.cast("double") - modified.cast("double")) < hours * 3600.0
    return F.coalesce(stamped, young)


def first_tag_key(tags: Column, keys: list[str], skip: dict[str, list[str]] | None = None) -> Column:
    """The first key present whose value is not on that key's skip list."""
    skip = skip or {}
    tests = []
    for key in keys:
        value = tags.getItem(key)
        ok = value.isNotNull()
        if key in skip:
            ok = ok & ~value.isin(skip[key])
        tests.append(F.when(ok, F.lit(key)))
    return F.coalesce(*tests)


def landmark_key(tags: Column) -> Column:
    return first_tag_key(tags, V.LANDMARK_KEYS, {"building": V.BORING_BUILDING_VALUES})


def tag_pairs(raw: Column) -> Column:
    """A flat JSON object as a tag map; anything else is null."""
    return F.from_json(raw, "map<string,string>")
