"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension.
KINDS = {
    "md": "md",
    "txt": "text",
    "csv": "text",
    "pdf": "pdf",
    "docx": "office",
    "xlsx": "office",
    "jpg": "image",
    "jpeg": "image",
    "png": "image",
    "webp": "image",
    "tif": "image",
    "tiff": "image",
    "bmp": "image",
}


def file_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, k in KINDS.items():
        out = F.when(ext == e, k).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def slugify(text: Column) -> Column:
    """Lower case; signs go; runs of spaces and underscores become one hyphen; no hyphens at the ends."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "^-+|-+$", "")


def memory_slug(text: Column) -> Column:
    """The first eight words of letters and digits, 60 characters at most."""
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), 1, 8)
    slug = F.regexp_replace(F.substring(F.array_join(words, "-"), 1, 60), "^-+|-+$", "")
    return F.when(slug == "", "memory").otherwise(slug)


def looks_like_text(text: Column) -> Column:
    """Five words of three letters or more, and letters are 0.6 of what is visible."""
    words = F.regexp_count(text, F.lit("[A-Za-z]{3,}"))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    return (words >= 5) & (letters >= 0.6 * visible)


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") * 2 > 9, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1))


def digit_runs(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: F.length(x).between(13, 19))


def identifiers(text: Column) -> Column:
    """Social security numbers, and card numbers: 13 to 19 digits, also with a space or hyphen after each, that pass the Luhn check."""
    cards = F.regexp_extract_all(text, F.lit(r"((?<!\d)(?:\d[ -]?){12,18}\d(?!\d))"), F.lit(1))
    return F.concat(F.regexp_extract_all(text, F.lit(r"((?<!\d)\d{3}-\d{2}-\d{4}(?!\d))"), F.lit(1)), F.filter(cards, lambda c: luhn_valid(F.regexp_replace(c, r"\D", ""))))


def substantial(value: Column) -> Column:
    return F.length(alnum(value)) >= 6


def alnum(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def mask(text: Column, values: Column) -> Column:
    """Each value replaced as a whole token by ``[pii …last4]``, all of them in one pass, the longest first.

    The values that the text has become one pattern; what it finds, from left to right, is replaced, and what was put in is
    not looked at again.  A value that ends in an ASCII letter or digit must not go on with one.  Values with fewer than six
    letters and digits are left alone, null values too; no values: the text; a null text: null.
    """
    there = F.filter(F.array_distinct(values), lambda v: v.isNotNull() & substantial(v) & text.contains(v))
    longest = F.array_sort(there, lambda a, b: F.length(b) - F.length(a))
    edge = lambda v, at, look: F.when(v.rlike(at), F.lit(look)).otherwise(F.lit(""))
    quoted = F.transform(longest, lambda v: F.concat(edge(v, "^[0-9A-Za-z]", "(?<![0-9A-Za-z])"), F.regexp_replace(v, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), edge(v, "[0-9A-Za-z]$", "(?![0-9A-Za-z])")))
    # Without values the pattern is one that matches nowhere.
    pattern = F.concat(F.lit("("), F.when(F.size(quoted) > 0, F.array_join(quoted, "|")).otherwise(F.lit("(?!)")), F.lit(")"))
    found = F.regexp_extract_all(text, pattern, F.lit(1))
    put = F.transform(found, lambda v: F.concat(F.lit("[pii …"), F.right(alnum(v), F.lit(4)), F.lit("]")))
    return F.when(F.size(there) > 0, F.array_join(F.zip_with(F.split(text, pattern, -1), put, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")).otherwise(text)


def recency(age_days: Column) -> Column:
    return F.least(F.lit(0.05), 0.1 * F.pow(F.lit(0.5), age_days / 60.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def page_of(text: Column, page: int, size: int = 40_000) -> Column:
    return F.substring(text, (page - 1) * size + 1, size)


def page_count(text: Column, size: int = 40_000) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / size))


def normal_path(path: Column) -> Column:
    """A relative path with ``.`` and ``..`` resolved; what climbs out keeps its ``..``."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(folded, "/")


def memory_title(text: Column) -> Column:
    """The first sentence, or all of a text without one; beyond 80 characters cut at a word."""
    plain = F.regexp_replace(F.regexp_replace(text, "^ +| +$", ""), r"\s+", " ")
    first = F.regexp_extract(plain, r"^(.*?[.!?])( |$)", 1)
    s = F.when(first == "", plain).otherwise(first)
    return F.when(F.length(s) <= 80, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, 80), " [^ ]*$", ""), F.lit("…")))


def display_name(shown: Column, name: Column, slug: Column) -> Column:
    """What is shown, else the name, else the slug with capitals."""
    return F.coalesce(F.nullif(shown, F.lit("")), F.nullif(name, F.lit("")), F.initcap(F.regexp_replace(slug, "-", " ")))


def good_tag(tag: Column) -> Column:
    return tag.rlike(r"^[a-z0-9-]+/[a-z0-9._-]+$") & ~tag.rlike("^(status|type)/")


def epoch(iso: Column) -> Column:
    """Seconds of an ISO string; without a zone it is in the session's; what is no date raises an error."""
    return F.unix_timestamp(F.to_timestamp(iso))


def iso_day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def rerank_text(title: Column, heading: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.concat_ws(" > ", title, heading), text)


def updated(path: Column) -> Column:
    """Whether an update looks at a path."""
    return path.endswith(".md") & ~path.rlike(r"(^|/)(_archive|\.obsidian)(/|$)")


def entity_of(path: Column, prefixes: dict[str, str]) -> Column:
    """The entity whose path prefix a path begins with, the longest one first; null for none."""
    out = F.lit(None).cast("string")
    for prefix in sorted(prefixes, key=len):
        out = F.when(path.startswith(prefix), prefixes[prefix]).otherwise(out)
    return out
