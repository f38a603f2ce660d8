"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"(?i)<(?!/)([^\s>]+)([^>]*)>"
#: Sizes within image URLs; a fixed pattern.
DIMS = r"(\d+x\d+)+|(w|h|s)_?\d+|\d+px|(width|height|w|h)=\d+|_\d+\."


def tags(html: Column) -> Column:
    """Lower-cased names of tags. The text is lower-cased as a whole, as a lambda over the names would leave generated code."""
    return F.regexp_extract_all(F.lower(html), F.lit(TAG), 1)


def words(text: Column) -> Column:
    """Split at space, tab, line feed, carriage return and form feed."""
    return F.array_remove(F.split(text, "[ \\t\\n\\r\\f]+"), "")


def http_parts(payload: Column) -> Column:
    """(header, body) at the first empty line; null where there is none."""
    at = F.instr(payload, "\r\n\r\n")
    return F.when(at > 0, F.struct(F.substring(payload, F.lit(1), at - 1).alias("header"), F.substring(payload, at + 4, F.length(payload)).alias("body")))


def cut_text(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > 0, F.substring(text, 1, most))


def preview(text: Column, most: int = 500) -> Column:
    return F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, "...").otherwise(""))


def ngrams(s: Column, least: int, most: int) -> Column:
    """All substrings of least to most characters, at all offsets, repeats kept."""

    def at(i):
        return F.transform(F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: i + n - 1 <= F.length(s)), lambda n: F.substring(s, i, n))

    return F.when(F.length(s) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), at))).otherwise(F.array().cast("array<string>"))


def decoded(u: Column) -> Column:
    return F.coalesce(F.try_url_decode(u), u)


def _plain_url(u: Column) -> Column:
    """Without what `http` begins up to the first `://` (without one, less its first two characters) and without what
    follows the last dot, if that is four characters at most."""
    bare = F.when(u.startswith("http"), F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(u)
    return F.regexp_replace(bare, r"\.[^.]{0,4}\z", "")


def url_tokens_a(u: Column) -> Column:
    """Decoded, without scheme and short extension, cut at slash, dot and dash; spaces stay in their tokens."""
    return F.array_remove(F.split(_plain_url(decoded(u)), r"[/.-]"), "")


def url_tokens_b(u: Column) -> Column:
    """Decoded and cut at all but letters, digits and underscores; the scheme stays."""
    return F.array_remove(F.split(decoded(u), r"\W+"), "")


def url_tokens_c(u: Column, lower: bool = True) -> Column:
    """As a, without decoding."""
    return F.array_remove(F.split(F.lower(_plain_url(u)) if lower else _plain_url(u), r"[/.-]"), "")


def gram_set(tokens: Column, least: int = 2, most: int = 15) -> Column:
    """The distinct n-grams of all tokens."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: ngrams(t, least, most))))


def alt_grams(alt: Column, least: int = 2, most: int = 15) -> Column:
    """The distinct n-grams of a whole alternative text; null where that is null or empty."""
    return F.when(F.length(alt) > 0, F.array_distinct(ngrams(alt, least, most)))


def modified_date(millis: Column) -> Column:
    """The time that many milliseconds after the beginning of 1970."""
    return F.timestamp_millis(millis.cast("bigint"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def image_name(u: Column) -> Column:
    return F.substring_index(u, "/", -1)


def suffix(u: Column) -> Column:
    return F.substring_index(image_name(u), ".", -1)


def url_dims(u: Column) -> Column:
    """(width, height) that a URL names, 0 where it doesn't. A pair ends the search; so does a number beyond 32 bits."""

    def step(acc, m):
        parts = F.filter(F.split(m, "x"), lambda x: x != "")
        a, b, v = (x.try_cast("int") for x in (digits(F.get(parts, F.lit(0))), digits(F.get(parts, F.lit(1))), digits(m)))
        wide = m.contains("w") | m.contains("s")
        pair = F.struct(F.coalesce(a, acc["w"]).alias("w"), F.when(a.isNull(), acc["h"]).otherwise(F.coalesce(b, acc["h"])).alias("h"), F.lit(True).alias("done"))
        one = F.struct(F.when(wide, F.coalesce(v, acc["w"])).otherwise(acc["w"]).alias("w"), F.when(wide, acc["h"]).otherwise(F.coalesce(v, acc["h"])).alias("h"), v.isNull().alias("done"))
        return F.when(acc["done"], acc).when(F.size(parts) > 1, pair).otherwise(one)

    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("h"), F.lit(False).alias("done"))
    found = F.aggregate(F.regexp_extract_all(u, F.lit(DIMS), 0), start, step)
    return F.struct(found["w"].alias("width"), found["h"].alias("height"))
