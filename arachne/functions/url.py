"""URL functions as Column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of media and video URLs, each for the whole URL. An unescaped dot is any character but a line end,
#: `https*` takes any number of s, and `watch?` makes the h optional.
MEDIA_SUFFIX = r"(?i).*\.(jpg|jpeg|png|gif|bmp|3gp|avi|flv|m4v|mov|mpg|mp4|mpeg|swf|wmv)$"
INSTAGRAM = r"https*://instagram.com/p/([\w\-]+)/"
YOUTUBE = r"https*://www.youtube.com/watch?.*v=([a-zA-Z0-9_\-]+)(&.+=.+)*"
VIMEO = r"https*://vimeo.com/([0-9]+)/*$"
TWITPIC = r"https*://twitpic.com/([A-Za-z0-9]+)/*.*$"
DAILYMOTION = r"https*://www.dailymotion.com/video/([A-Za-z0-9]+)_.*$"
FLICKR = r"https*://flickr.com/photos/([A-Za-z0-9@]+)/([A-Za-z0-9@]+)/*.*$"
VIDEO_SUFFIX = r"([^\s]+(\.(?i)(webm|mkv|flv|ogg|ogv|avi|mov|wmv|rm|mp4|m4v|mpg|mpeg|mp2|m2v|3gp|3g2|mxf))$)"
ABSOLUTE = r"^(?i)(https?|ftp|file|jar|mailto):"
HOST = r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)"
_PAGE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)"


def _any(u: Column, *patterns: str) -> Column:
    return F.coalesce(u.rlike(r"\A(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z"), F.lit(False))


def is_media_url(u: Column) -> Column:
    return _any(u, MEDIA_SUFFIX, INSTAGRAM, YOUTUBE, VIMEO, DAILYMOTION, FLICKR, TWITPIC)


def is_video_url(u: Column) -> Column:
    return _any(u, VIDEO_SUFFIX, YOUTUBE, VIMEO, DAILYMOTION)


def is_absolute(u: Column) -> Column:
    return F.coalesce(u.rlike(ABSOLUTE), F.lit(False))


def host(u: Column) -> Column:
    """Null where the URL has no scheme and host."""
    return F.nullif(F.regexp_extract(u, HOST, 1), F.lit(""))


def strip_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce((F.lower(host(a)) == F.lower(host(b))).cast("int"), F.lit(0))


def url_uuid(u: Column) -> Column:
    """Version 3 UUID of a URL's bytes."""
    h = F.md5(u.cast("binary"))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.substring(variant, (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def extension_of(content_type: Column) -> Column:
    return F.substring_index(content_type, "/", -1)


def normalize_url(src: Column, page: Column, insert_slash: bool = True) -> Column:
    """(normalized, success) of an image URL on a page. An absolute URL stays, with success false.

    A relative one stands under the page's scheme and host, without port; each `..` climbs from the page's path while
    the last slash is beyond its third character.
    """
    u, p = F.regexp_replace(src, r"\s", ""), F.regexp_replace(page, r"\s", "")
    site = F.concat(F.regexp_extract(p, _PAGE, 1), F.lit("://"), F.regexp_extract(p, _PAGE, 2))
    pieces = F.split(F.regexp_replace(u, r"(?:\.\.)+$", ""), r"\.\.")

    def climb(path, _):
        slash = F.length(path) - F.length(F.substring_index(path, "/", -1))
        return F.when(slash > 3, F.substring(path, F.lit(1), slash - 1)).otherwise(path)

    climbed = F.aggregate(F.sequence(F.lit(1), F.size(pieces)), F.regexp_extract(p, _PAGE, 3), climb)
    slash = F.when(u.startswith("/") | F.lit(not insert_slash), F.lit("")).otherwise(F.lit("/"))
    relative = F.when(F.size(pieces) > 1, F.concat(site, climbed, F.element_at(pieces, -1))).otherwise(F.concat(site, slash, u))
    works = ~is_absolute(u) & F.coalesce(p.rlike(_PAGE), F.lit(False))
    return F.struct(F.when(works, relative).otherwise(u).alias("normalized"), works.alias("success"))


def resolve_url(src: Column, page: Column) -> Column:
    """RFC 3986 resolution, by an Arrow UDF; null where either is null or no URL."""
    @F.pandas_udf("string")
    def joined(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return urljoin(y, x) if x is not None and y is not None else None
            except ValueError:
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return joined(src, page)
