"""URL statistics of a crawl's images: pages, images and videos by host, cases, image hosts by page host, and totals.

All counts come from one pass: each image gives its entries, (section, elem, other), and one aggregation counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.functions import url as U
from arachne.operators.gates import has_source
from arachne.operators.media import first_of_each

SECTIONS = ("WEBPAGES", "IMAGES", "VIDEOS", "CASES", "DISTRIBUTION", "TOTALS")
_TOTALS = {"NEWS WEB PAGE COUNT": ("WEBPAGES", "all"), "NEWS IMAGE COUNT": ("IMAGES", "all"), "NEWS VIDEO COUNT": ("VIDEOS", "all"), "CASES COUNT TOTAL": ("CASES", "all"), "CASES COUNT UNIQUE": ("CASES", "kinds"), "UNIQUE DOMAINS": ("HOSTS", "kinds"), "UNIQUE URLS": ("URLS", "all")}


def unique_images(images: DataFrame) -> DataFrame:
    """images (src, pageUrl, ...) with normalizedSrc, one row for each: the one of the least page URL. Rows without a source or a page go."""
    n = images.filter(has_source()).withColumn("normalizedSrc", U.normalize_url(F.col("src"), F.col("pageUrl"))["normalized"])
    return first_of_each(n, "normalizedSrc", ["pageUrl", "src"])


def entries(unique: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(section, elem, other) that the images give. cases: (url) of known cases, which images that aren't videos are looked up in."""
    url, page = F.col("normalizedSrc"), F.regexp_replace("pageUrl", r"\s", "")
    u = unique.withColumns({"_url": url, "_ih": U.host(url), "_ph": U.host(page), "_video": U.is_video_url(url)})
    if cases is not None:
        u = u.join(cases.select(F.col("url").alias("_url"), F.lit(True).alias("_case")).distinct(), "_url", "left")
    else:
        u = u.withColumn("_case", F.lit(None).cast("boolean"))
    short = lambda c: U.strip_www(F.col(c))
    entry = lambda section, elem, other=None: F.struct(F.lit(section).alias("section"), elem.alias("elem"), (other if other is not None else F.lit(None)).cast("string").alias("other"))
    known = F.col("_ih").isNotNull()
    given = F.array(
        entry("URLS", F.lit("")),
        F.when(known & F.col("_video"), entry("VIDEOS", short("_ih"))),
        F.when(known & ~F.col("_video"), entry("IMAGES", short("_ih"))),
        F.when(known & ~F.col("_video") & F.col("_case"), entry("CASES", F.col("_url"))),
        F.when(known, entry("HOSTS", F.col("_ih"))),
        F.when(F.col("_ph").isNotNull(), entry("HOSTS", F.col("_ph"))),
        F.when(F.col("_ph").isNotNull(), entry("WEBPAGES", short("_ph"))),
        F.when(known & F.col("_ph").isNotNull(), entry("DISTRIBUTION", short("_ph"), F.col("_ih"))),
    )
    return u.select(F.explode(F.filter(given, lambda e: e.isNotNull())).alias("e")).select("e.*")


def report(images: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(section, elem, other, n): counts by host or URL, `other` being the image host in DISTRIBUTION, and TOTALS, 0 where there is nothing.

    Hosts lose a leading `www.`, but not the image hosts of DISTRIBUTION nor those that UNIQUE DOMAINS counts. Unique cases are the
    distinct ones. Distinct counts are exact.
    """
    counts = entries(unique_images(images), cases).groupBy("section", "elem", "other").agg(F.count("*").alias("n"))
    of = lambda section, what: F.coalesce(F.sum(F.when(F.col("section") == section, F.col("n") if what == "all" else F.lit(1))), F.lit(0)).cast("bigint")
    sums = counts.agg(F.map_from_arrays(F.array(*map(F.lit, _TOTALS)), F.array(*(of(*x) for x in _TOTALS.values()))).alias("m"))
    totals = sums.select(F.lit("TOTALS").alias("section"), F.explode("m").alias("elem", "n")).select("section", "elem", F.lit(None).cast("string").alias("other"), "n")
    return counts.filter(F.col("section").isin(*SECTIONS)).unionByName(totals)


def report_lines(rows: DataFrame) -> DataFrame:
    """(place, value): the report's lines in order: each section's name, then `elem n`, highest counts first, ties by elem. A page host's
    distribution has a line of its own before it."""
    head = "Image url distribution for host: "
    number = F.create_map(*(x for i, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(i))))[F.col("section")]
    in_group = F.col("section") == "DISTRIBUTION"
    group = F.when(in_group, F.col("elem")).otherwise(F.lit(""))
    lines = rows.select(number.alias("a"), group.alias("b"), F.lit(1).alias("c"), (-F.col("n")).alias("d"), F.coalesce("other", "elem").alias("e"), F.concat(F.coalesce("other", "elem"), F.when(F.col("section") == "TOTALS", ": ").otherwise(" "), F.col("n").cast("string")).alias("value"))
    names = rows.filter(~in_group).select(number.alias("a"), "section").distinct().select("a", F.lit("").alias("b"), F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("d"), F.lit("").alias("e"), F.col("section").alias("value"))
    hosts = rows.filter(in_group).select(number.alias("a"), "elem").distinct().select("a", F.col("elem").alias("b"), F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("d"), F.lit("").alias("e"), F.concat(F.lit(head), "elem").alias("value"))
    return lines.unionByName(names).unionByName(hosts).select(F.struct("a", "b", "c", "d", "e").alias("place"), "value")


def pair_rollup(images: DataFrame) -> DataFrame:
    """(page_host, image_host, n) with sums by page host and over all, where the host is null."""
    pairs = entries(unique_images(images)).filter("section = 'DISTRIBUTION'")
    return pairs.rollup(F.col("elem").alias("page_host"), F.col("other").alias("image_host")).agg(F.count("*").alias("n"))


