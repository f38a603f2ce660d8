"""Class balance, n-gram vocabularies, features, forests, arbitration and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arachne.functions import text as X
from arachne.functions import url as U
from arachne.operators.order import before_each, by_ranges

SUFFIXES = ("jpeg", "png", "bmp", "gif", "tiff")
ELEMENTS = ("img", "link", "a", "embed", "iframe", "object")


def balance(rows: DataFrame, small: Column, big: Column, order: list[Column], parts: int | None = None) -> DataFrame:
    """In order, every big row stays, and a small one unless more small than big ones have been kept so far.

    Closed form: with running counts S and B, the kept small ones are S + min(0, min over earlier rows of B + 1 - S). The
    rows are dealt by ranges of their order; each range is counted by itself, and the counts of earlier ranges are added.
    Rows that are both count as small, rows that are neither go first of all. Nulls count as false. No rows: none.
    """
    none = F.lit(False)
    s, b = F.coalesce(small, none), F.coalesce(big, none)
    marked = rows.withColumns({"_s": s.cast("int"), "_b": (b & ~s).cast("int")}).filter("_s + _b > 0")
    laid = by_ranges(marked, order, parts)
    here = Window.partitionBy("_part").orderBy("_at")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    r = laid.withColumns({"_smalls": F.sum("_s").over(upto), "_bigs": F.sum("_b").over(upto)})
    r = r.withColumn("_room", F.min(F.col("_bigs") + 1 - F.col("_smalls")).over(upto))
    ends = before_each(r.groupBy("_part").agg(F.sum("_s").alias("_es"), F.sum("_b").alias("_eb"), F.min("_room").alias("_er")), {"_s0": "_es", "_b0": "_eb"})
    ends = ends.withColumn("_r0", F.min(F.col("_er") + F.col("_b0") - F.col("_s0")).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    r = r.join(F.broadcast(ends.select("_part", "_s0", "_b0", "_r0")), "_part")  # a row for each range
    r = r.withColumn("_k", F.col("_s0") + F.col("_smalls") + F.least(F.lit(0), "_r0", F.col("_b0") - F.col("_s0") + F.col("_room")))
    r = r.withColumn("_was", F.coalesce(F.lag("_k").over(here), F.col("_s0") + F.least(F.lit(0), "_r0")))
    return r.filter((F.col("_b") == 1) | (F.col("_k") > F.col("_was"))).select(*(F.col(f"`{c}`") for c in rows.columns))


def label_by_dims(w: Column, h: Column) -> Column:
    return F.when((w < 200) & (h < 200), "SMALL").when((w > 400) & (h > 400), "BIG")


def ngram_counts(rows: DataFrame, tokens: Column, least: int, most: int, cls: Column | None = None, having: int = 1) -> DataFrame:
    """(cls, ngram, n): n-grams are made once for each distinct token and weighed by its count."""
    t = rows.select((cls if cls is not None else F.lit("ALL")).alias("cls"), F.explode(tokens).alias("token")).groupBy("cls", "token").agg(F.count("*").alias("c"))
    return t.select("cls", "c", F.explode(X.ngrams(F.col("token"), least, most)).alias("ngram")).groupBy("cls", "ngram").agg(F.sum("c").alias("n")).filter(F.col("n") >= having)


def vocabulary(freq: DataFrame, top: int = 500, exclusive: int | None = None, lower: bool = False) -> DataFrame:
    """(idx, ngram, cls, score) from (cls, ngram, n) of BIG and SMALL: the difference to the other class where positive;
    n-grams of one class score their count, or `exclusive`. The best `top` of each class, BIG first, ties by n-gram."""
    other = F.sum("n").over(Window.partitionBy("ngram")) - F.col("n")
    alone = F.count("*").over(Window.partitionBy("ngram")) == 1
    own = F.lit(exclusive).cast("bigint") if exclusive is not None else F.col("n")
    s = freq.withColumn("score", F.when(alone, own).otherwise(F.col("n") - other)).filter("score > 0")
    return _stacked(s, top, lower)


def _stacked(scored: DataFrame, top: int, lower: bool) -> DataFrame:
    """The best `top` of each class, BIG first, with their numbers from 0."""
    s = scored.withColumn("rank", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "ngram"))).filter(F.col("rank") <= top)
    first = s.groupBy().agg(F.coalesce(F.max(F.when(F.col("cls") == "BIG", F.col("rank"))), F.lit(0)).alias("bigs"))
    s = s.crossJoin(F.broadcast(first))  # one row
    ngram = F.lower("ngram") if lower else F.col("ngram")
    return s.select((F.col("rank") - 1 + F.when(F.col("cls") == "BIG", 0).otherwise(F.col("bigs"))).alias("idx"), ngram.alias("ngram"), "cls", "score")


def prune_substrings(freq: DataFrame) -> DataFrame:
    """Without n-grams that a longer one of their class contains, ignoring case. Every n-gram gives its shorter substrings,
    so an equi-join finds the contained ones."""
    parts = freq.select("cls", F.explode(F.array_distinct(X.ngrams(F.lower("ngram"), 1, 15))).alias("part"), F.length("ngram").alias("longer")).filter(F.length("part") < F.col("longer"))
    inner = parts.select("cls", "part").distinct()
    return freq.withColumn("part", F.lower("ngram")).join(inner, ["cls", "part"], "left_anti").select(*freq.columns)


def pruned_vocabulary(freq: DataFrame, top: int = 1000, exclusive: int = 50) -> DataFrame:
    """(idx, ngram, cls, score) from (cls, ngram, n) of BIG and SMALL, in lower case.

    Each class is pruned by prune_substrings. BIG is scored against all of SMALL, SMALL against what is left of BIG: the
    difference where positive, and `exclusive` where the other side lacks the n-gram. Two spellings that lower case makes
    equal keep a row each.
    """
    left = prune_substrings(freq)
    bigs, smalls = (left.filter(F.col("cls") == c).select("cls", "ngram", "n") for c in ("BIG", "SMALL"))
    against = [freq.filter("cls = 'SMALL'"), bigs]
    scored = None
    for own, other in zip((bigs, smalls), against, strict=True):
        other = other.select("ngram", F.col("n").alias("m"))
        part = own.join(other, "ngram", "left").select("cls", "ngram", F.when(F.col("m").isNull(), F.lit(exclusive)).otherwise(F.col("n") - F.col("m")).cast("bigint").alias("score"))
        scored = part if scored is None else scored.unionByName(part)
    return _stacked(scored.filter("score > 0"), top, lower=True)


def exclusive_ngrams(freq: DataFrame, cls: str) -> DataFrame:
    others = freq.filter(F.col("cls") != cls).select("ngram")
    return freq.filter(F.col("cls") == cls).join(others, "ngram", "left_anti").select("ngram", "n")


def ngram_vector(rows: DataFrame, key: str, tokens: Column, vocab: DataFrame, least: int = 2, most: int = 15) -> DataFrame:
    """(key, hits): sorted indexes of the vocabulary's n-grams that occur; rows with none are left out."""
    grams = rows.select(key, F.explode(tokens).alias("token")).select(key, F.explode(X.ngrams(F.col("token"), least, most)).alias("ngram")).distinct()
    return grams.join(vocab.select("idx", "ngram"), "ngram").groupBy(key).agg(F.sort_array(F.collect_set("idx")).alias("hits"))


def features23(images: DataFrame) -> DataFrame:
    """The images' columns and the 23 features, in their order. URLs are the normalised ones, `normalizedSrc`; a null one has no suffix, sizes of 0 and
    length 0."""
    url = F.coalesce(F.col("normalizedSrc"), F.lit(""))
    d = X.url_dims(url)
    s = X.suffix(url)
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    columns = {f"suffix_{x}": (s == x).cast("int") for x in SUFFIXES}
    columns |= {"f_domDepth": F.coalesce("domDepth", F.lit(0)), "f_domSiblings": F.coalesce("domSib", F.lit(0)), "hasWidth": (d["width"] > 0).cast("int"), "width": d["width"], "hasHeight": (d["height"] > 0).cast("int"), "height": d["height"], "samedomain": U.same_domain(url, F.col("pageUrl"))}
    columns |= {f"dom_{e}": F.coalesce((F.col("domElem") == e).cast("int"), F.lit(0)) for e in ELEMENTS}
    columns |= {"hasAltText": (n("alt") > 0).cast("int"), "altTextLength": n("alt"), "hasParentText": (n("parentTxt") > 0).cast("int"), "parentTextLength": n("parentTxt"), "urlLength": F.length(url)}
    return images.withColumns(columns)


def train_forest(rows: DataFrame, features: list[str], label: str, trees: int = 30, seed: int = 1, depth: int = 30):
    """A pipeline model with a probability column. Features are numbers or vectors; Spark bounds the depth of trees at 30. Each row's node in each tree
    is kept from level to level, so that a level doesn't walk all rows from the roots again."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="log2", seed=seed, cacheNodeIds=True)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(rows)


def arbitrate(c1: Column, d1: Column, c2: Column, d2: Column, margin: float = 0.05) -> Column:
    """The class both models give; else the first one's where its distribution is decided enough."""
    gap = lambda d: F.abs(d[0] - d[1])
    return F.when(c1 == c2, c1).when(gap(d1) + margin > gap(d2), c1).otherwise(c2)


def class_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(cls, tp, fp, fn, precision, recall, f1) of BIG (1) and SMALL (0); 0 where a ratio has no divisor."""
    c = class_metrics(rows, label, predicted)
    sides = F.array(*(F.struct(F.lit(name).alias("cls"), *(F.col(x).alias(y) for x, y in zip(of, ("tp", "fp", "fn"), strict=True))) for name, of in (("BIG", ("tp", "fp", "fn")), ("SMALL", ("tn", "fn", "fp")))))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.explode(sides).alias("s")).select("s.*").select("cls", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """tp, fp, fn, F1 of class 1 (big) and 0 (small), and their mean, in one row."""
    n = lambda y, p: F.sum(((F.col(label) == y) & (F.col(predicted) == p)).cast("bigint"))
    c = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    f1 = lambda tp: F.coalesce(F.try_divide(2.0 * F.col(tp), 2 * F.col(tp) + F.col("fp") + F.col("fn")), F.lit(0.0))
    c = c.withColumns({"f1_big": F.round(f1("tp"), 6), "f1_small": F.round(f1("tn"), 6)})
    return c.withColumn("f1_mean", F.round((F.col("f1_big") + F.col("f1_small")) / 2, 6))
