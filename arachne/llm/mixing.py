"""Mixing sources to target weights, with DataFrame functions only.

Each document has a hash. A source's words are summed by hash bucket; the running sum tells in which bucket a budget ends,
and only that bucket is summed again by the next bits of the hash, until it holds one hash. Documents below the threshold
found are taken, by a filter and without a sort. Thresholds are nested: a larger budget takes all that a smaller one does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arachne.llm.shared import cut

#: Bits of the hash in all, and by level.
HASH_BITS, LEVEL_BITS = 60, 10
WEIGHTS = (3, 1, 2)
#: A source with more than one row in so many is sent to all tasks.
HOT = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hash60(column: Column) -> Column:
    """The first 15 hexadecimal digits of the md5 of a value as text, as a number; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, weigh `weights` in turn and divide `share` of all sizes. A target stops at `most` times
    its source's size and the excess goes to the others by weight. Sorted by that bound over the weight, the sources that
    stop are the first ones, so running sums give the level of the others. One task sees a row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = by_source.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights) + 1).cast("int"))).withColumn("bound", most * F.col("source_size"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = Window.orderBy(F.col("bound") / F.col("weight"), "i")
    before = stopped.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumns({
        "rest": F.sum("source_size").over(every) * share - F.coalesce(F.sum("bound").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the first source that its bound doesn't stop, and all after it, share what is left
    level = level.withColumn("free", F.col("rest") / F.col("left") < F.col("bound") / F.col("weight"))
    level = level.withColumn("level", F.max(F.when(F.col("free"), F.struct(-F.col("bound") / F.col("weight"), -F.col("i"), F.col("rest") / F.col("left")))).over(every)["col3"])
    return level.select("source", "source_size", F.coalesce(F.least("bound", F.col("level") * F.col("weight")), "bound").cast("double").alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(s, below): take documents of source s whose hash is under `below`. budgets: (s, budget).

    The hash at which a budget ends belongs to it if that comes nearer to the budget.
    """
    state = budgets.select("s", "budget", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("sum_before"), F.lit(None).cast("bigint").alias("below"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        width = 1 << (HASH_BITS - LEVEL_BITS * (level - 1))
        open_ones = state.filter("below is null").select(F.col("s").alias("t"), "budget", "low", "sum_before")
        inside = docs.join(open_ones, (_same("s", "t")) & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(width)))
        buckets = inside.groupBy("t", "budget", "low", "sum_before", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("in_bucket"), F.min("h").alias("least"), F.max("h").alias("top"))
        running = buckets.withColumn("upto", F.col("sum_before") + F.sum("in_bucket").over(Window.partitionBy("t").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        ends = running.filter("upto > budget").groupBy("t").agg(F.min(F.struct("bucket", "in_bucket", "upto", "least", "top", "budget")).alias("e")).select("t", "e.*")
        one = F.col("least") == F.col("top")
        with_it = F.col("upto") - F.col("budget") < F.col("budget") - (F.col("upto") - F.col("in_bucket"))
        found = ends.select(F.col("t").alias("t2"), F.shiftleft("bucket", shift).alias("new_low"), (F.col("upto") - F.col("in_bucket")).alias("new_before"), F.when(one & with_it, F.col("top") + 1).when(one, F.col("least")).alias("new_below"))
        last = 1 << HASH_BITS
        joined = state.join(found, _same("s", "t2"), "left")
        is_found = F.col("new_low").isNotNull()
        state = cut(joined.select(
            "s", "budget",
            F.when(F.col("below").isNull() & is_found, F.col("new_low")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("below").isNull() & is_found, F.col("new_before")).otherwise(F.col("sum_before")).alias("sum_before"),
            F.coalesce("below", F.when(is_found, F.col("new_below")).otherwise(F.lit(last))).cast("bigint").alias("below"),
        ))
        if not state.filter("below is null").head(1):
            break
    return state.select("s", "below")


def _by_source(rows: DataFrame, plan: DataFrame, column: str) -> DataFrame:
    """rows joined to the row of their source. Sources with at least one row in HOT, HOT sources at most, are broadcast, so their rows stay
    where they are; the others' rows, if there are any, meet their sources by a shuffle in which no source is large."""
    hot, cold = plan.filter("hot").drop("hot"), plan.filter("not hot").drop("hot")
    out = rows.join(F.broadcast(hot), _same(column, "t"))
    if not cold.head(1):
        return out
    others = rows.join(F.broadcast(hot.select("t")), _same(column, "t"), "left_anti")
    return out.unionByName(others.join(cold, _same(column, "t")))


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(t, source_size, target, whole, below, hot) of each source t, from (s, size, h) rows that are read several times."""
    targets = cut(source_targets(rows.select(F.col("s").alias("source"), "size"), weights, share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")))
    budgets = targets.select(F.col("source").alias("s"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    many = rows.groupBy("s").agg(F.count("*").alias("n"))
    least = (many.agg(F.sum("n")).first()[0] or 0) / HOT
    plan = targets.join(_thresholds(rows, budgets), _same("source", "s")).drop("s").join(many, _same("source", "s"))
    return cut(plan.select(F.col("source").alias("t"), "source_size", "target", "whole", "below", (F.col("n") >= least).alias("hot")))


def _copies() -> Column:
    more = (F.col("h") < F.col("below")) & (F.col("whole") * F.col("source_size") < F.col("target"))
    return F.col("whole") + more.cast("int")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, copies, taken) for each row of docs.

    size: words of the text, 0 if null or empty. A row is taken floor(target / source size) times, and once more if its
    id's hash is below its source's threshold; taken is its size times that. Rows with one id go together, as do all
    with a null id. A source without words takes nothing. Reruns agree, however the rows are dealt. No rows: none.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("s"), word_count(F.col(text_col).cast("string")).alias("size"), hash60(F.col(id_col)).alias("h")))
    out = _by_source(rows, mix_plan(rows, weights, share, most), "s").withColumn("copies", _copies())
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as mix_sources takes it, with the columns of docs."""
    rows = cut(docs.select(F.col(source_col).cast("string").alias("s"), word_count(F.col(text_col).cast("string")).alias("size"), hash60(F.col(id_col)).alias("h")))
    plan = mix_plan(rows, weights, share, most)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(source_col).cast("string").alias("s"), hash60(F.col(id_col)).alias("h"))
    kept = _by_source(kept, plan, "s").withColumn("copies", _copies()).filter("copies > 0")
    return kept.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
