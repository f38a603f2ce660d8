"""The learning chain as one: label, balance, count, score, vectorise, train two forests, arbitrate, gate and evaluate.

Images are rows (normalizedSrc, pageUrl, alt, parentTxt, domElem, domSib, domDepth, ...). One forest sees which n-grams of a
vocabulary a URL holds, the other the 23 features; where they disagree, the first counts if it is decided enough.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arachne.functions import text as X
from arachne.operators import learning as L

FEATURES = [f"suffix_{x}" for x in L.SUFFIXES] + ["f_domDepth", "f_domSiblings", "hasWidth", "width", "hasHeight", "height", "samedomain", *(f"dom_{e}" for e in L.ELEMENTS), "hasAltText", "altTextLength", "hasParentText", "parentTextLength", "urlLength"]
#: How much less decided the n-gram forest may be and still count: when URLs are gated, and when models are evaluated.
GATE_MARGIN, EVALUATION_MARGIN = 0.05, 0.10


def labelled(images: DataFrame, width: Column, height: Column) -> DataFrame:
    """images with isBig and isSmall by their sizes in pixels; those that are neither, or of unknown size, go."""
    c = L.label_by_dims(width, height)
    return images.withColumns({"isBig": F.coalesce(c == "BIG", F.lit(False)), "isSmall": F.coalesce(c == "SMALL", F.lit(False))}).filter("isBig or isSmall")


def balanced(images: DataFrame, order: list[Column]) -> DataFrame:
    return L.balance(images, F.col("isSmall"), F.col("isBig"), order)


def balanced_counts(images: DataFrame, order: list[Column], tokens: Column, least: int, most: int, having: int = 1) -> DataFrame:
    """(cls, ngram, n) over the labelled images that balancing keeps."""
    return L.ngram_counts(balanced(images, order), tokens, least, most, F.when(F.col("isSmall"), "SMALL").otherwise("BIG"), having)


def _grams(images: DataFrame, lower: bool) -> DataFrame:
    return images.withColumn("grams", X.gram_set(X.url_tokens_c(F.coalesce("normalizedSrc", F.lit("")), lower)))


def train_pair(images: DataFrame, vocabulary: DataFrame, trees: int = 30, depth: int = 30, seed: int = 1, lower: bool = True) -> tuple[PipelineModel, PipelineModel]:
    """(n-gram forest, feature forest) from labelled images. The vocabulary's n-grams, 2,000 as a rule, come to the driver."""
    words = [r[0] for r in vocabulary.orderBy("idx").select("ngram").collect()]
    words = list(dict.fromkeys(words))
    rows = images.withColumn("label", F.col("isBig").cast("double"))
    vectors = CountVectorizerModel.from_vocabulary(words or [" "], inputCol="grams", outputCol="presence")
    vectors.setBinary(True)
    forest = L.train_forest(vectors.transform(_grams(rows, lower)), ["presence"], "label", trees, seed, depth)
    return PipelineModel([vectors, *forest.stages]), L.train_forest(L.features23(rows), FEATURES, "label", trees, seed, depth)


def save_pair(models: tuple[PipelineModel, PipelineModel], folder: str) -> None:
    for name, m in zip(("ngrams", "features"), models, strict=True):
        m.write().overwrite().save(f"{folder}/{name}")


def load_pair(folder: str) -> tuple[PipelineModel, PipelineModel]:
    return tuple(PipelineModel.load(f"{folder}/{name}") for name in ("ngrams", "features"))


def judged(images: DataFrame, models: tuple[PipelineModel, PipelineModel], margin: float = GATE_MARGIN, lower: bool = True) -> DataFrame:
    """images with predicted, 1 for BIG: both forests see columns of the same row, so no join is needed."""
    columns = images.columns
    rows = _grams(images, lower)
    for k, m in zip("12", models, strict=True):
        rows = m.transform(L.features23(rows) if k == "2" else rows)
        rows = rows.withColumns({f"c{k}": F.col("prediction").cast("int"), f"d{k}": vector_to_array("probability")}).select(*columns, *(["grams"] if k == "1" else []), *(f"{x}{i}" for i in "12" if i <= k for x in "cd"))
    return rows.select(*columns, L.arbitrate(F.col("c1"), F.col("d1"), F.col("c2"), F.col("d2"), margin).alias("predicted"))


def gated(images: DataFrame, models: tuple[PipelineModel, PipelineModel], margin: float = GATE_MARGIN) -> DataFrame:
    """The images that are predicted BIG, which alone are worth a fetch."""
    return judged(images, models, margin).filter("predicted = 1").drop("predicted")


def evaluation(images: DataFrame, models: tuple[PipelineModel, PipelineModel], margin: float = EVALUATION_MARGIN) -> DataFrame:
    """class_metrics of labelled images."""
    return L.class_metrics(judged(images.withColumn("label", F.col("isBig").cast("int")), models, margin), "label", "predicted")
