"""The pipeline's stages against brute-force forms, on a small corpus with odd rows."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from test_operators import SCHEMA, brute_components, corpus, empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, texts):
    rows = [(i, t, "en", ["b", "a", None, "c"][i % 4], 0, "x", 0.5, "t", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).select(COLUMNS)


def test_near_duplicates_keep_one_of_each_group(spark):
    texts = corpus()
    docs = documents(spark, texts)
    least = {c for _, c in brute_components(texts, 5, 80, 100).values()}
    kept = pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least)
    assert pipeline.near_duplicates(spark, empty(spark).select(COLUMNS), "").count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, a), (4, b), (5, None), (5, None), (6, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = Counter((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter({(1, a): 1, (3, b): 1, (3, a): 1, (5, None): 1, (6, ""): 1, (None, a): 2})


def test_whole_run(spark, tmp_path):
    texts = corpus(3) + [f"mail u{i}.v@mail{i}.example.com about it" for i in range(8)]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 1).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    packed = pipeline.run(spark, str(tmp_path)).collect()
    found = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, found, str(tmp_path)).cache()
        assert after.columns == COLUMNS, name
        if name in ("quality", "near_duplicates"):
            assert after.exceptAll(found).count() == 0, name
        found = after
    assert not any("@mail" in (r.text or "") for r in found.collect())
    times = Counter(r.doc_id for r in found.collect())
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(places, places[1:])) and sum(places[-1]) <= 2048


def test_stage_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "private_data", "mixture", "packing"]
    assert pipeline.ORACLE_SQL is None
