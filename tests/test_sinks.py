import numpy as np
import pytest
from pyspark.sql import functions as F

from arachne.operators import vectors as V
from arachne.operators.vectors import keep_descriptors
from arachne.sinks import text as S
from arachne.streaming.hosts import running_host_counts, windowed_events


def test_arff(spark, tmp_path):
    rows = spark.createDataFrame([([2, 0], "BIG"), ([], "SMALL"), (None, "SMALL")], "hits array<int>, class string")
    lines, skipped = S.arff_sparse(rows, "r", 3)
    lines = [r.value for r in lines.orderBy("part").collect()]
    assert lines[0] == "@relation r" and lines[-2:] == ["@data", "{0 1, 2 1, 3 BIG}"] and lines[2] == "@attribute ngram0 numeric" and skipped.first().skipped == 2
    assert sorted(r.value for r in S.arff_dense_ngrams(rows, "r", 3).filter("part = 8").collect()) == ["0,0,0,SMALL", "0,0,0,SMALL", "1,0,1,BIG"]
    dense = spark.createDataFrame([("1,0,1,BIG",), ("1,BIG",)], "value string")
    assert [r.value for r in S.sparse_of_dense(dense, 3).collect()] == ["{0 1, 2 1, 3 BIG}"]
    S.write_arff(S.arff_dense(spark.createDataFrame([(1, 2.5, "BIG"), (None, 0.0, "SMALL")], "a int, b double, class string"), "r", ["a", "b"]), str(tmp_path / "a"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert lines[:3] == ["@relation r", "", "@attribute a numeric"] and sorted(lines[-2:]) == ["1,2.5,BIG", "?,0.0,SMALL"]


def test_tsv(spark, tmp_path):
    S.write_tsv(spark.createDataFrame([("b", 1), ("a", 2)], "k string, n int"), str(tmp_path / "o"), "k")
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a\t2", "b\t1"]


def test_descriptor_filter(spark):
    df = spark.createDataFrame([([[1.0], [2.0]], [0.8, 0.1], [0.1, 0.9])], "d array<array<double>>, o array<double>, i array<double>")
    assert df.select(keep_descriptors("d", "o", "i").alias("k")).first().k == [[2.0]]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("http://a.com/1",), ("http://a.com/1",), ("http://b.com/",)], "url string").write.parquet(str(tmp_path / "in"))
    q = running_host_counts(spark.readStream.schema("url string").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hosts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.host: r.n for r in spark.table("hosts").collect()} == {"a.com": 1, "b.com": 1}


def test_running_counts_with_a_watermark(spark, tmp_path):
    rows = [("http://a.com/1", "2024-01-01 00:00:00"), ("http://a.com/1", "2024-01-01 01:00:00"), ("http://b.com/", "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "url string, t string").select("url", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running_host_counts(stream, ts_col="ts").writeStream.outputMode("update").format("memory").queryName("late_hosts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.host: r.n for r in spark.table("late_hosts").collect()} == {"a.com": 1, "b.com": 1}
    q = windowed_events(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))) if (df.select("ts", F.lit("click").alias("event_type")).write.parquet(str(tmp_path / "ev")) or True) else None
    q = q.writeStream.outputMode("complete").format("memory").queryName("event_windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("event_windows").collect()) == [1, 1, 1]


def test_append_new_keeps_one_of_each_key(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "id string, n int")
    path = str(tmp_path / "t")
    assert S.append_new(df, S.stored_rows(spark, path), path) == 2
    assert S.append_new(df.union(spark.createDataFrame([("c", 5)], df.schema)), S.stored_rows(spark, path), path) == 1
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_media_json_batches(spark, tmp_path):
    refs = spark.createDataFrame([("a.jpg", None), ('b"', "x")], "src string, alt string")
    assert S.write_batches({501: refs, 1: refs.limit(1)}, f"{tmp_path}/out") == [f"{tmp_path}/out1", f"{tmp_path}/out501"]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out501").collect()]
    assert sorted(lines) == ['{"src":"a.jpg"},', '{"src":"b\\"","alt":"x"},']


def test_vlad_pca_and_codes_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * np.arange(1, 9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    m = V.fit_pca(df, "v", 3)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    got = np.array([r.projected for r in V.project(df, "v", m, 3).orderBy("id").collect()])
    want = (x - x.mean(0)) @ vectors[:, ::-1][:, :3] / np.sqrt(values[::-1][:3])
    assert np.allclose(np.abs(got), np.abs(want)) and np.allclose(got.std(0), 1)
    same = V.project(df, "v", None, 8).orderBy("id").collect()
    assert np.allclose([r.projected for r in same], x)
    for n, most in ((0, 5), (6, 5)):
        with pytest.raises(ValueError):
            V.guard_length(n, most)
    books = [V.codebook(df, "v", 4, seed=i) for i in range(2)]
    groups = spark.createDataFrame([(1, x[:5].tolist()), (2, []), (3, None)], "g int, d array<array<double>>")
    rows = {r.g: np.array(r.vlad) for r in V.vlad(groups, "d", books).collect()}
    want = np.concatenate([sum(((v - b[k])[None] * (np.arange(4) == k)[:, None] for v in x[:5] for k in [int(((v - b) ** 2).sum(1).argmin())]), np.zeros((4, 8))).ravel() for b in books])
    want = np.sign(want) * np.sqrt(np.abs(want))
    assert np.allclose(rows[1], want / np.linalg.norm(want)) and not rows[2].any() and not rows[3].any()
    model = V.fit_ivfpq(df, "v", lists=4, parts=2, k=8)
    for r in V.ivfpq_codes(df, "v", model).withColumnRenamed("id", "k").collect():
        near = int(((x[r.k] - model["coarse"]) ** 2).sum(1).argmin())
        rest = (x[r.k] - model["coarse"][near])[model["order"]]
        assert r.list_id == near and r.code == [int(((p - b) ** 2).sum(1).argmin()) for p, b in zip(np.split(rest, 2), model["books"], strict=True)]
    codes, path = V.ivfpq_codes(df, "v", model), str(tmp_path / "index")
    assert V.insert_codes(codes.filter("id < 50"), path, "id") == 50
    assert V.insert_codes(codes, path, "id", capacity=120) == 70
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(120))
