import random
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from arachne.functions import text as X
from arachne.functions import url as U
from arachne.operators import learning as L
from arachne.operators import archive as A
from arachne.operators import chain as C
from arachne.operators import report as R
from arachne.operators.media import LONGEST, extract_media, is_media, media_refs, register_udtf
from arachne.operators.order import numbered
from arachne.sinks.warc import gzip_record, write_warc
from arachne.sources import textfiles as T
from arachne.sources.textfiles import header_dims, read_frequencies, read_media_json

NORMALIZED = [
    ("http://cdn.a.com/x.jpg", "http://h.com/p", "http://cdn.a.com/x.jpg", False),
    ("\n\t http://cdn.a.com/a b.jpg ", "http://h.com/p", "http://cdn.a.com/ab.jpg", False),
    ("/img/a.jpg", "http://h.com/p/q.html", "http://h.com/img/a.jpg", True),
    ("../img/a.jpg", "http://h.com/a/b/c.html", "http://h.com/a/b/img/a.jpg", True),
    ("../img/a.jpg", "http://h.com/aa/bb/c.html", "http://h.com/aa/img/a.jpg", True),
    ("../../img/a.jpg", "http://h.com/aa/bb/cc/d.html", "http://h.com/aa/img/a.jpg", True),
    ("//cdn.x/y.jpg", "http://h.com/p", "http://h.com//cdn.x/y.jpg", True),
    ("pic..jpg", "http://h.com/p/q.html", "http://h.com/p/q.htmljpg", True),
    ("/img/a.jpg", "http://h.com:8080/p", "http://h.com/img/a.jpg", True),
    ("a.jpg", "not a url", "a.jpg", False),
    ("data:image/png;base64,AA", "http://h.com/p", "http://h.com/data:image/png;base64,AA", True),
]
DIMS = {"http://a.com/pics/350x250.jpg": (350, 250), "http://a.com/w_75_h_50.png": (75, 50), "http://a.com/img?width=300&height=200": (300, 200), "http://a.com/photo_640.jpg": (0, 640), "http://a.com/250px-logo.png": (0, 250), "http://a.com/news2014/x.jpg": (2014, 0), "http://a.com/s72-c/99999999999x1.jpg": (72, 0), "http://a.com/10x2030x40.gif": (10, 2030), "http://a.com/w100/b_20.x": (100, 20), "http://a.com/plain.jpg": (0, 0)}


def test_normalize_url(spark):
    df = spark.createDataFrame(NORMALIZED, "src string, page string, want string, ok boolean")
    for r in df.select("want", "ok", U.normalize_url(F.col("src"), F.col("page")).alias("n")).collect():
        assert (r.n.normalized, r.n.success) == (r.want, r.ok)


def test_url_dims(spark):
    df = spark.createDataFrame([(u,) for u in DIMS], "u string")
    assert {r.u: (r.d.width, r.d.height) for r in df.select("u", X.url_dims(F.col("u")).alias("d")).collect()} == DIMS


def test_url_tokens(spark):
    df = spark.createDataFrame([("http://a.com/img/logo-big.png",)], "u string")
    r = df.select(X.url_tokens_a(F.col("u")).alias("a"), X.url_tokens_b(F.col("u")).alias("b")).first()
    assert (" ".join(r.a), " ".join(r.b)) == ("a com img logo big", "http a com img logo big png")


def test_uuid_and_ngrams(spark):
    df = spark.createDataFrame([("http://a.com/x.jpg",), ("abcde",), ("ab",), ("",)], "u string")
    rows = {r.u: (r.i, r.g) for r in df.select("u", U.url_uuid(F.col("u")).alias("i"), X.ngrams(F.col("u"), 3, 5).alias("g")).collect()}
    assert rows["http://a.com/x.jpg"][0] == "cdefcc36-2b90-337a-b465-31ee3e67d0cf"
    assert sorted(rows["abcde"][1]) == sorted("abc abcd abcde bcd bcde cde".split())
    assert rows["ab"][1] == rows[""][1] == []
    import hashlib

    for u in rows:
        assert rows[u][0] == str(uuid.UUID(bytes=hashlib.md5(u.encode()).digest(), version=3))


#: Probes of the media and video patterns, with what the rules say.
PROBES = {
    "a.tiff": (0, 0), "a.ogv": (0, 1), "http://www.dailymotion.com/video/x1": (0, 0), ".jpg": (1, 0), "http://www.youtube.com/watch?feature=x&v=abc": (1, 1), "http://www.youtube.com/watch?v=abc&list=1": (1, 1),
    "https://vimeo.com/123/": (1, 1), "http://www.dailymotion.com/video/x1_a b": (1, 1), "http://flickr.com/photos/bob/123": (1, 0), "http://flickr.com/photos/bob/sets/": (1, 0), "http://twitpic.com/9z/x": (1, 0),
    "http://x.com/a.JPG": (1, 0), "http://x.com/a.jpg?x=1": (0, 0), "asdfsdf.mov": (1, 1), "https://www.vimeo.com/123": (0, 0), "http://youtube.com/watch?v=abc": (0, 0), "httpsss://vimeo.com/1": (1, 1),
    "http://instagram.com/p/AbC/": (1, 0), "http://instagram.com/p/AbC": (0, 0), "http://www.flickr.com/photos/bob/123/": (0, 0), "http://x.com/v.webm": (0, 1), "a b.mp4": (1, 0), "v.MKV": (0, 1), "v.swf": (1, 0),
    "http://www.facebook.com/photo.php?fbid=1": (0, 0), "a.jpg\n": (0, 0), "a\n.jpg": (0, 0), "": (0, 0), None: (0, 0),
}


def test_media_and_video_patterns(spark):
    df = spark.createDataFrame([(u,) for u in PROBES], "u string")
    assert {r.u: (int(r.m), int(r.v)) for r in df.select("u", U.is_media_url(F.col("u")).alias("m"), U.is_video_url(F.col("u")).alias("v")).collect()} == PROBES
    assert all(is_media(u or "") == bool(m) for u, (m, _) in PROBES.items())


@pytest.mark.parametrize("seed", range(3))
def test_balance_is_the_loop(spark, seed):
    kinds = random.Random(seed).choices("sb", [3, 1], k=200)
    kept, s, b = [], 0, 0
    for i, k in enumerate(kinds):
        if k == "b":
            b += 1
            kept.append(i)
        elif s <= b:
            s += 1
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(kinds)), "i int, k string").repartition(3)
    for parts in (1, 2, 7):
        out = L.balance(df, F.col("k") == "s", F.col("k") == "b", [F.col("i")], parts)
        assert out.columns == ["i", "k"] and sorted(r.i for r in out.collect()) == kept
    assert L.balance(df.limit(0), F.col("k") == "s", F.col("k") == "b", [F.col("i")]).count() == 0


def test_numbers_go_on_over_ranges(spark):
    keys = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(5)
    assert {r.k: r.line for r in numbered(df, [F.col("k")]).collect()} == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_vocabulary_and_pruning(spark):
    freq = spark.createDataFrame([("BIG", "a", 10), ("BIG", "b", 5), ("BIG", "c", 7), ("SMALL", "a", 4), ("SMALL", "b", 9)], "cls string, ngram string, n bigint")
    assert [(r.cls, r.ngram, r.score) for r in L.vocabulary(freq).orderBy("idx").collect()] == [("BIG", "c", 7), ("BIG", "a", 6), ("SMALL", "b", 4)]
    freq = spark.createDataFrame([("BIG", "asp", 9), ("BIG", "aspx", 3), ("BIG", "ASPX", 2)], "cls string, ngram string, n bigint")
    assert sorted(r.ngram for r in L.prune_substrings(freq).collect()) == ["ASPX", "aspx"]


PAGE = """<html><head><link href="/i.png"><link href="/s.css"></head><body><div>txt
<img src="a.jpg" alt="A" width="10" height="20"><img alt="no src">
<a href="b.jpg">big <b>pic</b></a><a href="c.html">no</a>
<video width="3" height="4"><source src="v.mp4"><source src="v.webm"></video>
<iframe src="http://www.youtube.com/watch?v=q" width="5"></iframe><embed src="x.bin">
<object name="o" data="m.swf"></object></div></body></html>"""


def test_media(spark):
    want = [("/i.png", "link", None, None, None, 3), ("a.jpg", "img", "A", "10", "20", 4), ("b.jpg", "a", "big pic", None, None, 4), ("v.mp4", "source", None, "3", "4", 5), ("v.webm", "source", None, "3", "4", 5), ("http://www.youtube.com/watch?v=q", "iframe", None, "5", "", 4), ("m.swf", "object", "o", "", "", 4)]
    assert [(r["src"], r["domElem"], r["alt"], r["w"], r["h"], r["domDepth"]) for r in media_refs(PAGE, "http://h.com/p")] == want
    rows = extract_media(spark.createDataFrame([(PAGE, "http://h.com/p"), (None, None)], "html string, url string")).collect()
    assert len(rows) == 7


@pytest.mark.parametrize("html,n", [("<div>" * 100_000 + "<img src=a>", 1), ("<div><img src=a>t " * 30_000, 30_000), ("<img src=a>" * 100_000, 100_000), ("<i>" * 50_000 + "</b>" * 50_000 + "<img src=a>", 1)])
def test_media_of_deep_and_wide_pages(html, n):
    refs = media_refs(html, "u")
    assert len(refs) == n
    assert all(len(r["parentTxt"] or "") <= LONGEST for r in refs)


def test_media_texts_are_cut_and_pages_repaired(spark):
    long = "x" * 501
    refs = {r["src"]: r for r in media_refs(f'<P>one<p>two<IMG SRC="i" ALT="{long}"><li><a href="b.jpg">{long}</a><li><audio><source src="no"></audio><li>  a \n b <img src="j">', "u")}
    assert set(refs) == {"i", "b.jpg", "j"}
    assert len(refs["i"]["alt"]) == 501 and len(refs["b.jpg"]["alt"]) == 500 and refs["i"]["parentTxt"] == "two" and refs["j"]["parentTxt"] == "a b"
    old = media_refs(PAGE, "u", only_img=True)
    assert [(r["src"], r["parentTxt"], r["domSib"], r["domDepth"], r["domElem"]) for r in old] == [("a.jpg", "txt big picno", None, None, None)]
    register_udtf(spark)
    spark.createDataFrame([(PAGE, "http://h.com/p")], "html string, url string").createOrReplaceTempView("udtf_pages")
    assert spark.sql("SELECT src FROM udtf_pages, LATERAL extract_media(html, url)").count() == 7


def test_archive_jobs(spark, tmp_path):
    from arachne.sources.warc import WarcDataSource, binary_records

    http = "HTTP/1.1 200 OK\r\nContent-Type: {}\r\n\r\n<body><p>{}<img src=a.jpg></body>"
    rows = [
        ("response", "http://a.com/1", A.RESPONSE, http.format("text/html", "x")), ("response", "http://a.com/0", A.RESPONSE, http.format("TEXT/HTML", "y")), ("response", "http://a.com/2", A.RESPONSE, "no end"),
        ("response", "http://a.com/3", None, "x"), ("response", "http://a.com/4", A.RESPONSE, None), ("metadata", None, A.METADATA, '{"Envelope": {"Payload-Metadata": {"HTTP-Response-Metadata": {"Headers": {"Server": "nginx"}}}}}'),
        ("metadata", None, A.METADATA, "{bad"), ("metadata", None, A.METADATA, "{}"), ("conversion", None, A.PLAIN, "a  b\ta\r\nA\f"), ("conversion", None, A.PLAIN, " \n"),
    ]
    files = write_warc(spark.createDataFrame(rows, "rec_type string, url string, mimetype string, content string").repartition(3), f"{tmp_path}/w").collect()
    assert len(files) == 3 and all(f.size > 0 for f in files)
    (tmp_path / "w/empty.warc.gz").write_bytes(b"")
    spark.dataSource.register(WarcDataSource)
    records = spark.read.format("warc").load(f"{tmp_path}/w*/part-*.warc.gz,{tmp_path}/w/empty.warc.gz")
    assert {(r.rec_type, r.url, r.mimetype, bytes(r.content).decode()) for r in records.collect()} == {(*r[:3], r[3] or "") for r in rows}
    whole = binary_records(spark, f"{tmp_path}/w/*.warc.gz")
    assert whole.schema == records.schema and sorted(map(str, whole.select("rec_type", "url", "mimetype", "content", "headers").collect())) == sorted(map(str, records.select("rec_type", "url", "mimetype", "content", "headers").collect()))
    tags = A.tag_counts(records)
    assert {r.tag: r.n for r in tags.result.collect()} == {"body": 1, "p": 1, "img": 1}
    assert tags.counters.first().asDict() == {"records_in": 1, "exceptions": 3}
    servers = A.server_counts(records)
    assert [(r.server, r.n) for r in servers.result.collect()] == [("nginx", 1)] and servers.counters.first().asDict() == {"records_in": 3, "exceptions": 1}
    words = A.word_counts(records)
    assert {r.word: r.n for r in words.result.collect()} == {"a": 2, "b": 1, "A": 1}
    assert words.counters.first().asDict() == {"records_in": 2, "empty_page_text": 1, "non_plain_text": 7, "exceptions": 1}
    media = A.media_job(records)
    assert [(r.src, r.pageUrl, r.parentTxt) for r in media.result.collect()] == [("a.jpg", "http://a.com/0", "y")] and media.counters.first().asDict() == {"records_in": 4, "exceptions": 3}
    assert [r.domDepth for r in A.media_job(records, parse_headers=True).result.collect()] == [4]
    none = records.limit(0)
    assert A.word_counts(none).counters.first().records_in == 0 and A.tag_counts(none).result.count() == 0


def test_broken_archives_end_with_what_can_be_read(spark, tmp_path):
    from arachne.sources.warc import WarcDataSource

    member = gzip_record([("WARC-Type", "response"), ("Content-Type", "x")], b"body")
    (tmp_path / "a.warc.gz").write_bytes(member + member)
    (tmp_path / "plain.warc").write_bytes(b"junk\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")
    spark.dataSource.register(WarcDataSource)
    assert spark.read.format("warc").load(f"{tmp_path}/a.warc.gz").count() == 2
    assert [bytes(r.content) for r in spark.read.format("warc").option("content", "true").load(f"{tmp_path}/plain.warc").collect()] == [b"short"]
    assert [r.content for r in spark.read.format("warc").option("content", "false").load(str(tmp_path)).collect()] == [None] * 3


def test_archives_are_read_and_written_within_bounds(spark, tmp_path, monkeypatch):
    from arachne.sources import warc

    monkeypatch.setattr(warc, "BATCH_PAYLOAD", 5000)
    bodies = [bytes([65 + i % 26]) * (i % 7 * 700) for i in range(300)]
    members = [gzip_record([("WARC-Type", "conversion"), ("X-N", str(i)), ("x-n", "again")], b) for i, b in enumerate(bodies)]
    (tmp_path / "a.warc.gz").write_bytes(b"\0\0".join(members))
    reader = warc._WarcReader([], True)
    batches = list(reader.read(warc._File(str(tmp_path / "a.warc.gz"))))
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(batches) > 50 and all(sum(map(len, b.column("content").to_pylist()[:-1])) < 5000 for b in batches)
    assert [r["content"] for r in rows] == bodies and [dict(r["headers"])["X-N"] for r in rows] == [str(i) for i in range(300)]
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(members[:20])[:-3])
    with pytest.raises(EOFError):
        list(reader.read(warc._File(str(tmp_path / "cut.warc.gz"))))
    docs = spark.range(0, 400, 1, 2).selectExpr("'conversion' rec_type", "'http://a.com/' url", "'text/plain' mimetype", "string(id) content")
    files = write_warc(docs, f"{tmp_path}/many", most=2000).collect()
    assert len(files) > 20 and all(f.size < 2400 for f in files)
    spark.dataSource.register(warc.WarcDataSource)
    again = spark.read.format("warc").load(f"{tmp_path}/many")
    assert sorted(int(bytes(r.content)) for r in again.collect()) == list(range(400))
    bare = spark.read.format("warc").option("headers", "false").load(f"{tmp_path}/many")
    assert again.filter("headers['Content-Type'] = 'text/plain'").count() == 400 == bare.filter("headers is null and mimetype = 'text/plain'").count()
    counted = A.word_counts(again)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(counted.counters) and "parse_json" not in plan(A.server_counts(again).result)
    assert counted.counters.first().asDict() == {"records_in": 400, "empty_page_text": 0, "non_plain_text": 0, "exceptions": 0}


def test_report(spark, tmp_path):
    from arachne.sinks.text import write_report

    images = [("http://www.i.com/a.jpg", "http://www.p.com/1"), ("http://www.i.com/a.jpg", "http://www.p.com/0"), (" /b.png ", "http://p.com/x"), ("http://v.com/c.mp4", "http://q.com/"), ("c.gif", "no url"), ("", "http://p.com/"), (None, None), ("http://j.com/d.jpg", "http://p.com/z")]
    cases = spark.createDataFrame([("http://www.i.com/a.jpg",), ("http://www.i.com/a.jpg",), ("http://v.com/c.mp4",)], "url string")
    df = spark.createDataFrame(images, "src string, pageUrl string")
    found = {(r.section, r.elem, r.other): r.n for r in R.report(df, cases).collect()}
    assert found == {
        ("WEBPAGES", "p.com", None): 3, ("WEBPAGES", "q.com", None): 1, ("IMAGES", "i.com", None): 1, ("IMAGES", "p.com", None): 1, ("IMAGES", "j.com", None): 1, ("VIDEOS", "v.com", None): 1, ("CASES", "http://www.i.com/a.jpg", None): 1,
        ("DISTRIBUTION", "p.com", "www.i.com"): 1, ("DISTRIBUTION", "p.com", "p.com"): 1, ("DISTRIBUTION", "p.com", "j.com"): 1, ("DISTRIBUTION", "q.com", "v.com"): 1,
        ("TOTALS", "UNIQUE URLS", None): 5, ("TOTALS", "UNIQUE DOMAINS", None): 6, ("TOTALS", "NEWS WEB PAGE COUNT", None): 4, ("TOTALS", "NEWS IMAGE COUNT", None): 3, ("TOTALS", "NEWS VIDEO COUNT", None): 1, ("TOTALS", "CASES COUNT TOTAL", None): 1, ("TOTALS", "CASES COUNT UNIQUE", None): 1,
    }
    write_report(R.report(df, cases), str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[:3] == ["WEBPAGES", "p.com 3", "q.com 1"] and lines.index("Image url distribution for host: p.com") < lines.index("TOTALS") and "CASES COUNT UNIQUE: 1" in lines
    assert {r.host for r in T.read_report_hosts(spark, str(tmp_path / "r"), 2).collect()} == {"p.com", "q.com"}
    empty = {r.elem: r.n for r in R.report(df.limit(0)).collect()}
    assert len(empty) == 7 and set(empty.values()) == {0}


def test_learning_chain(spark, tmp_path):
    """BIG images have other URLs and other features than SMALL ones, so both forests tell them apart."""
    rows = [(i, f"http://a.com/{'gallery' if i % 2 else 'thumbs'}/{i}.{'jpeg' if i % 2 else 'gif'}", "http://a.com/p", "alt" if i % 2 else None, None, "img", 3, 5, 500 if i % 2 else 100) for i in range(60)]
    rows.append((99, "http://a.com/x.png", "http://a.com/p", None, None, "img", 3, 5, 300))
    df = spark.createDataFrame(rows, "id int, normalizedSrc string, pageUrl string, alt string, parentTxt string, domElem string, domSib int, domDepth int, side int")
    images = C.labelled(df, F.col("side"), F.col("side"))
    assert images.count() == 60
    counts = C.balanced_counts(images, [F.col("id")], X.url_tokens_a(F.col("normalizedSrc")), 3, 5)
    vocab = L.pruned_vocabulary(counts)
    assert "galle" in {r.ngram for r in vocab.collect()}
    C.save_pair(C.train_pair(images.filter("id < 40"), vocab, trees=5), str(tmp_path / "m"))
    models = C.load_pair(str(tmp_path / "m"))
    r = C.evaluation(images.filter("id >= 40"), models).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (10, 0, 0, 10)
    assert {x.id % 2 for x in C.gated(df.filter("id between 40 and 60"), models).collect()} == {1}


def test_forest_keeps_its_rows_nodes(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(0, 300, 1, 3).selectExpr("double(xxhash64(id) % 2 = 0) y", *(f"double(pmod(xxhash64(id, {i}), 50)) e{i}" for i in range(4)))
    names = [f"e{i}" for i in range(4)]
    forest = L.train_forest(rows, names, "y", trees=4).stages[-1]
    assert forest.getOrDefault("cacheNodeIds")
    walked = RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=30, featureSubsetStrategy="log2", seed=1).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    trees = lambda m: [t.toDebugString.partition("\n")[2] for t in m.trees]
    assert trees(forest) == trees(walked)


def test_arbitration_by_margin(spark):
    df = spark.createDataFrame([(1, [0.40, 0.60], 0, [0.64, 0.36])], "c1 int, d1 array<double>, c2 int, d2 array<double>")
    a = lambda m: df.select(L.arbitrate(F.col("c1"), F.col("d1"), F.col("c2"), F.col("d2"), m).alias("c")).first().c
    assert (a(C.GATE_MARGIN), a(C.EVALUATION_MARGIN)) == (0, 1)


def test_pruned_vocabulary_scores_small_against_pruned_big(spark):
    freq = spark.createDataFrame([("BIG", "asp", 9), ("BIG", "ASPX", 3), ("SMALL", "asp", 2), ("SMALL", "aspx", 5), ("SMALL", "ab", 4), ("BIG", "ab", 6)], "cls string, ngram string, n bigint")
    # BIG loses asp to ASPX; SMALL loses asp to aspx. ASPX is not in SMALL; aspx is not in what is left of BIG
    assert {(r.cls, r.ngram, r.score) for r in L.pruned_vocabulary(freq).collect()} == {("BIG", "aspx", 50), ("BIG", "ab", 2), ("SMALL", "aspx", 50)}


def test_urls_and_dates(spark):
    df = spark.createDataFrame([("http://a.com/x", "HTTP://A.com/y", "image/png"), ("http://a.com/x", None, "text/html; charset=x"), ("../b", "http://h.com/a/c.html", None)], "a string, b string, t string")
    r = df.select(U.same_domain(F.col("a"), F.col("b")).alias("same"), U.resolve_url(F.col("a"), F.col("b")).alias("full"), U.extension_of(F.col("t")).alias("ext"), X.cut_text(F.col("a"), 4).alias("cut"), F.unix_millis(X.modified_date(F.lit(86_400_123))).alias("ms"), X.alt_grams(F.col("a"), 14, 15).alias("g")).collect()
    assert [x.same for x in r] == [1, 0, 0] and [x.full for x in r] == ["http://a.com/x", None, "http://h.com/b"] and r[0].ext == "png" and r[2].ext is None
    assert r[0].cut == "http" and r[0].ms == 86_400_123 and r[0].g == ["http://a.com/x"]


def test_lists(spark, tmp_path):
    (tmp_path / "m").write_text("".join(f"l{i}\n" for i in range(1, 21)))
    got = [T.manifest_range(spark, str(tmp_path / "m"), a, b, "s3://") for a, b in T.batch_ranges(3, 12, 4)]
    assert [[r.path for r in g.collect()] for g in got] == [[f"s3://l{i}" for i in range(a, b)] for a, b in ((3, 7), (7, 11), (11, 12))]
    (tmp_path / "s").write_text("http://www.a.com/x\nhttp://b.com\nbad\nhttp://a.com/y\n")
    assert {r.host for r in T.seed_hosts(spark, str(tmp_path / "s")).collect()} == {"a.com", "b.com"}
    (tmp_path / "v").write_text("abc 5\nde\t4\nf 3\n")
    assert [(r.idx, r.ngram) for r in T.read_vocabulary(spark, str(tmp_path / "v"), 2).orderBy("idx").collect()] == [(0, "abc"), (1, "de")]
    (tmp_path / "i").write_text("c x\na y\nb\na z\n\n")
    assert [r.url for r in T.read_image_list(spark, str(tmp_path / "i"), 2).collect()] == ["a", "b"]
    assert {r.url for r in T.read_list(spark, str(tmp_path / "i")).collect()} == {"c x", "a y", "b", "a z"}
    records = spark.createDataFrame([("p", i, f"u{i}", b"x" * (499 + i)) for i in range(9)], "path string, rec_no int, url string, content binary")
    assert [(r.url, len(r.preview)) for r in T.archive_preview(records).collect()] == [(f"u{i}", 499 + i if i < 2 else 503) for i in range(6)]


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 31, -17)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 200, 300) + bytes(6)
    for name, data in {"a.png": png, "b.bmp": bmp, "c.jpg": jpg, "d.gif": b"GIF87a" + struct.pack("<HH", 5, 6), "e.txt": b"text", "f.png": png[:18]}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.filename.rsplit("/", 1)[1]: (r.width, r.height) for r in T.image_dims(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows == {"a.png": (640, 480), "b.bmp": (31, 17), "c.jpg": (300, 200), "d.gif": (5, 6), "e.txt": (None, None), "f.png": (None, None)}


def test_files_of_stores():
    from arachne.sources.files import _uri

    assert _uri("s3a://b/x*", "b/x1") == "s3a://b/x1" and _uri("hdfs://h:8020/a/*", "/a/b") == "hdfs://h:8020/a/b" and _uri("abfss://c@acc/x", "c/x") == "abfss://c@acc/x" and _uri("/a/*", "/a/b") == "/a/b"


def test_text_sources(spark, tmp_path):
    (tmp_path / "f").write_text("a b 3\nx 2\nx 5\nsolo\n 7\n")
    assert {r.elem: r.n for r in read_frequencies(spark, str(tmp_path / "f")).collect()} == {"a b": 3, "x": 7}
    import gzip

    lines = ['{"src":"a","pageUrl":"p","w":"","h":""},', '{"src":"b","pageUrl":"p","w":"100","h":"50"},', '{"src":"c","pageUrl":"p","w":"100%","h":"1"},', '{"src":"d","pageUrl":"p"},', '{"src":"e","pa']
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    strict, rejects = read_media_json(spark, str(tmp_path / "j"), strict_dims=True)
    assert sorted(r.src for r in strict.collect()) == ["b", "d"] and rejects.count() == 3
    loose, rejects = read_media_json(spark, str(tmp_path / "j"))
    assert sorted(r.src for r in loose.collect()) == ["a", "b", "c", "d"] and rejects.count() == 1
    assert header_dims(b"GIF89a" + bytes([3, 0, 4, 0])) == (3, 4) and header_dims(b"no") is None


def test_warc_source(spark, tmp_path):
    import gzip

    from arachne.sources.warc import WarcDataSource

    def record(kind, mimetype, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a.com/\r\nContent-Type: {mimetype}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    data = gzip.compress(record("response", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\n<p>")) + gzip.compress(record("metadata", "application/json", b"{}"))
    (tmp_path / "a.warc.gz").write_bytes(data)
    spark.dataSource.register(WarcDataSource)
    df = spark.read.format("warc").load(f"{tmp_path}/*.warc.gz")
    assert [(r.rec_no, r.rec_type, bytes(r.content)) for r in df.orderBy("rec_no").collect()] == [(0, "response", b"HTTP/1.1 200 OK\r\n\r\n<p>"), (1, "metadata", b"{}")]
    assert df.filter("mimetype = 'application/json'").count() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("warc").option("pushdown", "true").load(f"{tmp_path}/*.warc.gz")
    assert [r.rec_no for r in pushed.filter("mimetype = 'application/json'").collect()] == [1]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
