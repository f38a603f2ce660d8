"""Queries over the driver's tables for the engine's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arachne.functions import text as X
from arachne.functions import url as U
from arachne.operators import archive as A
from arachne.operators import chain as C
from arachne.operators import gates as G
from arachne.operators import learning as L
from arachne.operators import media as M
from arachne.operators import report as R
from arachne.operators.order import numbered
from arachne.session import table
from arachne.shared import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LINK = r'<a href="([^"]*)"'
_HOST_SQL = r"nullif(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1), '')"
SEEDS = ("thththth.example.com", "example.net", "example.org")
SOURCES = ("/img/a.jpg", "../img/b.png", "c.gif", "http://cdn.example.com/d.jpg", "//cdn.example.com/e.jpg")
_A = r"regexp_replace(CASE WHEN url LIKE 'http%' THEN substr(url, strpos(url, '://') + 3) ELSE url END, '\.[^.]{0,4}$', '')"
_TOKENS_A = rf"SELECT page_id, url, unnest(regexp_split_to_array({_A}, '[/.\-]')) AS token FROM pages"
_TOKENS_B = r"SELECT page_id, url, unnest(regexp_split_to_array(url, '\W+')) AS token FROM pages"
_SITE = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)"
_LABELLED = "(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'BIG' ELSE 'SMALL' END AS cls, url FROM pages)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _grams(least: int, most: int, where: str = "", tokens: str = _TOKENS_A, labelled: str = _LABELLED) -> str:
    t = tokens.replace("FROM pages", f"FROM {labelled}").replace("page_id, url", "cls")
    return f"SELECT cls, substr(token, i::INT, n::INT) AS ngram, count(*) AS n FROM ({t}) t, unnest(generate_series(1, length(token))) a(i), generate_series({least}, {most}) b(n) WHERE i + n - 1 <= length(token) GROUP BY 1, 2{where}"


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


@query("tag_count", r"SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([^\s>/][^\s>]*)([^>]*)>', 1)) AS tag FROM pages) GROUP BY 1")
def tag_count(s: SparkSession, d: str) -> DataFrame:
    return _count(table(s, d, "pages").select(F.explode(X.tags(F.col("html"))).alias("tag")), "tag")


@query("word_count", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS word FROM documents) GROUP BY 1")
def word_count(s, d):
    return _count(table(s, d, "documents").select(F.explode(X.words(F.col("text"))).alias("word")), "word")


@query("line_word_count", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '[^ \t\r\f]+')) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1")
def line_word_count(s, d):
    lines = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return _count(lines.select(F.explode(X.words(F.col("line"))).alias("word")), "word")


@query("json_key_count", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def json_key_count(s, d):
    return _count(table(s, d, "events").select(F.get_json_object("props", "$.k").alias("k")).filter("k is not null"), "k")


_PAYLOAD = "concat('HTTP/1.1 200 OK', chr(13), chr(10), CASE WHEN page_id % 2 = 0 THEN 'Content-Type: text/html' ELSE 'Content-Type: text/plain' END, CASE WHEN page_id % 5 = 0 THEN '' ELSE concat(chr(13), chr(10), chr(13), chr(10)) END, html)"


@query("http_split_counters", f"SELECT count(*) AS records_in, sum((instr(p, e) = 0)::INT)::BIGINT AS exceptions, sum((instr(p, e) > 0 AND contains(substr(p, 1, instr(p, e) - 1), 'Content-Type: text/html'))::INT)::BIGINT AS html FROM (SELECT {_PAYLOAD} AS p, concat(chr(13), chr(10), chr(13), chr(10)) AS e FROM pages)")
def http_split_counters(s, d):
    p = X.http_parts(F.expr(_PAYLOAD))
    t = table(s, d, "pages").select(p.alias("p"))
    return t.agg(F.count("*").alias("records_in"), F.sum(F.col("p").isNull().cast("bigint")).alias("exceptions"), F.sum(F.coalesce(F.col("p.header").contains("Content-Type: text/html"), F.lit(False)).cast("bigint")).alias("html"))


@query("page_preview", "SELECT page_id, url, concat(substr(html, 1, 500), CASE WHEN length(html) > 500 THEN '...' ELSE '' END) AS preview FROM pages ORDER BY page_id LIMIT 6")
def page_preview(s, d):
    return table(s, d, "pages").orderBy("page_id").limit(6).select("page_id", "url", X.preview(F.col("html")).alias("preview"))


@query("host_freq", f"SELECT {_HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_freq(s, d):
    return _count(table(s, d, "pages").select(U.host(F.col("url")).alias("host")), "host")


@query("host_freq_www_stripped", rf"SELECT regexp_replace({_HOST_SQL}, '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def host_freq_www_stripped(s, d):
    return _count(table(s, d, "pages").select(U.strip_www(U.host(F.col("url"))).alias("host")), "host")


@query("distinct_hosts", f"SELECT count(DISTINCT {_HOST_SQL}) AS hosts, count(DISTINCT url) AS urls FROM pages")
def distinct_hosts(s, d):
    return table(s, d, "pages").agg(F.count_distinct(U.host(F.col("url"))).alias("hosts"), F.count_distinct("url").alias("urls"))


def _links(s, d):
    return table(s, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("href"))


_LINKS_SQL = f"SELECT page_id, url, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href FROM pages"


@query("links_extract", f"SELECT href, count(*) AS n FROM ({_LINKS_SQL}) GROUP BY 1")
def links_extract(s, d):
    return _count(_links(s, d), "href")


_IMAGE_SQL = rf"""SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN 'http://cdn' || page_id % 7 || '.example.com/img/p' || page_id % 40 || '_350x250.png' WHEN 1 THEN '/img/' || page_id || '.jpeg' WHEN 2 THEN ' pics/x' || page_id % 10 || '.gif ' WHEN 3 THEN 'http://www.youtube.com/watch?v=v' || page_id % 9
WHEN 4 THEN 'http://www.media.example.org/clip' || page_id % 6 || '.mp4' ELSE '' END AS src FROM pages"""
_UNIQUE_SQL = rf"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY url, src) AS k FROM (SELECT page_id, url, src, CASE WHEN t LIKE 'http%' THEN t WHEN t LIKE '/%' THEN site || t ELSE site || '/' || t END AS u FROM (SELECT *, regexp_replace(src, '\s', '', 'g') AS t, {_SITE} AS site FROM ({_IMAGE_SQL}) WHERE src <> ''))) WHERE k = 1)"""
_IS_VIDEO = "(" + " OR ".join(f"regexp_full_match(u, '{p}')" for p in (r"\S+\.(?i:webm|mkv|flv|ogg|ogv|avi|mov|wmv|rm|mp4|m4v|mpg|mpeg|mp2|m2v|3gp|3g2|mxf)", r"https*://www.youtube.com/watc(?:h|).*v=[0-9A-Za-z_-]+(?:&.+=.+)*")) + ")"
_CASES = tuple(f"http://cdn{i}.example.com/img/p{j}_350x250.png" for i, j in ((0, 0), (6, 6), (5, 12), (1, 99)))
_CASES_SQL = ", ".join(f"('{u}')" for u in _CASES)
_IH, _PH = (f"regexp_extract({x}, '^[A-Za-z]+://([^/?#]*)', 1)" for x in ("u", "url"))
_SHORT = lambda h: f"regexp_replace({h}, '^www\\.', '')"


def _media(s, d):
    """Images of pages, as the driver's pages have none."""
    k = F.col("page_id")
    src = F.expr("CASE page_id % 6 WHEN 0 THEN concat('http://cdn', page_id % 7, '.example.com/img/p', page_id % 40, '_350x250.png') WHEN 1 THEN concat('/img/', page_id, '.jpeg') WHEN 2 THEN concat(' pics/x', page_id % 10, '.gif ') WHEN 3 THEN concat('http://www.youtube.com/watch?v=v', page_id % 9) WHEN 4 THEN concat('http://www.media.example.org/clip', page_id % 6, '.mp4') ELSE '' END")
    return table(s, d, "pages").select(k, src.alias("src"), F.col("url").alias("pageUrl"))


def _cases(s):
    return s.createDataFrame([(u,) for u in _CASES], "url string")


@query("host_pair_freq", f"SELECT {_SHORT(_PH)} AS page_host, {_IH} AS image_host, count(*) AS n FROM {_UNIQUE_SQL} GROUP BY ROLLUP (1, 2)")
def host_pair_freq(s, d):
    return R.pair_rollup(_media(s, d))


@query("cases_semi_join", f"SELECT page_id, u AS url FROM {_UNIQUE_SQL} WHERE u IN (SELECT * FROM (VALUES {_CASES_SQL}))")
def cases_semi_join(s, d):
    return R.unique_images(_media(s, d)).select("page_id", F.col("normalizedSrc").alias("url")).join(_cases(s), "url", "left_semi")


@query("cases_freq", f"SELECT u AS url, count(*) AS n FROM {_UNIQUE_SQL} WHERE u IN (SELECT * FROM (VALUES {_CASES_SQL})) GROUP BY 1")
def cases_freq(s, d):
    return R.report(_media(s, d), _cases(s)).filter("section = 'CASES'").select(F.col("elem").alias("url"), "n")


@query("unique_images", f"SELECT page_id, u AS normalized FROM {_UNIQUE_SQL}")
def unique_images(s, d):
    return R.unique_images(_media(s, d)).select("page_id", F.col("normalizedSrc").alias("normalized"))


_REPORT_SQL = f"""WITH i AS (SELECT *, {_IH} AS ih, {_PH} AS ph, {_IS_VIDEO} AS video FROM {_UNIQUE_SQL}),
e AS (SELECT 'WEBPAGES' AS section, {_SHORT("ph")} AS elem, NULL AS other FROM i UNION ALL SELECT CASE WHEN video THEN 'VIDEOS' ELSE 'IMAGES' END, {_SHORT("ih")}, NULL FROM i
  UNION ALL SELECT 'CASES', u, NULL FROM i WHERE NOT video AND u IN (SELECT * FROM (VALUES {_CASES_SQL})) UNION ALL SELECT 'DISTRIBUTION', {_SHORT("ph")}, ih FROM i)
SELECT section, elem, other, count(*) AS n FROM e GROUP BY 1, 2, 3 UNION ALL SELECT 'TOTALS', 'UNIQUE URLS', NULL, count(*) FROM i
UNION ALL SELECT 'TOTALS', 'UNIQUE DOMAINS', NULL, count(DISTINCT h) FROM (SELECT ih AS h FROM i UNION ALL SELECT ph FROM i)
UNION ALL SELECT 'TOTALS', 'NEWS WEB PAGE COUNT', NULL, count(*) FROM e WHERE section = 'WEBPAGES' UNION ALL SELECT 'TOTALS', 'NEWS IMAGE COUNT', NULL, count(*) FROM e WHERE section = 'IMAGES'
UNION ALL SELECT 'TOTALS', 'NEWS VIDEO COUNT', NULL, count(*) FROM e WHERE section = 'VIDEOS' UNION ALL SELECT 'TOTALS', 'CASES COUNT TOTAL', NULL, count(*) FROM e WHERE section = 'CASES'
UNION ALL SELECT 'TOTALS', 'CASES COUNT UNIQUE', NULL, count(DISTINCT elem) FROM e WHERE section = 'CASES'"""


@query("statistics_report", _REPORT_SQL)
def statistics_report(s, d):
    return R.report(_media(s, d), _cases(s))


@query("report_lines", f"""WITH r AS ({_REPORT_SQL}), o AS (SELECT *, list_position(['WEBPAGES', 'IMAGES', 'VIDEOS', 'CASES', 'DISTRIBUTION', 'TOTALS'], section) AS a, CASE WHEN section = 'DISTRIBUTION' THEN elem ELSE '' END AS b, coalesce(other, elem) AS x FROM r),
l AS (SELECT a, b, 1 AS c, -n AS d, x AS e, x || CASE WHEN section = 'TOTALS' THEN ': ' ELSE ' ' END || n AS value FROM o UNION ALL SELECT DISTINCT a, '', 0, 0, '', section FROM o WHERE section <> 'DISTRIBUTION' UNION ALL SELECT DISTINCT a, elem, 0, 0, '', 'Image url distribution for host: ' || elem FROM o WHERE section = 'DISTRIBUTION')
SELECT row_number() OVER (ORDER BY a, b, c, d, e) AS line, value FROM l""")
def report_lines(s, d):
    return numbered(R.report_lines(statistics_report(s, d)), [F.col("place")]).select("line", "value")


_URLS = """http://x.com/a.JPG http://x.com/a.jpg?x=1 asdfsdf.mov https://vimeo.com/123 https://www.vimeo.com/123 http://www.youtube.com/watch?v=abc http://youtube.com/watch?v=abc
httpsss://vimeo.com/1 http://instagram.com/p/AbC/ http://instagram.com/p/AbC http://flickr.com/photos/bob/123/ http://www.flickr.com/photos/bob/123/ http://www.dailymotion.com/video/x1_abc http://twitpic.com/9z http://x.com/v.webm
http://www.facebook.com/photo.php?fbid=1 a.tiff a.ogv http://www.dailymotion.com/video/x1 .jpg http://www.youtube.com/watch?feature=x&v=abc http://www.youtube.com/watch?v=abc&list=1 https://vimeo.com/123/ https://vimeo.com/123/x
http://www.dailymotion.com/video/x1_a-b/c http://flickr.com/photos/bob/123 http://flickr.com/photos/bob/sets/ http://flickr.com/photos/b_b/123 http://twitpic.com/9z/x v.mkv v.OGG v.rm v.mp2 v.m2v v.3g2 v.mxf v.swf s.swf?a=b.mp4""".split()


def _flags(s, d, flag):
    known = s.createDataFrame([(u,) for u in _URLS], "url string")
    return table(s, d, "pages").select("url").union(known).select("url", flag(F.col("url")).alias("flag"))


def _flag_sql(*patterns: str) -> str:
    either = " OR ".join(f"regexp_full_match(url, '{p}')" for p in patterns)
    values = ", ".join(f"('{u}')" for u in _URLS)
    return f"SELECT url, {either} AS flag FROM (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {values}) v(url))"


# the rules as they are specified, written for DuckDB and apart from functions.url
_SQL_MEDIA = (r"(?i:.*\.(?:jpg|jpeg|png|gif|bmp|3gp|avi|flv|m4v|mov|mpg|mp4|mpeg|swf|wmv))", r"https*://instagram.com/p/[0-9A-Za-z_-]+/", r"https*://www.youtube.com/watc(?:h|).*v=[0-9A-Za-z_-]+(?:&.+=.+)*", r"https*://vimeo.com/[0-9]+/*", r"https*://www.dailymotion.com/video/[0-9A-Za-z]+_.*", r"https*://flickr.com/photos/[0-9A-Za-z@]+/[0-9A-Za-z@]+/*.*", r"https*://twitpic.com/[0-9A-Za-z]+/*.*")
_SQL_VIDEO = (r"\S+\.(?i:webm|mkv|flv|ogg|ogv|avi|mov|wmv|rm|mp4|m4v|mpg|mpeg|mp2|m2v|3gp|3g2|mxf)", _SQL_MEDIA[2], _SQL_MEDIA[3], _SQL_MEDIA[4])


@query("media_url_flag", _flag_sql(*_SQL_MEDIA))
def media_url_flag(s, d):
    return _flags(s, d, U.is_media_url)


@query("video_url_flag", _flag_sql(*_SQL_VIDEO))
def video_url_flag(s, d):
    return _flags(s, d, U.is_video_url)


@query("normalize_url", rf"""SELECT page_id, src, CASE src WHEN '/img/a.jpg' THEN {_SITE} || src WHEN '../img/b.png' THEN {_SITE} || regexp_extract(url, '^[a-z]+://[^/]*(/[a-z][a-z])/[0-9]+', 1) || '/img/b.png' WHEN 'c.gif' THEN {_SITE} || '/c.gif' WHEN '//cdn.example.com/e.jpg' THEN {_SITE} || src ELSE src END AS normalized, src <> 'http://cdn.example.com/d.jpg' AS success
FROM pages, (VALUES ('/img/a.jpg'), ('../img/b.png'), ('c.gif'), ('http://cdn.example.com/d.jpg'), ('//cdn.example.com/e.jpg')) v(src)""")
def normalize_url(s, d):
    t = table(s, d, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, SOURCES))).alias("src"))
    return t.select("page_id", "src", U.normalize_url(F.col("src"), F.col("url")).alias("n")).select("page_id", "src", "n.*")


@query("url_uuid", "SELECT page_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '3' || substr(h, 14, 3), substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS id FROM (SELECT page_id, md5(url) AS h FROM pages)")
def url_uuid(s, d):
    return table(s, d, "pages").select("page_id", U.url_uuid(F.col("url")).alias("id"))


@query("dedup_first", f"SELECT host, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url, page_id) AS k FROM (SELECT {_HOST_SQL} AS host, page_id, url FROM pages)) WHERE k = 1")
def dedup_first(s, d):
    return M.first_of_each(table(s, d, "pages").select(U.host(F.col("url")).alias("host"), "page_id", "url"), "host", ["url", "page_id"])


def _seeds(s):
    return s.createDataFrame([(x,) for x in SEEDS], "seed string")


_VALUES = ", ".join(f"('{x}')" for x in SEEDS)


@query("seed_semi_join", f"SELECT page_id, url FROM pages WHERE {_HOST_SQL} IN ({', '.join(repr(x) for x in SEEDS)}, (SELECT min({_HOST_SQL}) FROM pages))")
def seed_semi_join(s, d):
    t = table(s, d, "pages").select("page_id", "url", U.host(F.col("url")).alias("seed"))
    seeds = _seeds(s).union(t.agg(F.min("seed").alias("seed")))
    return t.join(F.broadcast(seeds), "seed", "left_semi").select("page_id", "url")  # a seed list of fixed length


@query("seed_contains_join", f"SELECT seed, count(*) AS n FROM pages JOIN (VALUES {_VALUES}) v(seed) ON contains(url, seed) GROUP BY 1")
def seed_contains_join(s, d):
    t = table(s, d, "pages").select("url")
    return _count(t.join(F.broadcast(_seeds(s)), F.col("url").contains(F.col("seed"))).select("seed"), "seed")


@query("dom_avg_int", "SELECT l_returnflag, sum(l_linenumber) // count(*) AS avg_int, round(avg(l_linenumber), 6) AS avg_true FROM lineitem GROUP BY 1")
def dom_avg_int(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.expr("sum(l_linenumber) div count(*)").alias("avg_int"), F.round(F.avg("l_linenumber"), 6).alias("avg_true"))


@query("balance_classes", """WITH r AS (SELECT doc_id, (quality = 0)::INT AS s, (quality = 1)::INT AS b FROM labels), c AS (SELECT *, sum(s) OVER w AS ss, sum(b) OVER w AS bb FROM r WINDOW w AS (ORDER BY doc_id)),
k AS (SELECT *, ss + least(0, min(bb + 1 - ss) OVER (ORDER BY doc_id)) AS k FROM c) SELECT doc_id, b AS quality FROM (SELECT *, coalesce(lag(k) OVER (ORDER BY doc_id), 0) AS was FROM k) WHERE b = 1 OR k > was""")
def balance_classes(s, d):
    return L.balance(table(s, d, "labels").select("doc_id", "quality"), F.col("quality") == 0, F.col("quality") == 1, [F.col("doc_id")])


def _freq(s, d, least=3, most=5, having=1, tokens=X.url_tokens_a):
    t = table(s, d, "pages").select(F.when(F.col("page_id") % 3 == 0, "BIG").otherwise("SMALL").alias("cls"), "url")
    return L.ngram_counts(t, tokens(F.col("url")), least, most, F.col("cls"), having)


@query("ngram_freq_3_5", _grams(3, 5))
def ngram_freq_3_5(s, d):
    return _freq(s, d)


@query("ngram_freq_2_15", _grams(2, 15, tokens=_TOKENS_B))
def ngram_freq_2_15(s, d):
    return _freq(s, d, 2, 15, tokens=X.url_tokens_b)


@query("ngram_having", _grams(3, 5, " HAVING count(*) >= 50"))
def ngram_having(s, d):
    return _freq(s, d, having=50)


@query("ngram_having_100", _grams(2, 15, " HAVING count(*) >= 100", _TOKENS_B))
def ngram_having_100(s, d):
    return _freq(s, d, 2, 15, 100, X.url_tokens_b)


@query("alt_ngram_freq", "SELECT ngram, count(*) AS n FROM (SELECT DISTINCT page_id, substr(alt, i::INT, n::INT) AS ngram FROM (SELECT page_id, substr(html, 16, (page_id % 40)::INT) AS alt FROM pages) t, unnest(generate_series(1, length(alt))) a(i), generate_series(2, 15) b(n) WHERE i + n - 1 <= length(alt)) GROUP BY 1")
def alt_ngram_freq(s, d):
    alt = F.expr("substring(html, 16, cast(page_id % 40 as int))")
    return _count(table(s, d, "pages").select(F.explode(X.alt_grams(alt)).alias("ngram")), "ngram")


_BALANCED_PAGES = """(WITH r AS (SELECT *, (page_id * 37 % 600 < 200)::INT AS s, (page_id * 37 % 600 > 400)::INT AS b FROM pages WHERE page_id * 37 % 600 < 200 OR page_id * 37 % 600 > 400), c AS (SELECT *, sum(s) OVER w AS ss, sum(b) OVER w AS bb FROM r WINDOW w AS (ORDER BY page_id)),
k AS (SELECT *, ss + least(0, min(bb + 1 - ss) OVER (ORDER BY page_id)) AS k FROM c) SELECT page_id, CASE WHEN s = 1 THEN 'SMALL' ELSE 'BIG' END AS cls, url FROM (SELECT *, coalesce(lag(k) OVER (ORDER BY page_id), 0) AS was FROM k) WHERE b = 1 OR k > was)"""


@query("balanced_ngram_freq", _grams(2, 15, " HAVING count(*) >= 2", _TOKENS_B, _BALANCED_PAGES))
def balanced_ngram_freq(s, d):
    side = F.col("page_id") * 37 % 600
    images = C.labelled(table(s, d, "pages").select("page_id", F.col("url").alias("normalizedSrc")), side, side)
    return C.balanced_counts(images, [F.col("page_id")], X.url_tokens_b(F.col("normalizedSrc")), 2, 15, 2)


#: URLs with escapes, and their tokens by the three rules; `%zz` is no escape, so that URL stays as it is.
_ESCAPED = (
    (-1, "http://a.com/my%20pics/big-logo.jpeg", "a,com,my pics,big,logo", "http,a,com,my,pics,big,logo,jpeg", "a,com,my%20pics,big,logo"),
    (-2, "http://a.com/a+b/100%25-c.html", "a,com,a b,100%,c", "http,a,com,a,b,100,c,html", "a,com,a+b,100%25,c"),
    (-3, "http://a.com/%zz/Ab.x", "a,com,%zz,Ab", "http,a,com,zz,Ab,x", "a,com,%zz,ab"),
    (-4, "httpfoo.jpg", "tpfoo", "httpfoo,jpg", "tpfoo"),
    (-5, "ftp://a.com/x%2Fy.png", "ftp:,a,com,x,y", "ftp,a,com,x,y,png", "ftp:,a,com,x%2fy"),
)


def _with_escaped(s, d, tokens):
    pages = table(s, d, "pages").select("page_id", "url").union(s.createDataFrame([x[:2] for x in _ESCAPED], "page_id bigint, url string"))
    return pages.select("page_id", F.array_join(tokens(F.col("url")), ",").alias("tokens"))


def _escaped_sql(which: int) -> str:
    return " UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({x[0]}, '{x[which]}')" for x in _ESCAPED) + ")"


@query("url_tokens_a", rf"SELECT page_id, array_to_string(list_filter(regexp_split_to_array({_A}, '[/.\-]'), lambda x: x <> ''), ',') AS tokens FROM pages" + _escaped_sql(2))
def url_tokens_a(s, d):
    return _with_escaped(s, d, X.url_tokens_a)


@query("url_tokens_b", r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(url, '\W+'), lambda x: x <> ''), ',') AS tokens FROM pages" + _escaped_sql(3))
def url_tokens_b(s, d):
    return _with_escaped(s, d, X.url_tokens_b)


@query("url_tokens_c", rf"SELECT page_id, lower(array_to_string(list_filter(regexp_split_to_array({_A}, '[/.\-]'), lambda x: x <> ''), ',')) AS tokens FROM pages" + _escaped_sql(4))
def url_tokens_c(s, d):
    return _with_escaped(s, d, X.url_tokens_c)


def _score_sql(freq: str, top: int, exclusive: str = "n") -> str:
    return f"""WITH f AS ({freq}), s AS (SELECT cls, ngram, CASE WHEN count(*) OVER (PARTITION BY ngram) = 1 THEN {exclusive} ELSE n - (sum(n) OVER (PARTITION BY ngram) - n) END::BIGINT AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, ngram) AS k FROM s WHERE score > 0)
SELECT (k - 1 + CASE WHEN cls = 'BIG' THEN 0 ELSE (SELECT coalesce(max(k), 0) FROM r WHERE cls = 'BIG' AND k <= {top}) END)::BIGINT AS idx, ngram, cls, score FROM r WHERE k <= {top}"""


_PRUNED = f"""WITH f AS ({_grams(3, 5)}), q AS (SELECT DISTINCT cls, lower(substr(ngram, i::INT, m::INT)) AS part FROM f, generate_series(1, 5) a(i), generate_series(1, 5) b(m) WHERE i + m - 1 <= length(ngram) AND m < length(ngram)),
p AS (SELECT f.* FROM f ANTI JOIN q ON f.cls = q.cls AND lower(f.ngram) = q.part),
s AS (SELECT a.cls, a.ngram, coalesce(a.n - b.n, 50)::BIGINT AS score FROM p a LEFT JOIN f b ON b.cls = 'SMALL' AND a.ngram = b.ngram WHERE a.cls = 'BIG' UNION ALL SELECT a.cls, a.ngram, coalesce(a.n - b.n, 50)::BIGINT FROM p a LEFT JOIN p b ON b.cls = 'BIG' AND a.ngram = b.ngram WHERE a.cls = 'SMALL'),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, ngram) AS k FROM s WHERE score > 0)
SELECT (k - 1 + CASE WHEN cls = 'BIG' THEN 0 ELSE (SELECT coalesce(max(k), 0) FROM r WHERE cls = 'BIG' AND k <= 1000) END)::BIGINT AS idx, lower(ngram) AS ngram, cls, score FROM r WHERE k <= 1000"""


@query("vocab_score", _score_sql(_grams(3, 5), 500))
def vocab_score(s, d):
    return L.vocabulary(_freq(s, d)).withColumn("idx", F.col("idx").cast("bigint"))


@query("vocab_topk", _score_sql(_grams(3, 5), 100))
def vocab_topk(s, d):
    return L.vocabulary(_freq(s, d), top=100).withColumn("idx", F.col("idx").cast("bigint"))


@query("vocab_pruned", _PRUNED)
def vocab_pruned(s, d):
    return L.pruned_vocabulary(_freq(s, d)).withColumn("idx", F.col("idx").cast("bigint"))


@query("vocab_exclusive", f"WITH f AS ({_grams(3, 5)}) SELECT ngram, n FROM f WHERE cls = 'BIG' AND ngram NOT IN (SELECT ngram FROM f WHERE cls = 'SMALL')")
def vocab_exclusive(s, d):
    return L.exclusive_ngrams(_freq(s, d), "BIG")


@query("ngram_vector", f"""WITH v AS ({_score_sql(_grams(3, 5), 100)}), g AS (SELECT DISTINCT page_id, lower(substr(token, i::INT, n::INT)) AS ngram FROM ({_TOKENS_A}) t, unnest(generate_series(1, length(token))) a(i), generate_series(2, 15) b(n) WHERE i + n - 1 <= length(token))
SELECT page_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS hits FROM g JOIN v USING (ngram) GROUP BY 1""")
def ngram_vector(s, d):
    v = L.ngram_vector(table(s, d, "pages"), "page_id", X.url_tokens_c(F.col("url")), L.vocabulary(_freq(s, d), top=100), 2, 15)
    return v.select("page_id", F.array_join(F.transform("hits", lambda i: i.cast("string")), ",").alias("hits"))


@query("url_dims", "SELECT url || '/w_75_h_50/' || page_id || 'x20.jpg' AS src, page_id::INT AS width, 20 AS height FROM pages")
def url_dims(s, d):
    t = table(s, d, "pages").select(F.concat("url", F.lit("/w_75_h_50/"), "page_id", F.lit("x20.jpg")).alias("src"))
    return t.select("src", X.url_dims(F.col("src")).alias("d")).select("src", "d.*")


_IMAGE_URL = f"CASE page_id % 6 WHEN 0 THEN 'http://cdn.example.com/' || page_id || '/350x250.png' WHEN 1 THEN 'https://' || upper({_HOST_SQL}) || '/img/w_' || page_id % 500 || '/a.jpeg' WHEN 2 THEN 'http://x.com/photo_' || page_id || '.gif' WHEN 3 THEN 'http://x.com/i?width=300&height=' || page_id || '&f=a.bmp' WHEN 4 THEN 'http://x.com/t.tiff' END"
_ELEMENT = "CASE page_id % 7 WHEN 0 THEN 'img' WHEN 1 THEN 'link' WHEN 2 THEN 'a' WHEN 3 THEN 'embed' WHEN 4 THEN 'iframe' WHEN 5 THEN 'object' END"


def _images(s, d):
    url = _IMAGE_URL.replace(_HOST_SQL, "page_host")
    t = table(s, d, "pages").withColumn("page_host", U.host(F.col("url")))
    return t.select(
        "page_id", F.expr(url).alias("normalizedSrc"), F.col("url").alias("pageUrl"), F.expr("CASE WHEN page_id % 13 > 0 THEN substring(html, 1, cast(page_id % 50 as int)) END").alias("alt"), F.expr("CASE WHEN page_id % 3 > 0 THEN repeat('x', cast(page_id % 30 as int)) END").alias("parentTxt"),
        F.expr(_ELEMENT).alias("domElem"), F.expr("CASE WHEN page_id % 11 > 0 THEN cast(page_id % 9 as int) END").alias("domSib"), (F.col("page_id") % 20).cast("int").alias("domDepth"),
    )


_FEATURE_SQL = f"""SELECT page_id, (k = 1)::INT AS suffix_jpeg, (k = 0)::INT AS suffix_png, (k = 3)::INT AS suffix_bmp, (k = 2)::INT AS suffix_gif, (k = 4)::INT AS suffix_tiff, (page_id % 20)::INT AS "f_domDepth", CASE WHEN page_id % 11 > 0 THEN (page_id % 9)::INT ELSE 0 END AS "f_domSiblings",
(w > 0)::INT AS "hasWidth", w AS width, (h > 0)::INT AS "hasHeight", h AS height, (k = 1)::INT AS samedomain, (e = 0)::INT AS dom_img, (e = 1)::INT AS dom_link, (e = 2)::INT AS dom_a, (e = 3)::INT AS dom_embed, (e = 4)::INT AS dom_iframe, (e = 5)::INT AS dom_object,
(a > 0)::INT AS "hasAltText", a AS "altTextLength", (t > 0)::INT AS "hasParentText", t AS "parentTextLength", coalesce(length({_IMAGE_URL}), 0)::INT AS "urlLength"
FROM (SELECT *, page_id % 6 AS k, page_id % 7 AS e, CASE page_id % 6 WHEN 0 THEN 350 WHEN 1 THEN page_id % 500 WHEN 3 THEN 300 ELSE 0 END::INT AS w, CASE page_id % 6 WHEN 0 THEN 250 WHEN 2 THEN page_id WHEN 3 THEN page_id ELSE 0 END::INT AS h, CASE WHEN page_id % 13 > 0 THEN least(page_id % 50, length(html)) ELSE 0 END::INT AS a, CASE WHEN page_id % 3 > 0 THEN page_id % 30 ELSE 0 END::INT AS t FROM pages)"""


@query("features23", _FEATURE_SQL)
def features23(s, d):
    return L.features23(_images(s, d)).select("page_id", *C.FEATURES)


def _labelled(s, d):
    side = F.col("page_id") * 37 % 600
    return C.labelled(_images(s, d).withColumn("normalizedSrc", F.coalesce("normalizedSrc", "pageUrl")), side, side)


def _trained(s, d) -> tuple:
    """Two forests of labelled images whose number isn't divisible by 4, saved and loaded again."""
    images = C.balanced(_labelled(s, d).filter("page_id % 4 > 0"), [F.col("page_id")])
    counts = L.ngram_counts(images, X.url_tokens_a(F.col("normalizedSrc")), 3, 5, F.when(F.col("isBig"), "BIG").otherwise("SMALL"))
    folder = f"{shared_dir(s)}/models-{uuid.uuid4().hex}"
    C.save_pair(C.train_pair(images, L.vocabulary(counts, top=100), trees=10), folder)
    return C.load_pair(folder)


@query("learning_chain")
def learning_chain(s, d):
    return C.evaluation(_labelled(s, d).filter("page_id % 4 = 0"), _trained(s, d))


@query("gated_images")
def gated_images(s, d):
    return C.gated(_images(s, d), _trained(s, d)).select("page_id", "normalizedSrc")


@query("gate_flags", "SELECT p_partkey, (p_size * 800 > 20000 AND p_partkey % 3 > 0)::INT AS headers, (p_size * 12 >= 400 AND p_size * 11 >= 400)::INT AS large, (p_partkey % 3 > 0)::INT AS image, (p_partkey % 5 > 0)::INT AS sourced FROM part")
def gate_flags(s, d):
    kind = F.when(F.col("p_partkey") % 3 > 0, "image/png").otherwise("text/html")
    t = table(s, d, "part").withColumns({"src": F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise(F.lit("")), "pageUrl": F.col("p_brand")})
    size = F.col("p_size")
    flags = {"headers": G.passes_headers(size * 800, kind), "large": G.is_large(size * 12, size * 11), "image": G.is_image_type(kind), "sourced": G.has_source()}
    return t.select("p_partkey", *(c.cast("int").alias(n) for n, c in flags.items()))


@query("listed_first", "SELECT DISTINCT l_orderkey AS url FROM lineitem ORDER BY 1 LIMIT 8000")
def listed_first(s, d):
    return G.first_distinct(table(s, d, "lineitem").select(F.col("l_orderkey").alias("url")), "url")


@query("lines_capped", "SELECT least(count(*), 2000000)::BIGINT AS n, (SELECT least(count(*), 100)::BIGINT FROM lineitem) AS few FROM lineitem")
def lines_capped(s, d):
    t = table(s, d, "lineitem").select("l_orderkey")
    return G.first_lines(t).agg(F.count("*").alias("n")).crossJoin(G.first_lines(t, 100).agg(F.count("*").alias("few")))  # a row each


@query("modified_dates", "SELECT event_id, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(event_id * 86399123), '%Y-%m-%d %H:%M:%S') AS modified FROM events WHERE event_id < 20000")
def modified_dates(s, d):
    t = X.modified_date(F.col("event_id") * 86399123)
    return table(s, d, "events").filter("event_id < 20000").select("event_id", F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query("label_by_dims", "SELECT p_partkey, CASE WHEN w < 200 AND h < 200 THEN 'SMALL' WHEN w > 400 AND h > 400 THEN 'BIG' END AS label FROM (SELECT p_partkey, p_size * 12 AS w, p_size * 11 AS h FROM part)")
def label_by_dims(s, d):
    return table(s, d, "part").select("p_partkey", L.label_by_dims(F.col("p_size") * 12, F.col("p_size") * 11).alias("label"))


_MODELS = "SELECT doc_id, quality, (doc_id * 7 % 101) / 100.0::DOUBLE AS p, (doc_id * 13 % 101) / 100.0::DOUBLE AS q FROM labels"
_ARBITRATED = f"SELECT doc_id, quality, CASE WHEN c1 = c2 THEN c1 WHEN abs(p - (1 - p)) + 0.05::DOUBLE > abs(q - (1 - q)) THEN c1 ELSE c2 END AS predicted FROM (SELECT *, (p > 0.5)::INT AS c1, (q > 0.5)::INT AS c2 FROM ({_MODELS}))"


def _arbitrated(s, d):
    p, q = (F.col("doc_id") * 7 % 101) / 100.0, (F.col("doc_id") * 13 % 101) / 100.0
    return table(s, d, "labels").select("doc_id", "quality", L.arbitrate((p > 0.5).cast("int"), F.array(p, 1 - p), (q > 0.5).cast("int"), F.array(q, 1 - q)).alias("predicted"))


@query("arbitrate", _ARBITRATED)
def arbitrate(s, d):
    return _arbitrated(s, d)


@query("confusion_f1", f"""WITH c AS (SELECT sum((quality = 1 AND predicted = 1)::INT)::BIGINT AS tp, sum((quality = 0 AND predicted = 1)::INT)::BIGINT AS fp, sum((quality = 1 AND predicted = 0)::INT)::BIGINT AS fn, sum((quality = 0 AND predicted = 0)::INT)::BIGINT AS tn FROM ({_ARBITRATED})),
f AS (SELECT *, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1_big, round(2.0::DOUBLE * tn / (2 * tn + fp + fn), 6) AS f1_small FROM c) SELECT *, round((f1_big + f1_small) / 2, 6) AS f1_mean FROM f""")
def confusion_f1(s, d):
    return L.class_metrics(_arbitrated(s, d), "quality", "predicted")


@query("class_report", f"""WITH a AS ({_ARBITRATED}), c AS (SELECT sum((quality = 1 AND predicted = 1)::INT)::BIGINT AS tp, sum((quality = 0 AND predicted = 1)::INT)::BIGINT AS fp, sum((quality = 1 AND predicted = 0)::INT)::BIGINT AS fn, sum((quality = 0 AND predicted = 0)::INT)::BIGINT AS tn FROM a),
s AS (SELECT 'BIG' AS cls, tp, fp, fn FROM c UNION ALL SELECT 'SMALL', tn, fn, fp FROM c) SELECT cls, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS "precision", round(tp::DOUBLE / (tp + fn), 6) AS recall, round((2 * tp)::DOUBLE / (2 * tp + fp + fn), 6) AS f1 FROM s""")
def class_report(s, d):
    return L.class_report(_arbitrated(s, d), "quality", "predicted")


@query("rf_eval")
def rf_eval(s, d):
    t = table(s, d, "embeddings")
    t = t.select((F.col("label") % 2).cast("double").alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(4)).alias("fold"), *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    model = L.train_forest(t.filter("fold > 0"), [f"e{i}" for i in range(64)], "y")
    return L.class_metrics(model.transform(t.filter("fold = 0")).select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("p")), "y", "p")


@query("offset_page", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 10 OFFSET 20")
def offset_page(s, d):
    return table(s, d, "pages").select("page_id", "url").orderBy("page_id").offset(20).limit(10)


@query("topk_hosts", f"SELECT host, n FROM (SELECT {_HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, host LIMIT 20")
def topk_hosts(s, d):
    return host_freq(s, d).orderBy(F.desc("n"), "host").limit(20)


@query("sorted_distinct_hosts", f"SELECT DISTINCT {_HOST_SQL} AS host FROM pages ORDER BY 1")
def sorted_distinct_hosts(s, d):
    return table(s, d, "pages").select(U.host(F.col("url")).alias("host")).distinct().orderBy("host")


#: A page with each kind of element, as the driver's pages refer to no media.
_FIXTURE = """<html><head><link href="/i.png"><link href="/s.css"></head><body><div>txt
<img src="a.jpg" alt="A" width="10" height="20"><img alt="no src">
<a href="b.jpg">big <b>pic</b></a><a href="c.html">no</a>
<video width="3" height="4"><source src="v.mp4"><source src="v.webm"></video>
<iframe src="http://www.youtube.com/watch?v=q" width="5"></iframe><embed src="x.bin">
<object name="o" data="m.swf"></object></div></body></html>"""


@query("media_extract", """SELECT src, alt, w, h, 'http://h.com/p' AS "pageUrl", "parentTxt", "domSib", "domDepth", "domElem" FROM (VALUES ('/i.png', NULL, NULL, NULL, NULL, 1, 3, 'link'), ('a.jpg', 'A', '10', '20', 'txt big picno', 7, 4, 'img'), ('b.jpg', 'big pic', NULL, NULL, 'txt big picno', 7, 4, 'a'), ('v.mp4', NULL, '3', '4', NULL, 1, 5, 'source'), ('v.webm', NULL, '3', '4', NULL, 1, 5, 'source'), ('http://www.youtube.com/watch?v=q', NULL, '5', '', 'txt big picno', 7, 4, 'iframe'), ('m.swf', 'o', '', '', 'txt big picno', 7, 4, 'object')) v(src, alt, w, h, "parentTxt", "domSib", "domDepth", "domElem")""")
def media_extract(s, d):
    fixture = s.createDataFrame([(_FIXTURE, "http://h.com/p")], "html string, url string")
    return M.extract_media(table(s, d, "pages").select("html", "url").unionByName(fixture))


@query("media_img_only", """SELECT src, alt, w, h, "pageUrl", "parentTxt", NULL::INT AS "domSib", NULL::INT AS "domDepth", NULL::VARCHAR AS "domElem" FROM (VALUES ('a.jpg', 'A', '10', '20', 'http://h.com/p', 'txt big picno')) v(src, alt, w, h, "pageUrl", "parentTxt")""")
def media_img_only(s, d):
    fixture = s.createDataFrame([(_FIXTURE, "http://h.com/p")], "html string, url string")
    return M.extract_media(table(s, d, "pages").select("html", "url").unionByName(fixture), only_img=True)


def _archived(s: SparkSession, rows: DataFrame, suffix: str = ".warc.gz") -> DataFrame:
    """Rows (rec_type, url, mimetype, content) as archives in the shared folder, read back by the data source, without the map of headers that no job reads."""
    from arachne.sinks.warc import write_warc
    from arachne.sources.warc import WarcDataSource

    folder = f"{shared_dir(s)}/archives-{uuid.uuid4().hex}"
    write_warc(rows, folder, suffix=suffix)
    s.dataSource.register(WarcDataSource)
    return s.read.format("warc").option("headers", "false").load(f"{folder}/*{suffix}")


_MIME = "CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN 'application/http; msgtype=request' ELSE 'application/http; msgtype=response' END"


def _responses(s, d):
    return _archived(s, table(s, d, "pages").select(F.lit("response").alias("rec_type"), "url", F.expr(_MIME).alias("mimetype"), F.expr(_PAYLOAD).alias("content")))


@query("archive_tag_count", r"SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([^\s>/][^\s>]*)([^>]*)>', 1)) AS tag FROM pages WHERE page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id % 2 = 0 AND page_id % 5 <> 0) GROUP BY 1")
def archive_tag_count(s, d):
    return A.tag_counts(_responses(s, d)).result


@query("archive_tag_counters", "SELECT count(*) FILTER (page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id % 2 = 0 AND page_id % 5 <> 0) AS records_in, count(*) FILTER (page_id % 11 = 0 OR page_id % 13 <> 0 AND page_id % 5 = 0) AS exceptions FROM pages")
def archive_tag_counters(s, d):
    return A.tag_counts(_responses(s, d)).counters


@query("archive_media", """SELECT src, alt, w, h, min("pageUrl") AS "pageUrl", 't' AS "parentTxt", 1 AS "domSib", 3 AS "domDepth", e AS "domElem" FROM (SELECT '/p' || page_id % 40 || '.jpg' AS src, 'x' AS alt, '1' AS w, '2' AS h, url AS "pageUrl", 'img' AS e FROM pages WHERE page_id % 13 <> 0 UNION ALL SELECT '/q' || page_id % 7 || '.png', 't', NULL, NULL, url, 'a' FROM pages WHERE page_id % 13 <> 0) GROUP BY src, alt, w, h, e""")
def archive_media(s, d):
    page = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html><body><img src=\"/p"), (F.col("page_id") % 40).cast("string"), F.lit('.jpg" alt="x" width="1" height="2"><a href="/q'), (F.col("page_id") % 7).cast("string"), F.lit('.png">t</a></body></html>'))
    kind = F.when(F.col("page_id") % 13 == 0, "application/json").otherwise(A.RESPONSE)
    return A.media_job(_archived(s, table(s, d, "pages").select(F.lit("response").alias("rec_type"), "url", kind.alias("mimetype"), page.alias("content")))).result


def _metadata(s, d):
    path = "Payload-Metadata\": {\"HTTP-Response-Metadata"
    server = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"Server": "srv '), F.get_json_object("props", "$.k"), F.lit('"')))
    content = F.when(F.col("event_id") % 17 == 0, F.lit("no json {")).otherwise(F.concat(F.lit('{"Envelope": {"' + path + '": {"Headers": {'), server, F.lit("}}}}}")))
    kind = F.when(F.col("event_id") % 19 == 0, "text/plain").otherwise("application/json")
    return _archived(s, table(s, d, "events").select(F.lit("metadata").alias("rec_type"), F.lit(None).cast("string").alias("url"), kind.alias("mimetype"), content.alias("content")), ".warc.wat.gz")


@query("archive_server_count", "SELECT 'srv ' || json_extract_string(props, '$.k') AS server, count(*) AS n FROM events WHERE event_id % 5 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 GROUP BY 1")
def archive_server_count(s, d):
    return A.server_counts(_metadata(s, d)).result


@query("archive_server_counters", "SELECT count(*) AS records_in, count(*) FILTER (event_id % 17 = 0) AS exceptions FROM events WHERE event_id % 19 <> 0")
def archive_server_counters(s, d):
    return A.server_counts(_metadata(s, d)).counters


def _texts(s, d):
    kind = F.when(F.col("doc_id") % 7 == 0, "text/html").otherwise("text/plain")
    content = F.when(F.col("doc_id") % 10 == 3, F.lit(" \n\t")).otherwise(F.col("text"))
    return _archived(s, table(s, d, "documents").select(F.lit("conversion").alias("rec_type"), F.lit("http://a.com/").alias("url"), kind.alias("mimetype"), content.alias("content")), ".warc.wet.gz")


@query("archive_word_count", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS word FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 10 <> 3) GROUP BY 1")
def archive_word_count(s, d):
    return A.word_counts(_texts(s, d)).result


@query("archive_word_counters", r"SELECT count(*) FILTER (doc_id % 7 <> 0) AS records_in, count(*) FILTER (doc_id % 7 <> 0 AND (doc_id % 10 = 3 OR NOT regexp_matches(coalesce(text, ''), '[^ \t\n\r\f]'))) AS empty_page_text, count(*) FILTER (doc_id % 7 = 0) AS non_plain_text, 0::BIGINT AS exceptions FROM documents")
def archive_word_counters(s, d):
    return A.word_counts(_texts(s, d)).counters


def _described(s, d):
    """Images of 20 local descriptors each."""
    return table(s, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 20).alias("g")).agg(F.sort_array(F.collect_list("embedding")).alias("descriptors"))


@query("vlad_aggregate")
def vlad_aggregate(s, d):
    from arachne.operators import vectors as V

    books = [V.codebook(table(s, d, "embeddings"), "embedding", 8, seed=i) for i in range(4)]
    v = V.vlad(_described(s, d), "descriptors", books)
    return v.select("g", F.size("vlad").alias("length"), F.round(F.aggregate("vlad", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.array_join(F.transform(F.slice("vlad", 1, 8), lambda x: F.round(x, 4).cast("string")), ",").alias("head"))


@query("pca_project")
def pca_project(s, d):
    from arachne.operators import vectors as V

    t = table(s, d, "embeddings")
    return V.project(t, "embedding", V.fit_pca(t, "embedding", 16), 16).select("vec_id", F.size("projected").alias("length"), F.array_join(F.transform("projected", lambda x: F.round(x, 4).cast("string")), ",").alias("projected"))


def _coded(s, d):
    from arachne.operators import vectors as V

    t = table(s, d, "embeddings")
    return V.ivfpq_codes(t.select("vec_id", "embedding"), "embedding", V.fit_ivfpq(t, "embedding", lists=16, parts=8, k=32))


@query("ivfpq_codes")
def ivfpq_codes(s, d):
    return _coded(s, d).select("vec_id", "list_id", F.array_join(F.transform("code", lambda c: c.cast("string")), ",").alias("code"))


@query("index_insert", "SELECT vec_id FROM embeddings")
def index_insert(s, d):
    from arachne.operators import vectors as V

    path = f"{shared_dir(s)}/index-{uuid.uuid4().hex}"
    codes = _coded(s, d)
    V.insert_codes(codes.filter("vec_id % 2 = 0"), path, "vec_id")
    V.insert_codes(codes, path, "vec_id")
    return s.read.parquet(path).select("vec_id")


@query("rank_manifest", "SELECT 's3://b/' || url AS path FROM (SELECT url, row_number() OVER (ORDER BY page_id) AS line FROM pages) WHERE line >= 11 AND line < 21")
def rank_manifest(s, d):
    from arachne.sources.textfiles import manifest_range

    path = f"{shared_dir(s)}/manifest-{uuid.uuid4().hex}"
    table(s, d, "pages").orderBy("page_id").coalesce(1).select("url").write.text(path)
    return manifest_range(s, path, 11, 21, "s3://b/")


@query("line_numbers", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS line FROM pages")
def line_numbers(s, d):
    return numbered(table(s, d, "pages").select("page_id", "url"), [F.col("url"), F.col("page_id")]).select("page_id", "line")
