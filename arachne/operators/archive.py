"""Jobs over records of web archives: tags and media of responses, servers of metadata, words of texts.

Each takes the rows of sources.warc and gives a Job: its result, and its counters as one row. A record that can't be read counts as
an exception and ends nothing. Result and counters are queries of their own, so each computes only what it needs. (Not an Observation: a session that has
had one can't run MLlib's forests any more in Spark 4.1, as its closures then hold what can't be sent.)
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arachne.functions import text as X
from arachne.operators.media import extract_media, first_of_each

#: The records' types, and the header text of pages whose tags are counted.
RESPONSE, METADATA, PLAIN = "application/http; msgtype=response", "application/json", "text/plain"
HTML = "Content-Type: text/html"
SERVER = "$.Envelope['Payload-Metadata']['HTTP-Response-Metadata'].Headers.Server"


def _text(column: str = "content") -> Column:
    return F.make_valid_utf8(F.col(column).cast("string"))


class Job(NamedTuple):
    result: DataFrame
    counters: DataFrame


def _many(condition: Column) -> Column:
    """The number of rows that meet a condition, nulls not; 0 without rows."""
    return F.count(F.when(condition, True))


def _job(rows: DataFrame, keys: Column, name: str, conditions: dict[str, Column]) -> Job:
    """Counts of the keys of all rows, an array each, and of the rows that meet each condition."""
    counts = rows.select(F.explode(keys).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return Job(counts, rows.agg(*(_many(c).alias(n.lower()) for n, c in conditions.items())))


def tag_counts(records: DataFrame) -> Job:
    """(tag, n) of HTML responses. Counters: records_in (these), exceptions (responses whose header doesn't end, and records without a
    type)."""
    typed, parts = F.col("mimetype").isNotNull(), X.http_parts(_text())
    some = records.filter(~typed | (F.col("mimetype") == RESPONSE)).select("mimetype", parts.alias("p"))
    html = typed & F.col("p.header").contains(HTML)
    return _job(some, F.when(html, X.tags(F.col("p.body"))), "tag", {"RECORDS_IN": html, "EXCEPTIONS": ~typed | F.col("p").isNull()})


def server_counts(records: DataFrame) -> Job:
    """(server, n) of JSON metadata; a server that is no text counts as its text. Records without a server are passed over. Counters:
    records_in, exceptions (no JSON)."""
    some = records.filter(F.col("mimetype") == METADATA).select(_text().alias("content"))
    server = F.get_json_object("content", SERVER)
    return _job(some, F.filter(F.array(server), lambda x: x.isNotNull()), "server", {"RECORDS_IN": F.lit(True), "EXCEPTIONS": F.try_parse_json("content").isNull()})


def word_counts(records: DataFrame) -> Job:
    """(word, n) of plain texts. Counters: records_in (plain texts), empty_page_text (those without a word), non_plain_text
    (records of other types), exceptions (records without a type)."""
    plain = F.col("mimetype") == PLAIN
    some = records.select("mimetype", F.when(plain, X.words(_text())).alias("words"))
    return _job(some, F.col("words"), "word", {"RECORDS_IN": plain, "EMPTY_PAGE_TEXT": plain & (F.size("words") == 0), "NON_PLAIN_TEXT": F.col("mimetype") != PLAIN, "EXCEPTIONS": F.col("mimetype").isNull()})


def media_job(records: DataFrame, parse_headers: bool = False, only_img: bool = False) -> Job:
    """The first reference of each source in all responses, whatever their content: by page, depth, element and the rest. Counters: records_in
    (responses), exceptions (those whose header doesn't end, and records without a type), by a pass of their own.

    parse_headers: pages are parsed with their HTTP headers before them, whose text is then part of the body's, and responses without
    an end of the header are parsed too.
    """
    typed = F.col("mimetype").isNotNull()
    some = records.filter(~typed | (F.col("mimetype") == RESPONSE)).select("url", "mimetype", _text().alias("content"))
    some = some.withColumn("p", X.http_parts(F.col("content")))
    html = F.col("content") if parse_headers else F.col("p.body")
    refs = extract_media(some.filter(typed).select(html.alias("html"), "url"), only_img=only_img)
    first = first_of_each(refs, "src", ["pageUrl", "domDepth", "domElem", "domSib", "alt", "w", "h", "parentTxt"])
    return Job(first, some.agg(_many(typed).alias("records_in"), _many(~typed | F.col("p").isNull()).alias("exceptions")))
