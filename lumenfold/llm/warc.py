"""WARC archives: writing captures and assembling transactions on reading.

Writing. A capture becomes three WARC/1.1 records: request, response (or
revisit) and metadata; request and metadata name the response in
WARC-Concurrent-To. Of captures with equal payloads of ``MIN_REVISIT`` bytes or
more, the one with the largest page_id is written as response, and the others
as revisit records without payload that refer to it. Every record is UTF-8 text,
so Spark's text writer with the record separator as its line end writes the
archives: tasks write whole files in parallel, and a lost task is written anew
without leaving parts behind.

Reading. The text scan takes the start of the version line as line end and
streams through an archive; plain archives are split between tasks, gzip ones
are read by a task each. A payload can hold the same text; such a record arrives
in pieces, which Content-Length shows. Pieces are put together by their byte
offsets (sums of lengths within a file), so reading is exact for any payload.
Offsets use narrow columns of the files concerned only.

Transactions are assembled by bringing the request, response and metadata records
together on the identifiers that concurrent-to names, by either side and through
other records: one nested row per capture, with all its requests and metadata
records. Links are followed on ids alone; then records meet in one shuffle.
Payloads travel only if the caller selects them.

Null html is an empty payload, a null url is empty. Rows that agree in id, url
and html are separate captures; of equal ids that tie for the response one is
chosen. Null ids count as smaller than any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfold.llm.common import settle

#: Payloads below this many bytes are always stored whole.
MIN_REVISIT = 1000
#: Records per archive file.
FILE_RECORDS = 100_000
DATE = "2026-01-01T00:00:00Z"

VERSION = "WARC/1.1\r\n"
#: What parts two records for the scan. No end of it is its beginning, as Hadoop's line
#: reader can pass over a delimiter whose first part repeats.
BOUNDARY = "WARC/1."
#: Largest table that is broadcast to keep payloads from being shuffled.
BROADCAST_ROWS = 100_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(*parts: Column) -> Column:
    """A record id in the form of a UUID, from the md5 of the parts."""
    digest = F.md5(F.to_json(F.struct(*parts)))
    cuts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` written and counted; with a broadcast hint if it has BROADCAST_ROWS or fewer (else joins shuffle)."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _identified(pages: DataFrame) -> DataFrame:
    """``pages`` with ``row_id``: equal rows are numbered, at the price of a shuffle of the payloads."""
    each = pages.groupBy("page_id", "url", "html").agg(F.count("*").alias("copies"))
    numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    each = each.select("page_id", "url", "html", numbers.alias("copy"))
    return each.withColumn("row_id", F.struct("page_id", "url", F.sha1(F.col("html").cast("binary")), "copy"))


def captures(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html) with digest, record id and what it revisits.

    A ``row_id`` column, if there is one, must tell all rows apart and be the
    same on each reading.
    """
    if "row_id" not in pages.columns:
        pages = _identified(pages.select("page_id", "url", "html"))
    each = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        _urn(F.lit("response"), F.col("row_id")).alias("record_id"),
    )
    each = each.withColumns({"bytes": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    order = F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", "record_id")
    long = each.where(F.col("bytes") >= MIN_REVISIT)
    first = long.groupBy("digest", "bytes").agg(F.max(order).alias("top"), F.count("*").alias("n")).where("n > 1")
    first = _small(first.select("digest", "bytes", F.col("top.record_id").alias("target")))
    joined = each.join(first, ["digest", "bytes"], "left")
    return joined.withColumn("is_revisit", F.col("target").isNotNull() & (F.col("target") != F.col("record_id")))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Headers, empty line and block; a header with a null value is left out."""
    rows = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit(VERSION), *(F.coalesce(r, F.lit("")) for r in rows), length, block)


def records(rows: DataFrame) -> DataFrame:
    """The three records of each capture as text, one row (``value``) per record."""
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    whose = lambda kind: _urn(F.lit(kind), F.col("record_id"))
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^\w+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("url", r"^\w+://([^/]*)", 1)
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", whose("request")),
            ("WARC-Concurrent-To", F.col("record_id")),
            *common,
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    answer = _record(
        [
            ("WARC-Type", F.when(F.col("is_revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("record_id")),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(F.col("is_revisit"), _PROFILE)),
            ("WARC-Refers-To", F.when(F.col("is_revisit"), F.col("target"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(F.col("is_revisit"), http).otherwise(F.concat(http, "html")),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", whose("metadata")),
            ("WARC-Concurrent-To", F.col("record_id")),
            *common,
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    return rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def write_warc(pages: DataFrame, path: str, file_records: int = FILE_RECORDS, compression: str = "gzip") -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives below ``path``."""
    out = records(captures(pages)).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records)
    out.option("compression", compression).text(path)


def _header(head: Column, name: str) -> Column:
    """First value of a header (its name in either case), null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:([^\r\n]*)", 1)), F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between record boundaries, its place, and the bytes that its headers announce."""
    text = spark.read.option("lineSep", BOUNDARY).text(path)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.octet_length("value").alias("size"),
        "value",
        # A record starts with the rest of its version line.
        F.when(F.substring("value", 1, 3).isin("1\r\n", "0\r\n"), F.substring("value", 4, 2**31 - 1)).otherwise(F.col("value")).alias("body"),
    )
    head = F.substring_index("body", "\r\n\r\n", 1)
    length = _header(head, "Content-Length").try_cast("bigint")
    return pieces.withColumns(
        {"head": head, "own": F.octet_length("body"), "need": F.octet_length(head) + F.lit(4) + length}
    )


def _members(place: DataFrame) -> DataFrame:
    """(file, split, at, start, lo): pieces of records that hold the boundary; ``lo`` is the record's offset.

    ``place`` has all pieces of the files that such records are in.
    """
    step = F.col("size") + F.lit(len(BOUNDARY))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    totals = place.groupBy("file", "split").agg(F.sum(step).alias("total"))
    base = F.coalesce(F.sum("total").over(earlier(W.partitionBy("file").orderBy("split"))), F.lit(0))
    inside = F.coalesce(F.sum(step).over(earlier(W.partitionBy("file", "split").orderBy("at"))), F.lit(0))
    placed = place.withColumn("inside", inside).join(totals.select("file", "split", base.alias("base")), ["file", "split"])
    placed = placed.withColumn("start", F.col("base") + F.col("inside") + F.col("size") - F.col("own"))
    # In file order, a record that runs past its piece covers what follows up to its end,
    # whatever the pieces below it look like (an empty piece can start right at the end).
    runs = placed.where("need > own").groupBy("file")
    runs = runs.agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("need")).alias("stop")))).alias("r"))
    covers = runs.select(
        "file",
        F.explode(
            F.aggregate(
                "r",
                F.slice("r", 1, 1),
                lambda done, x: F.when(x.start > F.element_at(done, -1).stop, F.concat(done, F.array(x))).otherwise(done),
            )
        ).alias("c"),
    )
    rows = placed.select("file", "start", "split", "at", F.lit(None).cast("struct<start:bigint,stop:bigint>").alias("c"))
    rows = rows.union(covers.select("file", F.col("c.start"), F.lit(None), F.lit(None), "c"))
    upto = W.partitionBy("file").orderBy("start", F.col("split").asc_nulls_first())
    last = F.last("c", ignorenulls=True).over(upto.rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("last", last).where("split is not null and start <= last.stop")
    return found.select("file", "split", "at", "start", F.col("last.start").alias("lo"))


def read_records(spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``extract`` of the (head, block) of every record: header lines and the bytes that Content-Length announces.

    ``extract`` is a projection; it runs in the scan, before anything is shuffled.
    """
    pieces = _pieces(spark, path)

    def taken(df: DataFrame) -> DataFrame:
        start = F.octet_length("head") + F.lit(5)
        block = F.substring(F.col("body").cast("binary"), start, (F.col("need") - start + 1).cast("int"))
        return extract(df.select("head", block.alias("block")))

    place = ["file", "split", "at"]
    whole = pieces.where("need <= own")
    files = _small(pieces.where("need > own").select("file").distinct())
    if files.isEmpty():
        return taken(whole)
    near = settle(pieces.select(*place, "size", "own", "need").join(files, "file", "left_semi"))
    members = _small(_members(near))
    apart = whole.join(members.select(*place), place, "left_anti")
    parts = pieces.join(members, place).groupBy("file", "lo")
    ordered = F.array_sort(F.collect_list(F.struct("start", "value", "body", "head", "need")))
    joined = parts.agg(ordered.alias("p")).select(
        F.col("p")[0].head.alias("head"),
        # Later pieces are content and stay as they are.
        F.concat_ws(BOUNDARY, F.col("p")[0].body, F.slice("p.value", 2, F.size("p"))).alias("body"),
        F.col("p")[0].need.alias("need"),
    )
    return taken(apart).union(taken(joined))


def _fields(records: DataFrame) -> DataFrame:
    """Header fields, payload and its measures of each record."""
    head, block = F.col("head"), F.col("block")
    http = F.substring_index(block.cast("string"), "\r\n\r\n", 1)
    payload = F.substring(block, F.octet_length(http) + F.lit(5), F.length(block))
    rows = records.select(
        _header(head, "WARC-Type").alias("type"),
        _header(head, "WARC-Record-ID").alias("id"),
        F.regexp_extract_all(head, F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*(\S+)"), 1).alias("concurrent"),
        _header(head, "WARC-Target-URI").alias("url"),
        F.regexp_replace(_header(head, "WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        _header(head, "WARC-Refers-To").alias("refers_to"),
        "block",
        payload.alias("payload"),
    ).where("type in ('response', 'revisit', 'request', 'metadata')")
    whole = F.col("type") == "response"
    return rows.select(
        "type", "id", "concurrent", "url", "digest", "refers_to",
        F.when(F.col("type").isin("request", "metadata"), F.col("block")).alias("block"),
        F.when(whole, F.col("payload")).alias("payload"),
        F.when(whole, F.length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).alias("payload_sha1"),
    )


def _captures_of(links: DataFrame) -> DataFrame:
    """(id, capture) of every request and metadata record that concurrent-to links lead to a response or revisit.

    ``links`` has (id, answer, concurrent) of all records. A link counts from either
    side; it may lead through other requests and metadata records, not through
    another response. Rounds end when one finds nothing new.
    """
    answers = links.where("answer").select("id").distinct()
    named = links.select("id", F.explode("concurrent").alias("other"))
    edges = named.union(named.select("other", "id")).distinct().join(answers, "id", "left_anti")
    edges = settle(edges.select(F.col("id").alias("from"), "other"))
    reached = new = answers.select("id", F.col("id").alias("capture"))
    while True:
        step = edges.join(new, edges["other"] == new["id"]).select(F.col("from").alias("id"), "capture").distinct()
        new = settle(step.join(reached, ["id", "capture"], "left_anti"))
        if new.isEmpty():
            return reached
        reached = settle(reached.union(new))


def transactions(spark: SparkSession, path: str, direct: bool = False) -> DataFrame:
    """One nested row per capture: ``response``, ``payload``, ``requests`` and ``metadata``.

    ``response`` has id, type (response or revisit), url, digest (as announced),
    refers_to, payload_bytes and payload_sha1 (of the payload read; a revisit has
    none of its own). ``requests`` and ``metadata`` are arrays of (id, block) by id,
    each record once. Records that no link leads to a response are left out.
    ``direct`` says that every request and metadata record names its response
    itself, as ``write_warc`` has it, which spares the pass over the links.
    """
    found = read_records(spark, path, _fields)
    answer = F.col("type").isin("response", "revisit")
    if direct:
        keys = F.when(answer, F.array("id")).otherwise(F.col("concurrent"))
        keyed = found.select(F.explode(keys).alias("capture"), "*")
    else:
        links = read_records(spark, path, lambda df: _fields(df).select("id", answer.alias("answer"), "concurrent"))
        keyed = found.join(_captures_of(settle(links)), "id")
    fields = ["id", "type", "url", "digest", "refers_to", "payload_bytes", "payload_sha1"]

    def others(kind: str) -> Column:
        own = F.collect_set(F.when(F.col("type") == kind, F.struct("id", "block")))
        return F.array_sort(own).alias(kind)

    grouped = keyed.groupBy("capture").agg(
        F.min(F.when(answer, F.struct(*fields))).alias("response"),
        F.first("payload", ignorenulls=True).alias("payload"),
        others("request").alias("requests"),
        others("metadata"),
    )
    return grouped.where("response is not null").select("response", "payload", "requests", "metadata")


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to, all from the archives.

    The archives are those of ``write_warc``. A revisit takes size and digest from
    the response it refers to.
    """
    fields = F.col("metadata")[0].block.cast("string")
    rows = transactions(spark, path, direct=True).select(
        F.regexp_extract(fields, r"(?m)^page_id: (-?\d+)", 1).try_cast("bigint").alias("page_id"),
        F.col("response.id").alias("id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
        F.col("response.payload_bytes").alias("bytes"),
        F.col("response.payload_sha1").alias("sha1"),
    )
    rows = settle(rows)
    again = rows.where("target is not null").select(F.col("target").alias("id")).distinct()
    whole = _small(
        rows.join(again, "id", "left_semi").select(
            F.col("id").alias("target"),
            F.col("page_id").alias("to_page"),
            F.col("bytes").alias("to_bytes"),
            F.col("sha1").alias("to_sha1"),
        )
    )
    return rows.join(whole, "target", "left").select(
        "page_id",
        F.coalesce("bytes", "to_bytes").alias("payload_bytes"),
        F.coalesce("sha1", "to_sha1").alias("payload_digest"),
        "record_type",
        F.col("to_page").alias("refers_to"),
    )
