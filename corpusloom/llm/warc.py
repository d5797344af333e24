"""WARC archives of captured pages: written as request, response and metadata records, read back as one nested row per capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize

VERSION = "WARC/1.1\r\n"
#: Two line ends close a record, so this stands between two records and splits a file where it is read.
BETWEEN = "\r\n\r\n" + VERSION
#: Records of one file, so that no file grows without bound.
FILE_RECORDS = 100_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What ``conv`` writes for the same 32 values.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits at a time from the hexadecimal digits to digits of base 32, then to the letters of the alphabet."""
    digest = F.sha1(payload)
    forty_bits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*forty_bits), DIGITS, ALPHABET)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] * (a > 1) + [F.substring(h, a, n)])), F.lit(">"))


def _record(kind: Column, record_id: Column, url: Column, more: Column, content: str | Column, block: Column) -> Column:
    content = F.lit(content) if isinstance(content, str) else content
    return F.concat(
        F.lit("WARC-Type: "), kind, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), record_id, F.lit("\r\nWARC-Target-URI: "), url, more,
        F.lit("\r\nContent-Type: "), content, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write three records for each page below ``path``, as gzip files.

    A payload is the page in UTF-8; a null page is empty. Of pages with equal payloads of at least ``least`` bytes the one with
    the largest id is a response, those with smaller ids are revisits that refer to it. A null id never refers. A payload that holds
    the border of two records, or makes one with the line ends around it, goes in base64, named in its HTTP header, so every border in
    a file is a real one. Repeated rows are captures each; an empty table gives an empty archive; other columns do not matter.
    Line ends in an address become spaces; a null address is empty.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    captured = pages.select(
        F.col(page).alias("page"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\r\n]", " ").alias("url"), text.alias("payload"),
        base32_sha1(text).alias("digest"), F.octet_length(text).alias("bytes"))
    again = captured.where(f"bytes >= {least}").groupBy("digest").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = captured.join(again, "digest", "left")
    revisit = F.coalesce(F.col("page") < F.col("keeper"), F.lit(False)) & (F.col("bytes") >= least)
    own = _urn(F.lit("capture"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("digest"))
    # In the file two line ends stand before and behind the payload: its begin or end alone may make a border with them.
    whole = F.col("payload")
    border = (
        F.contains(whole, F.lit(BETWEEN)) | F.startswith(whole, F.lit(VERSION)) | F.startswith(whole, F.lit("\r\n" + VERSION))
        | F.endswith(whole, F.lit(BETWEEN[:-2])) | whole.isin(VERSION[:-2], "\r\n" + VERSION[:-2]))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"),
        F.when(border, F.lit("\r\nContent-Transfer-Encoding: base64")).otherwise(F.lit("")), F.lit("\r\n\r\n"))
    body = F.when(F.col("revisit"), F.lit("")).when(border, F.base64(F.col("payload").cast("binary"))).otherwise(F.col("payload"))
    address = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 1), F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    asked = F.concat(F.lit("GET "), F.when(address[1] == "", F.lit("/")).otherwise(address[1]), F.lit(" HTTP/1.1\r\nHost: "), address[0], F.lit("\r\n\r\n"))
    facts = F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("\r\n"))
    refers = F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.lit("capture"), F.col("keeper"), F.col("digest")))).otherwise(F.lit(""))
    shared = known.withColumn("revisit", revisit).withColumn("own", own)
    beside = F.concat(F.lit("\r\nWARC-Concurrent-To: "), F.col("own"))
    records = shared.select(F.array(
        _record(F.lit("request"), _urn(F.lit("request"), F.col("own")), F.col("url"), beside, "application/http; msgtype=request", asked),
        _record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.col("own"), F.col("url"),
                F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), refers), "application/http; msgtype=response", F.concat(http, body)),
        _record(F.lit("metadata"), _urn(F.lit("metadata"), F.col("own")), F.col("url"), beside, "application/warc-fields", facts),
    ).alias("three")).select(F.explode("three").alias("value"))
    records.select(F.concat(F.lit(VERSION), "value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _field(name: str, header: str = "header") -> Column:
    value = F.regexp_extract(header, f"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.get(F.array_remove(F.array(value), ""), 0)  # null for an empty one; the header is searched once


def read(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, url, date, concurrent_to, refers_to, digest, content_type, complete, block): the records below ``path``.

    Files are split at the border of two records while they stream, so a record is the most that is held. ``complete`` tells whether
    a block has the length its header gives: a foreign archive with a border inside a payload shows up there.
    """
    lines = spark.read.option("lineSep", BETWEEN).text(path)
    value = F.when(F.startswith(F.col("value"), F.lit(VERSION)), F.substring(F.col("value").cast("binary"), len(VERSION) + 1, 2**31 - 1)).otherwise(F.col("value").cast("binary"))
    raw = lines.select(value.alias("raw")).withColumn("header", F.substring_index(F.col("raw").cast("string"), "\r\n\r\n", 1))
    sized = raw.withColumn("size", F.coalesce(_field("Content-Length").cast("int"), F.lit(0)))
    block = F.substring(F.col("raw"), F.octet_length("header") + 5, F.col("size"))
    return sized.withColumn("block", block).select(
        F.lower(_field("WARC-Type")).alias("type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Date").alias("date"),
        _field("WARC-Concurrent-To").alias("concurrent_to"), _field("WARC-Refers-To").alias("refers_to"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        _field("Content-Type").alias("content_type"), (F.octet_length("raw") >= F.octet_length("header") + 4 + F.col("size")).alias("complete"), "block",
    ).where("type IS NOT NULL")


def captures(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per response or revisit record: (record_id, url, type, refers_to, response, request, metadata).

    ``response`` has the HTTP header, the payload, its bytes and digest; a revisit's payload is null, its bytes and digest are those
    that its headers give. ``request`` and ``metadata`` are the records whose concurrent-to identifier is the response's (or that the
    response names as concurrent); of several, the one with the smallest id. They are summed up per identifier before the join, so
    repeated records never multiply. A capture without them has nulls there; a request without a capture is left out.
    A record shorter than its header says is left out. Without ``payload`` the payloads are measured and digested where they are read, and do not move with the joins.
    """
    records = records.where("complete")
    main = F.col("type").isin("response", "revisit")
    http = F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)
    body = F.substring(F.col("block"), F.octet_length("http") + 5, 2**31 - 1)
    answers = records.where(main).withColumn("http", http).withColumn("sent", body)
    answers = answers.withColumn("payload", F.when(_field("Content-Transfer-Encoding", "http") == "base64", F.unbase64(F.col("sent").cast("string"))).otherwise(F.col("sent")))
    fresh = F.col("type") == "response"
    response = F.struct(
        "http", *([F.when(fresh, F.col("payload")).alias("payload")] if payload else []),
        F.when(fresh, F.octet_length("payload")).otherwise(_field("Content-Length", "http").cast("int")).cast("long").alias("payload_bytes"),
        F.coalesce(base32_sha1(F.when(fresh, F.col("payload"))), "digest").alias("payload_digest"))  # not in a branch, where every use would hash anew
    head = answers.select("record_id", "url", "type", "refers_to", "concurrent_to", response.alias("response"))
    other = F.struct("record_id", "content_type", F.col("block").cast("string").alias("block"))
    beside = records.where(F.col("type").isin("request", "metadata")).select(
        F.explode(F.array_compact(F.array("concurrent_to", "record_id"))).alias("named"), "type", other.alias("r"))
    summed = beside.groupBy("named").agg(F.min(F.when(F.col("type") == "request", F.col("r"))).alias("request"), F.min(F.when(F.col("type") == "metadata", F.col("r"))).alias("metadata"))
    direct = head.join(summed.withColumnRenamed("named", "record_id"), "record_id", "left").withColumn("named", F.coalesce("concurrent_to", "record_id"))
    back = summed.select("named", F.col("request").alias("request2"), F.col("metadata").alias("metadata2"))
    return direct.join(back, "named", "left").select(
        "record_id", "url", "type", "refers_to", "response", F.coalesce("request", "request2").alias("request"), F.coalesce("metadata", "metadata2").alias("metadata"))


def page_facts(captured: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): page ids come from the metadata records, and ``refers_to`` is the response's."""
    facts = captured.select(
        _field("page-id", "metadata.block").cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("type").alias("record_type"), "record_id", F.col("refers_to").alias("target"))
    facts = materialize(facts, "captures")
    kept = facts.where("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.max("page_id").alias("refers_to"))
    revisits = facts.where("record_type = 'revisit'").join(kept, "target", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return facts.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(revisits.select(*names))
