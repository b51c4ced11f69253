"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records put together by joins.

An archive is a folder of two tables. `records` has a row for each record: its headers as they stand in a WARC file, byte for byte, and the
digest of its payload. `payloads` has each distinct payload once, under its SHA-256. Whoever reads an archive works the digest out
again from the bytes; bytes that don't match stop the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm.common import spread_join, stored

#: Payloads of at least this many bytes are answered once; later records revisit it.
LEAST = 1000
#: Fixed values of the format.
_VERSION, _GAP = "WARC/1.1", "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_CONTROLS = (0, 9, 10, 11, 12, 13)


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def _line(name: str, value: Column) -> Column:
    """A header line, null for a null value. Line ends, tabs and zeros in a value are written as %XX, so that none can end the line."""
    safe = value.cast("string")
    for code in _CONTROLS:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.concat(F.lit(f"{name}: "), safe, F.lit(_GAP))


def _id(key: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _headers(date: str) -> Column:
    """The exact bytes before a record's payload: WARC headers, then those of the answer."""
    revisit = F.col("refers_row").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_GAP}"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("n")), F.lit(_GAP))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    lines = [
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _id(F.col("key"), F.col("row"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Refers-To", F.when(revisit, _id(F.col("refers_key"), F.col("refers_row")))),
        _line("WARC-Profile", F.when(revisit, F.lit(_REVISIT))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length),
    ]
    return F.concat(F.lit(f"{_VERSION}{_GAP}"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit(_GAP), http).cast("binary")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """An archive of a record for each row.

    Of rows with equal payloads of at least `least` bytes, the one of the largest key is a response and the others revisit it; smaller ones are
    responses each. Of repeated rows one counts as the largest; a null key is the smallest, its number written as nothing. A null html is an
    empty payload, a null url has no address line; other columns aren't kept. An empty table makes an empty archive. Only digests are
    grouped and joined by rows, hot ones dealt to several tasks; a payload is sent once for each task that meets it.
    """
    bytes_ = payload(F.col(f"`{html}`"))
    seen = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.sha2(bytes_, 256).alias("digest"), F.sha1(bytes_).alias("sha1"), F.octet_length(bytes_).cast("long").alias("n"))
    rows = stored(seen.withColumn("row", F.monotonically_increasing_id()), "captures")
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max(F.struct("key", "row")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = stored(first.select("digest", F.col("first.key").alias("first_key"), F.col("first.row").alias("first_row")), "firsts")
    again = spread_join(rows, first, "digest").where(F.col("row") != F.col("first_row")).select("row", F.col("first_key").alias("refers_key"), F.col("first_row").alias("refers_row"))
    records = rows.join(again, "row", "left")
    records.select("key", "row", "digest", _headers(date).alias("headers")).write.option("compression", "zstd").parquet(f"{path}/records")
    # SHA-256, SHA-1 and length together name a payload: equal names with other bytes would need a collision of both at once
    by = [F.sha2("bytes", 256).alias("digest"), F.sha1("bytes").alias("sha1"), F.octet_length("bytes").cast("long").alias("n")]
    distinct = pages.select(bytes_.alias("bytes")).groupBy(*by).agg(F.any_value("bytes").alias("payload"))
    distinct.write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of an archive, verified: bytes whose digest isn't theirs stop the job."""
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest")))
    table = spark.read.parquet(f"{path}/payloads")
    return table.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


def _header(name: str) -> Column:
    """Value of a WARC header line, null without one."""
    warc = F.substring_index(F.col("headers").cast("string"), _END, 1)
    return F.nullif(F.regexp_extract(warc, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def _named(value: Column, at: int, kind: str) -> Column:
    return F.nullif(F.regexp_extract(value, r"^<urn:record:(.*):(\d+)>$", at), F.lit("")).cast(kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, from its headers and its verified payload: key, url, payload_bytes, payload_digest (hex SHA-1), record_type,
    refers_to (key of the response that a revisit refers to). Measures are taken of the bytes, each payload once, before records meet them."""
    kind = spark.read.parquet(f"{path}/records").schema["key"].dataType.simpleString()
    bytes_ = payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    found = spread_join(spark.read.parquet(f"{path}/records").select("digest", "headers"), bytes_, "digest")
    said, true = _header("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), F.col("payload_digest"))
    wrong = F.raise_error(F.concat(F.lit("headers name another payload than "), F.col("digest")))
    return found.select(
        _named(_header("WARC-Record-ID"), 1, kind).alias("key"), _header("WARC-Target-URI").alias("url"), "payload_bytes", F.when(said == true, F.col("payload_digest")).otherwise(wrong.cast("string")).alias("payload_digest"),
        _header("WARC-Type").alias("record_type"), _named(_header("WARC-Refers-To"), 1, kind).alias("refers_to"),
    )


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(key, row, record, payload): each record's exact bytes, headers and all, and its whole payload; a revisit has no payload in its record, but
    the payload is given all the same."""
    found = spread_join(spark.read.parquet(f"{path}/records"), payloads(spark, path), "digest")
    revisit = _header("WARC-Type") == "revisit"
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return found.select("key", "row", F.concat("headers", body, F.lit(_END).cast("binary")).alias("record"), "payload")


def export(spark: SparkSession, path: str, to: str) -> None:
    """The archive as compressed WARC files, one for each task. Payloads are UTF-8, so a record can be written as text: its own last line end closes the row."""
    whole = F.decode("record", "UTF-8")
    restore(spark, path).select(F.substr(whole, F.lit(1), F.length(whole) - 1).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(to)


def oracle(least: int = LEAST) -> str:
    """DuckDB SQL of read()'s digest over `pages`."""
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, row_number() OVER (PARTITION BY b ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY b) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= {least} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k > 1 AND payload_bytes >= {least} THEN largest END AS refers_to FROM d"""
