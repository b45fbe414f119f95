"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256; the exact header of every record is kept apart
with that digest. Records are rebuilt by joining the two, and what is read of them is read from the rebuilt bytes, which
must have the digests they are known by. Rows with equal payloads after the first
(smallest page_id) become revisit records, which point at it and carry no block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestframe.llm.common import new_path, read

#: Headers of a payload with more than so many copies are dealt over so many keys when they meet it; the most frequent such payloads are told to all tasks.
COPIES, SALTS, HOT = 1_000, 16, 1_000
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits are 4 base-32 digits, renamed to A-Z2-7."""
    hex_digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def met(many: DataFrame, one: DataFrame, counts: DataFrame, how: str = "inner", copies: int = COPIES, salts: int = SALTS) -> DataFrame:
    """``many`` rows beside the one of their digest. Digests of which there are more than ``copies`` (``counts``: digest, n), HOT of them at most, are salted; Spark
    splits what else is uneven."""
    hot = F.broadcast(counts.filter(F.col("n") > copies).orderBy(F.desc("n"), "digest").limit(HOT).select("digest", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    dealt = many.join(hot, "digest", "left").withColumn("salt", salt).drop("hot")
    spread = one.join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), F.lit(salts - 1)).otherwise(F.lit(0))))).drop("hot")
    return dealt.join(spread, ["digest", "salt"], how).drop("salt")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", copies: int = COPIES) -> None:
    """Writes ``path``/payloads (digest, payload) and ``path``/headers (header, digest) from page_id, url, html.

    A null html is an empty payload, a null url gives no WARC-Target-URI line, line ends within a url
    are percent-encoded. Payloads under ``min_bytes`` bytes are always responses. A null page_id is written as
    ``null`` and is a response only if all equal payloads have null ids. Rows that repeat a smallest page_id are all
    responses; their payload is still stored once. An empty table gives an empty archive. Other
    columns are not looked at.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    ident = pages.select("page_id", "url", payload.alias("payload")).select("*", F.unhex(F.sha2("payload", 256)).alias("digest"))
    # Equal digests have equal bytes, so any one will do; map-side, each task passes a payload on once.
    ident.dropDuplicates(["digest"]).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    narrow = ident.select("page_id", "url", "digest", F.length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    known = met(narrow, first.drop("n"), first.select("digest", "n"), copies=copies)
    revisit = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    )
    known.select(header.alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def field(name: str) -> Column:
    """A header line's value, null if there is no such line."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _heads(spark: SparkSession, path: str) -> DataFrame:
    page = lambda value: F.regexp_extract(value, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    named = {"url": field("WARC-Target-URI"), "record_type": field("WARC-Type"), "refers_to": page(field("WARC-Refers-To")), "named": field("WARC-Payload-Digest"), "content_length": field("Content-Length").cast("int")}
    return spark.read.parquet(f"{path}/headers").select("header", "digest", page(field("WARC-Record-ID")).alias("page_id"), *[c.alias(n) for n, c in named.items()])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records, byte for byte, each from its header and, of responses, the stored payload: page_id, record (header, block and the two line ends), and
    the header's fields."""
    heads = _heads(spark, path)
    is_response = F.col("record_type") == "response"
    whole = heads.filter(is_response).join(spark.read.parquet(f"{path}/payloads"), "digest")
    empty = heads.filter(~is_response).withColumn("payload", F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.lit(b"\r\n\r\n"))
    return whole.unionByName(empty).select("page_id", record.alias("record"), *[c for c in heads.columns if c != "page_id"])


def read_archive(spark: SparkSession, path: str, copies: int = COPIES) -> DataFrame:
    """One row a record: header, page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    Length and SHA-1 are those of the block in the rebuilt record of the response, for revisits of the one that they refer to. A block that hasn't the SHA-256 it is kept under, or
    not the SHA-1 that a header names, ends the job with an error.
    """
    block = F.substring(F.col("record"), F.octet_length("header") + 1, F.col("content_length"))
    responses = read_records(spark, path).filter("record_type = 'response'").withColumn("block", block)
    sha1 = base32_sha1(F.col("block"))
    sound = (F.unhex(F.sha2("block", 256)) == F.col("digest")) & (F.col("named") == F.concat(F.lit("sha1:"), sha1))
    failed = F.raise_error(F.concat(F.lit("A payload of the archive is not the one it is kept as: "), F.hex("digest"))).cast("string")
    read = responses.select("header", "digest", "page_id", "url", "record_type", "refers_to", F.octet_length("block").cast("long").alias("payload_bytes"), F.when(F.coalesce(sound, F.lit(False)), sha1).otherwise(failed).alias("payload_digest"))
    heads = _heads(spark, path).filter("record_type = 'revisit'")
    known = read.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    both = met(heads, known, heads.groupBy("digest").agg(F.count("*").alias("n")), "left", copies)
    agrees = F.col("named") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    revisits = both.withColumn("payload_digest", F.when(F.coalesce(agrees, F.lit(False)), F.col("payload_digest")).otherwise(failed))
    columns = ("header", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return read.select(*columns).unionByName(revisits.select(*columns))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written as records and read from the records that are rebuilt; ``verified`` is true, as a record that isn't would have ended the job."""
    path = new_path(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.lit(True).alias("verified"))
