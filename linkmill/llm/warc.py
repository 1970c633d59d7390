"""A content-addressed archive of WARC records."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
MIN_REVISIT_BYTES = 100


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None) -> None:
    """Archive at path: `payloads` (digest, payload), each payload once, and `headers` (digest, header).

    Each row becomes one WARC/1.1 record. Its header is kept byte for byte; its payload, the UTF-8
    bytes (none for null), lies under its SHA-256. Of the records with equal payloads of at least 100
    bytes, that with the smallest key is a response and the others are revisits that refer to it;
    smaller payloads are all responses. Rows that repeat both key and payload of a response are responses
    too. Null keys sort last (of records that share a payload, one without a key revisits the smallest key that there
    is) and are written as empty; null urls as empty. A header's lines end at CR LF, so
    these two characters of a url are written as %0D and %0A. date is the records' WARC-Date, by default now.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.select("id", "url", "body", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("size"))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("f_id"))
    # The payload travels once for each digest: a bounded count of rows survives the partial step.
    stored = rows.groupBy("digest").agg(F.first("body").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    back = pages.sparkSession.read.parquet(f"{path}/payloads")
    bad = back.where(F.sha2("payload", 256) != F.col("digest")).limit(1).count()
    if bad:
        raise OSError(f"a payload in {path} does not have its digest")
    thin = rows.select("id", "url", "digest", "size")
    head = thin.join(firsts.withColumnRenamed("digest", "f_digest"), F.col("digest") == F.col("f_digest")).drop("f_digest")
    revisit = (F.col("size") >= MIN_REVISIT_BYTES) & ~F.col("id").eqNullSafe(F.col("f_id"))
    head.select("digest", header(revisit, date).alias("header")).write.parquet(f"{path}/headers")


def header(revisit: Column, date: str) -> Column:
    """The text of a record's header, from the columns id, url, digest, size and f_id."""
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri("id")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", uri("f_id")),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
            )
        ).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))), F.lit(CRLF),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records again: digest, header, and payload, by a join on the digest; a revisit has no payload of its own.

    A payload belongs to one response, and payloads under MIN_REVISIT_BYTES, of which there may be many, are
    small; so no key gathers large rows. A response without its payload fails the run, as the archive is damaged."""
    heads, bodies = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    answers = heads.where(_is_response()).join(bodies, "digest", "left")
    found = F.when(F.col("payload").isNull(), F.raise_error(F.lit("payload missing"))).otherwise(F.col("payload"))
    revisits = heads.where(~_is_response()).select("digest", "header", F.lit(None).cast("binary").alias("payload"))
    return answers.select("digest", "header", found.alias("payload")).unionByName(revisits)


def _is_response() -> Column:
    return F.col("header").startswith(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}")


def records(archive: DataFrame) -> DataFrame:
    """The exact bytes of each record: header, payload (none for a revisit), two line ends."""
    return archive.select("digest", F.concat(F.encode("header", "UTF-8"), F.coalesce("payload", F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"))


def parsed(written_records: DataFrame) -> DataFrame:
    """Per record (as of records()): page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are taken from the bytes of the record; those of a revisit from the response with the
    digest that the revisit names."""
    text = F.decode("record", "ISO-8859-1")  # a character for each byte
    rows = written_records.select("record", F.substring_index(text, CRLF + CRLF, 1).alias("h"))
    field = lambda name: F.regexp_extract("h", rf"\r\n{name}: ([^\r]*)", 1)
    num = lambda name: F.expr(f"try_cast(nullif({name}, '') as bigint)")
    page = r"<urn:page:(-?\d*)>"
    rows = rows.select(
        F.regexp_extract("h", rf"\r\nWARC-Record-ID: {page}", 1).alias("rid"), F.regexp_extract("h", rf"\r\nWARC-Refers-To: {page}", 1).alias("ref"),
        field("WARC-Type").alias("record_type"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("named"),
        F.expr("substring(record, length(h) + 5, octet_length(record) - length(h) - 8)").alias("body"),
    )
    rows = rows.select(
        num("rid").alias("page_id"), num("ref").alias("refers_to"), "record_type", "named",
        F.length("body").cast("long").alias("payload_bytes"), F.sha2("body", 256).alias("payload_digest")
    )
    answers = rows.where("record_type = 'response'")
    first = answers.groupBy(F.col("payload_digest").alias("named")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, "named", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return answers.select(*columns).unionByName(
        again.withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("named"))).select(*columns)
    )
