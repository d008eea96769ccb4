"""Writing and reading WARC archives with Spark's own text source and sink (operator 9).

Records are strings that end in the two line breaks WARC asks for, so the text sink writes archives from all tasks at once.
The reader splits archives at the record magic, which Spark does for any byte range of a large file. Magic inside a payload
splits there too: every piece is only a candidate, with its offset and the offset of its successor by the length it
declares. Pointer jumping from each file's start keeps the candidates that the chain of lengths reaches; all else is payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, own_names, own_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Payloads shorter than this are never revisits.
MIN_REVISIT = 1000
#: Rows of one archive file, which bounds its length.
FILE_ROWS = 50_000
#: Repeated payloads (a digest and a number each) that are sent to every task rather than shuffled with the pages.
BROADCAST_ROWS = 100_000
_DATE = "2020-01-01T00:00:00Z"


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses) for each row of pages.

    Of the rows with one payload of min_revisit bytes or more, that with the largest page_id is the response. Nulls: a null
    html is an empty payload, a null url an empty one; rows with a null page_id, or with the response's own page_id again,
    are responses. page_id may be of any type that a string can be cast to and that has a largest value. Only payloads that repeat are joined back, so a page copied everywhere is one row on that side.
    """
    own_names(pages, page_id, url, html)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    p = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    again = p.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _last IS NOT NULL").drop("_n")
    again = cut(again)
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    p = p.join(again, ["payload_digest", "payload_bytes"], "left")
    return p.withColumn("refers_to", F.when(F.col("page_id") != F.col("_last"), F.col("_last"))).drop("_last")


def records(planned: DataFrame) -> DataFrame:
    """One column, value: the records without their two closing line breaks."""
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    # An id is escaped, so that it can hold anything; a null one has a name that no other has.
    rid = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:nopage>"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return planned.select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", rid(F.col("page_id"))),
            line("WARC-Date", F.lit(_DATE)),
            line("WARC-Target-URI", clean),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", rid(F.col("refers_to"))))).otherwise(F.lit("")),
            line("Content-Type", F.lit("text/html")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write(pages: DataFrame, path: str, **how) -> None:
    """The archives of pages, as files under path, written by all tasks."""
    records(plan_records(pages, **how)).write.option("lineSep", END).option("maxRecordsPerFile", FILE_ROWS).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the byte range), _i (order in the range), _n (bytes) and piece (what stands between two magics)."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_i"), F.octet_length("value").cast("long").alias("_n"), F.col("value").alias("piece"))


def candidates(pieces: DataFrame) -> DataFrame:
    """file, block, _i, off, succ, _head, _len for each place where the magic stands: its offset and its successor's by the length it declares.

    Lengths are summed inside each byte range and over the ranges of a file, so no task reads a whole file. succ is null
    where no length is declared. Bytes before a file's first magic have a negative offset.
    """
    head = F.substring_index("piece", END, 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1)
    thin = pieces.select("file", "block", "_i", "_n", F.when(F.instr("piece", END) > 0, F.nullif(length, F.lit("")).cast("long")).alias("_len"), (F.octet_length(head) + len(END)).cast("long").alias("_head"))
    whole = F.col("_n") + len(MAGIC)
    base = thin.groupBy("file", "block").agg(F.sum(whole).alias("_t"))
    base = base.select("file", "block", (F.sum("_t").over(Window.partitionBy("file").orderBy("block")) - F.col("_t")).alias("_base"))
    inside = F.sum(whole).over(Window.partitionBy("file", "block").orderBy("_i")) - whole
    at = thin.withColumn("_in", inside).join(base, ["file", "block"]).withColumn("off", F.col("_base") + F.col("_in") - len(MAGIC))
    return at.withColumn("succ", F.col("off") + len(MAGIC) + F.col("_head") + F.col("_len") + len(END)).drop("_in", "_base")


def reachable(links: DataFrame) -> DataFrame:
    """The rows of links (file, off, succ) that the chain from each file's offset 0 reaches, with their columns.

    Candidates whose successor is the next candidate form runs, and a chain that enters a run follows it to its end; so a
    jump leads from any candidate to what follows its run. Pointer jumping doubles the jumps each round until no new entry
    is found: about log2 of a file's runs, which are one more than its places where payload looks like a record.
    """
    order = Window.partitionBy("file").orderBy("off")
    runs = links.filter("off >= 0").withColumn("_new", F.when(F.lag("succ").over(order) == F.col("off"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("_new").over(order)).drop("_new")
    runs = cut(runs.withColumn("exit", F.last("succ").over(Window.partitionBy("file", "run").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    at = runs.select("file", "off")
    jump = runs.filter("exit > off").select("file", "off", F.col("exit").alias("to")).join(at.withColumnRenamed("off", "to"), ["file", "to"], "left_semi").select("file", "off", "to")
    jump = cut(jump)
    seen = cut(at.filter("off = 0"))
    n = seen.count()
    while n and not jump.isEmpty():
        seen = cut(seen.unionByName(seen.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))).distinct())
        more = seen.count()
        if more == n:
            break
        n = more
        jump = cut(jump.join(jump.select("file", F.col("off").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "off", F.col("far").alias("to")))
    entries = seen.join(runs.select("file", "off", "run"), ["file", "off"]).groupBy("file", "run").agg(F.min("off").alias("entry"))
    return runs.join(entries, ["file", "run"]).filter("off >= entry").drop("run", "exit", "entry")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records under path: record_type, record_id, url, refers_to_id, digest (strings; null if absent) and payload.

    If every candidate of all files is a record and ends where the next begins, as checked, the pieces are the records.
    Otherwise the pieces are kept with their places, payload that looks like records is left out, and a record whose
    payload holds the magic is put together again. A file that doesn't begin with a record gives none; a record cut short,
    or whose length is missing or wrong, ends its file's chain, and the records before it are given.
    """
    pieces = _pieces(spark, path)
    placed = cut(candidates(pieces))
    good = cut(reachable(placed))
    alone = "succ = off + _n + %d" % len(MAGIC)
    plain = good.filter(alone).count() == placed.filter("off >= 0 OR _n > 0").count()
    if plain:
        rec = pieces.filter("piece != ''").withColumns(_measures())
    else:
        pieces = cut(pieces)
        placed = cut(candidates(pieces))
        good = cut(reachable(placed)).select("file", "off", F.struct("off", "succ", "_head", "_len").alias("_own"))
        # Every piece belongs to the last record that starts at or before it.
        w = Window.partitionBy("file").orderBy("off")
        owned = placed.filter("off >= 0").join(good, ["file", "off"], "left").withColumn("_own", F.last("_own", ignorenulls=True).over(w))
        owned = owned.filter("_own IS NOT NULL AND off < _own.succ").select("file", "block", "_i", "off", "_own")
        parts = pieces.select("file", "block", "_i", "piece").join(owned, ["file", "block", "_i"])
        glue = MAGIC.replace("\r\n", "\\r\\n")
        rec = parts.groupBy("file", "_own").agg(F.expr(f"array_join(transform(sort_array(collect_list(struct(off, piece))), x -> x.piece), '{glue}')").alias("piece")).select("piece", "_own._head", "_own._len")
    field = lambda name: F.nullif(F.regexp_extract(F.substring_index("piece", END, 1), rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))
    body = F.expr("cast(substring(cast(piece as binary), cast(_head + 1 as int), cast(_len as int)) as string)")
    out = rec.select(field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("url"), field("WARC-Refers-To").alias("refers_to_id"), field("WARC-Payload-Digest").alias("digest"), body.alias("payload"), "_len")
    return out.filter(F.octet_length("payload") == F.col("_len")).drop("_len")


def _measures() -> dict:
    head = F.substring_index("piece", END, 1)
    return {"_head": (F.octet_length(head) + len(END)).cast("long"), "_len": F.col("_n") - F.octet_length(head) - 2 * len(END)}


def archived(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Pages written as archives under path (by default a new folder in the shared one) and read back, see ``read``."""
    spark = pages.sparkSession
    path = path or own_path(spark, "warc")
    write(pages, path, **how)
    return read(spark, path)


def payloads(rec: DataFrame, id_type: str = "bigint") -> DataFrame:
    """For each record of ``read``: page_id, record_type, refers_to (page_ids, of id_type), payload_bytes and payload_digest (bare hex SHA-1) of the full payload.

    Ids that are none of id_type are an error; "string" takes all.

    A revisit takes them from the response that has both the record id and the digest it names, so responses that share a
    record id don't mix. A revisit whose response is missing keeps the digest it names, and its payload_bytes is null.
    """
    number = lambda c: F.when(F.col(c).rlike("^<urn:page:.*>$"), F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1))).cast(id_type)
    named = F.regexp_replace(F.lower("digest"), "^sha1:", "")
    rec = rec.select(number("record_id").alias("page_id"), "record_type", number("refers_to_id").alias("refers_to"), F.octet_length("payload").cast("long").alias("_bytes"), F.sha1("payload").alias("_sha"), named.alias("_named"))
    full = rec.filter("refers_to IS NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("_sha").alias("_named")).agg(F.max("_bytes").alias("_full"))
    alone, again = rec.filter("refers_to IS NULL"), rec.filter("refers_to IS NOT NULL").join(full, ["refers_to", "_named"], "left")
    cols = lambda b, s: ["page_id", F.col(b).alias("payload_bytes"), F.col(s).alias("payload_digest"), "record_type", "refers_to"]
    return alone.select(*cols("_bytes", "_sha")).unionByName(again.select(*cols("_full", "_named")))


def op9_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return payloads(archived(pages))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
QUERIES = {"op9_warc": op9_warc}
SQL = {"op9_warc": OP9_SQL}
