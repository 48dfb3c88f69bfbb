"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: one text file a partition, each row a record; the record separator of the format
closes each line of Spark's text sink, so archives come from its commit protocol.

Reading: tasks split the archives at the version line, wherever it stands, also inside
payloads. Each piece is a candidate record; its header's length tells where its successor
must begin. Offsets are prefix sums of the pieces' lengths, over blocks and inside them. They
alone name a record: where a scan cuts the archives may differ from one reading to the next.
Starting at each file's beginning, pointer jumping (the marked records' jumps are marked, then
all jumps are doubled) reaches exactly the records of the chain, in as many rounds as the
logarithm of the longest file's records. Candidates never reached are payload, and are put
back into the record they were cut from.

Names in headers are read in any case, and any version 1 line opens a record. A chain that
ends before its file does is an error that names the file: nothing is dropped in silence.

Defined results: null html is an empty payload; null urls become ``about:blank``; line breaks
in urls are dropped, and urls have any length; null ids are written and read as null, and are
smaller than all others; rows repeating an id are each written. Of equal payloads exactly one
is a response, also where ids repeat or are null: of the rows with the greatest id any one,
the others revisit it. Empty tables give empty archives and no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.storage import free, new_path, stage

#: The version line that opens a record, what all versions' lines begin with, and what closes a record.
MAGIC, VERSION, END = "WARC/1.0\r\n", "WARC/1.", "\r\n\r\n"
#: Records of an equal payload of so many bytes are written once.
LEAST_REVISIT = 1000


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` as records: id, url, html, bytes, digest, whether it is a revisit and, if so, the id referred to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.nullif(F.col(url_col), F.lit("")), F.lit("about:blank")), r"[\r\n]", "").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"),
    )
    # Of a group of equal payloads: its greatest id, how many rows have that, and the greatest of their urls.
    by_id = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes", "id").agg(F.count("*").alias("n"), F.max("url").alias("u"))
    top = F.max(F.struct(F.col("id").isNotNull(), "id", "n", "u")).alias("top")
    first = stage(by_id.groupBy("digest", "bytes").agg(top, F.sum("n").alias("copies")).where("copies > 1").select("digest", "bytes", F.col("top.id").alias("top_id"), F.col("top.n").alias("top_n"), F.col("top.u").alias("top_url")), "responses")
    marked = rows.join(first, ["digest", "bytes"], "left").withColumn("alone", F.col("top_n").isNull()).withColumn("is_top", F.col("id").eqNullSafe(F.col("top_id")))
    names = ["id", "url", "html", "bytes", "digest"]
    plain = marked.where("alone or not is_top or top_n = 1").withColumn("revisit", F.expr("not alone and not is_top"))
    # Equal rows are written as one that counts them, and told apart by an ordinal.
    counted = marked.where("not alone and is_top and top_n > 1").groupBy("id", "url", "bytes", "digest", "top_id", "top_url").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    equal = counted.withColumn("k", F.explode(F.expr("sequence(1, cast(n as int))"))).withColumn("revisit", F.expr("url <> top_url or k > 1"))
    return plain.unionByName(equal, allowMissingColumns=True).select(*names, "revisit", F.when(F.col("revisit"), F.col("top_id")).alias("refers_to"))


def write(rows: DataFrame, path: str) -> None:
    """Write ``records`` as WARC files; revisits carry no payload."""
    revisit = F.col("revisit")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(header, payload).alias("value")).write.option("lineSep", END).text(path)


def _chain(candidates: DataFrame) -> DataFrame:
    """``(f, at)`` of the candidates that a file's chain reaches; ``candidates`` has f, at, next.

    All tables grow with the archives, so joins are told to sort and merge.
    """
    most = candidates.groupBy("f").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps = stage(candidates.where("next is not null").select("f", "at", "next"), "jumps")
    reached = stage(candidates.where("at = 0").select("f", "at"), "reached")
    for _ in range(most.bit_length()):
        ahead = reached.join(jumps.hint("merge"), ["f", "at"]).select("f", F.col("next").alias("at"))
        more = stage(reached.unionByName(ahead), "reached")
        far = jumps.select("f", F.col("at").alias("next"), F.col("next").alias("_far"))
        doubled = stage(jumps.join(far.hint("merge"), ["f", "next"]).select("f", "at", F.col("_far").alias("next")), "jumps")
        free(reached, jumps)
        reached, jumps = more, doubled
    return reached.join(candidates.select("f", "at").hint("merge"), ["f", "at"], "left_semi")


def _whole(parsed: DataFrame, candidates: DataFrame, real: DataFrame, sep: int) -> None:
    """An error unless each file's chain ends where the file does."""
    sizes = parsed.groupBy("file", "f").agg((F.sum(F.col("size") + sep) - sep).alias("bytes")).where("bytes > 0")
    ends = candidates.join(real.hint("merge"), ["f", "at"]).groupBy("f").agg(F.max("next").alias("end"))
    bad = sizes.join(ends, "f", "left").where("end is null or end <> bytes").select("file", "end", "bytes").limit(5).collect()
    if bad:
        raise ValueError("records don't reach the ends of " + ", ".join(f"{r['file']} (to {r['end'] or 0} of {r['bytes']} bytes)" for r in bad))


def read(spark: SparkSession, path: str, with_payload: bool = True, consume: bool = False) -> DataFrame:
    """``(file, at, type, id, url, digest, refers_to, payload_bytes, payload_digest[, payload BINARY])`` of each record.

    ``digest`` is what the header says, ``payload_digest`` what the payload has. The archives
    are scanned once; all that follows reads what the scan wrote. With ``consume``, archives
    in a path of this library's own are deleted after the scan.
    """
    sep, end, bins = len(VERSION), len(END), 1 << 22
    # A block is read by one task in order, so ``i`` orders its pieces; it is written with them.
    pieces = spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").cast("binary").alias("body")
    )
    field = lambda name: F.regexp_extract("head", rf"(?i)\r\n{name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|\z)", 1)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1), '') as bigint)")
    parsed = stage(
        pieces.withColumn("size", F.octet_length("body").cast("long"))
        # Latin-1 keeps one character a byte, so positions in the header are byte offsets.
        # The end of most headers is near; those with a long url are searched for over the whole piece.
        .withColumn("near", F.locate("\r\n\r\n", F.decode(F.substring("body", 1, 16_384), "ISO-8859-1")))
        .withColumn("cut", F.when((F.col("near") > 0) | (F.col("size") <= 16_384), F.col("near")).otherwise(F.locate("\r\n\r\n", F.decode("body", "ISO-8859-1"))))
        .withColumn("head", F.when((F.col("cut") > 0) & F.substring("body", 1, 8).cast("string").rlike(r"\A[0-9]\r\n"), F.substring(F.col("body"), F.lit(1), F.col("cut") - 1).cast("string")).otherwise(F.lit("")))
        .withColumn("length", F.expr("try_cast(nullif(regexp_extract(head, '(?i)\\r\\nContent-Length[ \\t]*:[ \\t]*([0-9]{1,18})[ \\t]*(?:\\r\\n|$)', 1), '') as bigint)"))
        .withColumn("payload", F.expr("case when length is not null and cut + 3 + length <= size then substring(body, cut + 4, cast(length as int)) end"))
        .select("file", F.xxhash64("file").alias("f"), "block", "i", "size", "cut", "length", field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("urn"), field("WARC-Target-URI").alias("url"),
                field("WARC-Payload-Digest").alias("digest"), field("WARC-Refers-To").alias("refers"), F.sha1("payload").alias("payload_digest"), "body"),
        "pieces", codec="zstd",  # payloads are in it
    )
    if consume:
        free(path)
    slim = parsed.select("f", "block", "i", (F.col("size") + sep).alias("span"), "cut", "length")
    upto = Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = parsed.groupBy("file", "f").agg(F.lit(1)).groupBy("f").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (files or 1) > 1:
        raise ValueError("two archives have the same hash of their paths: move one")
    blocks = slim.groupBy("f", "block").agg(F.sum("span").alias("s")).select("f", "block", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("start"))  # one row for each block
    within = Window.partitionBy("f", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A piece follows the version line at ``at``; the file's first piece follows none.
    placed = slim.withColumn("b", F.sum("span").over(within) - F.col("span")).join(stage(blocks, "blocks"), ["f", "block"]).withColumn("at", F.col("start") + F.col("b") - sep)
    claimed = F.when((F.col("cut") > 0) & F.col("length").isNotNull(), F.col("at") + sep + F.col("cut") + 3 + F.col("length") + end)
    candidates = stage(placed.select("f", "i", "at", (F.col("at") + F.col("span")).alias("stop"), claimed.alias("next"), "cut", "length").where("at >= 0"), "candidates")
    real = stage(_chain(candidates), "chain")
    _whole(parsed, candidates, real, sep)
    found = stage(candidates.join(real.hint("merge"), ["f", "at"]), "records")
    out = found.select("f", "i", "at", "stop", "next").join(parsed.drop("f", *["body"] * (not with_payload)).hint("merge"), "i").select(
        "file", "f", "at", "i", "type", number("urn").alias("id"), "url", F.regexp_replace("digest", "^sha1:", "").alias("digest"), number("refers").alias("refers_to"),
        F.when(F.col("stop") >= F.col("next"), F.col("payload_digest")).alias("payload_digest"), "cut", "length", *["body"] * with_payload,
    )
    # Records whose piece ends early were cut at a version line inside them: put the pieces up to their end back.
    short = found.where("stop < next")
    if short.isEmpty():
        out = out.withColumn("whole", F.lit(None).cast("binary"))
    else:
        spans = short.select("f", F.col("at").alias("owner"), F.col("next").alias("until"), F.explode(F.expr(f"sequence(at div {bins}, next div {bins})")).alias("bin"))
        inner = candidates.join(real.hint("merge"), ["f", "at"], "left_anti").withColumn("bin", F.expr(f"at div {bins}")).join(spans.hint("merge"), ["f", "bin"]).where("at > owner and at < until")
        parts = inner.select("f", "owner", "i", "at").unionByName(short.select("f", F.col("at").alias("owner"), "i", "at"))
        joined = (
            parts.hint("merge").join(parsed.select("i", "body"), "i").groupBy("f", F.col("owner").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("p"))  # one record
            .select("f", "at", F.array_join(F.transform("p", lambda x: x["body"].cast("string")), VERSION).cast("binary").alias("all"))
        )
        out = out.join(joined.hint("merge"), ["f", "at"], "left").withColumn("whole", F.expr("substring(all, cut + 4, cast(length as int))")).drop("all")
    out = out.withColumn("payload_digest", F.coalesce(F.sha1("whole"), "payload_digest"))
    if with_payload:
        out = out.withColumn("payload", F.expr("coalesce(whole, substring(body, cut + 4, cast(length as int)))"))
    return out.select("file", "at", "type", "id", "url", "digest", "refers_to", F.col("length").alias("payload_bytes"), "payload_digest", *["payload"] * with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` as read back from the archives of ``pages``.

    A revisit's payload is that of the response it refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(records(pages, id_col, url_col, html_col), path)
    back = stage(read(spark, path, with_payload=False, consume=True).select("type", "id", "digest", "refers_to", F.col("payload_bytes").alias("bytes"), "payload_digest"), "read-back")
    full = back.where("type = 'response'").groupBy(F.col("payload_digest").alias("digest")).agg(F.max("bytes").alias("full_bytes"))
    revisits = back.where("type = 'revisit'").select("type", "id", "digest", "refers_to").join(full.hint("merge"), "digest", "left")
    responses = back.where("type = 'response'")
    out = responses.select("id", F.col("bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to").unionByName(
        revisits.select("id", F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    )
    return out.withColumnRenamed("id", id_col)
