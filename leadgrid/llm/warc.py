"""WARC archives: writing with revisit records, and reading with a verified chain of record boundaries.

Writing makes one record per row: a response with the payload, or, if a row with a larger id has an equal payload of at
least `REVISIT_FROM` bytes, a revisit that refers to the largest id. Rows that share the largest id and the payload are
all responses, and so are rows of payloads that only null ids have.

Reading takes files apart at every `WARC/1.0`, also inside payloads. Each of these is a candidate record, and its length
gives the offset of its successor. Inside a split a task follows its candidates to where they leave the split; pointer
jumping over these few exits, from the start of each file, tells where the true chain enters every split. A second pass
keeps the records that this chain reaches and puts the parts of each together, those of other splits included. Splits of
files, not whole files, are the unit of work, so archives of any size are read in parallel.

Null payloads are empty, null urls and ids leave out their header; line breaks in urls are percent-encoded. What follows
a break of the chain in a file (bytes that are no record) is not reached and not returned; a record that the end of the
file cuts short is returned as far as it goes. A block that is not HTTP, as in records that describe the archive, is all
payload; a revisit without a digest or a length has nulls there. Repeated rows are records of their own, other columns are
not read, payloads of any length may cross splits, and an empty table gives no records.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadgrid.llm import bloom, skew
from leadgrid.llm.text import text_bytes
from leadgrid.sources.storage import scratch_path, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def write(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", date: str = DATE) -> None:
    """One WARC file for each partition of `pages`, in a new folder at `path`."""
    payload = text_bytes(F.col(f"`{payload_col}`"))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        payload.cast("string").alias("payload"),
        F.octet_length(payload).cast("bigint").alias("bytes"),
        F.sha1(payload).alias("digest"),
    )
    large = rows.filter(F.col("bytes") >= REVISIT_FROM)
    hashes = large.select(F.xxhash64("digest").alias("h"))
    again = bloom.build(hashes, bloom.slots_for(large.count()), "again")
    repeated = (F.col("bytes") >= REVISIT_FROM) & bloom.probe(rows, again, F.xxhash64("digest"))
    rows = rows.withColumn("maybe", repeated)
    first = stored(
        rows.filter("maybe").groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("size")), "warc-payloads"
    )
    known = skew.join_groups(rows.filter("maybe"), first, ["digest"], "size").drop("size")
    both = rows.filter(~F.col("maybe")).withColumn("first", F.lit(None).cast("bigint")).unionByName(known)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))

    def header(name: str, value) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    record = F.concat(
        F.lit(MAGIC),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), F.col("id").cast("string"), F.lit(">"))),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Date", F.lit(date)),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:x-page:"), F.col("first").cast("string"), F.lit(">")))),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )
    # the line separator is what ends a record
    both.select(record.alias("value")).write.option("lineSep", END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, in order inside each split (file, at)."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value")
    )


def _candidates(batches):
    """For each split its length; of each candidate its place in the split, where its chain leaves the split, and the last
    record on the way. Places count from the split's first segment, whose magic may stand in the split before."""
    size, found, split = 0, {}, None
    kinds = (pa.string(), *[pa.int64()] * 5)

    def closed():
        chains: dict[int, tuple[int, int]] = {}
        for place in sorted(found, reverse=True):
            to = found[place]
            if to is None:
                continue
            if to >= size - len(MAGIC):
                chains[place] = (to, place)
            elif to in chains:
                chains[place] = chains[to]
        rows = [(*split, size, None, None, None), *((*split, None, place, *to) for place, to in chains.items())]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            ["file", "at", "size", "place", "leave", "last"],
        )

    for batch in batches:
        for file, at, length, header, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if split != (file, at):
                if split is not None:
                    yield closed()
                size, found, split = 0, {}, (file, at)
            found[size - len(MAGIC)] = None if content is None else size + header + content + 2 * len(END)
            size += length + len(MAGIC)
    if split is not None:
        yield closed()


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, base, cover) of each split: its first segment's offset, and the record that is open there, if any, as
    its start and its successor's."""
    value = F.col("value").cast("string")
    header = F.substring_index(value, END, 1)
    length = F.regexp_extract(header, r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1)
    measured = _segments(spark, path).select(
        "file",
        "at",
        F.octet_length("value").cast("bigint").alias("length"),
        F.octet_length(header).cast("bigint").alias("header"),
        F.when(F.octet_length(header) < F.octet_length("value"), length.try_cast("bigint")).alias("content"),
    )
    found = stored(
        measured.mapInArrow(_candidates, "file string, at bigint, size bigint, place bigint, leave bigint, last bigint"),
        "warc-candidates",
    )
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.filter("size is not null").select("file", "at", "size")
    bases = stored(sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size"), "warc-splits")
    # splits are far fewer than the records of any archive, one for each block of a file
    steps = found.filter("place is not null").join(F.broadcast(bases), ["file", "at"])
    steps = stored(
        steps.select("file", "at", *((F.col(c) + F.col("base")).alias(n) for c, n in (("place", "start"), ("leave", "next"), ("last", "last")))),
        "warc-steps",
    )
    # between splits only the starts of files and the places matter that some chain of another split leads to
    zero = F.lit(0).cast("bigint").alias("start")
    doors = steps.select("file", F.col("next").alias("start")).unionByName(steps.select("file", zero)).distinct()
    doors = stored(steps.join(doors, ["file", "start"]), "warc-doors")
    jump, reached = doors.select("file", "start", "next"), doors.select("file", zero).distinct()
    most = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        further = reached.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        reached = stored(reached.unionByName(further).distinct(), "warc-reached")
        twice = jump.select("file", F.col("next").alias("via"), F.col("start").alias("from")).join(
            jump.select("file", F.col("start").alias("via"), "next"), ["file", "via"]
        )
        jump = stored(twice.select("file", F.col("from").alias("start"), "next"), "warc-jumps")
    entered = doors.join(reached, ["file", "start"]).select("file", "at", F.struct("last", "next").alias("span"))
    spans = bases.join(entered, ["file", "at"], "left")
    cover = F.last("span", ignorenulls=True).over(before)
    return stored(
        spans.withColumn("cover", cover)
        # the open record's successor may be the split's first segment
        .withColumn("cover", F.when(F.col("cover.next") >= F.col("base") - len(MAGIC), F.col("cover")))
        .select("file", "at", "base", "cover"),
        "warc-entries",
    )


def _reached(whole: bool):
    """The records that the chain reaches: those that lie in one split, or the parts of the others."""
    magic = MAGIC.encode()
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "record", "place", "part"]
        )

    def run(batches):
        split, out, parts, size = None, [], [], 0
        here = record = end = place = -1

        def flush():
            if parts:
                data = b"".join(parts)
                if whole == (len(data) == end - record - len(magic)):
                    out.append((split[0], record, place, data))
                parts.clear()

        for batch in batches:
            for file, at, value, base, cover in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if split != (file, at):
                    flush()
                    if base is None:
                        raise RuntimeError("the splits of the archives changed between two passes; read them again")
                    split, here = (file, at), base
                    record, end = (cover["last"], cover["next"]) if cover is not None else (-1, -1)
                start = here - len(magic)
                if start == end or start == 0:
                    flush()
                    head = value.find(END.encode())
                    length = _content_length(value[:head]) if head >= 0 else None
                    record, end = (start, here + head + length + 2 * len(END)) if length is not None else (-1, -1)
                    if record >= 0:
                        parts.append(value)
                        place = here
                elif record >= 0 and start < end:
                    # a magic inside a payload
                    if not parts:
                        place = start
                    parts.append(magic + value)
                elif record >= 0:
                    flush()
                    record = end = -1
                here += len(value) + len(magic)
                size += len(value)
                if size > 1 << 24:
                    yield batch_of(out)
                    out, size = [], 0
        flush()
        yield batch_of(out)

    return run


def _content_length(header: bytes) -> int | None:
    for line in header.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _parsed(batches):
    names = ["id", "type", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    for batch in batches:
        rows = []
        for parts in batch.column(0).to_pylist():
            head, _, rest = b"".join(parts).partition(END.encode())
            fields = {}
            for line in head.decode("utf-8", "replace").split("\r\n"):
                name, _, value = line.partition(":")
                fields[name.lower()] = value.strip()
            http, payload = b"", rest[: _content_length(head)]
            if payload.startswith(b"HTTP/") or fields.get("content-type", "").lower().startswith("application/http"):
                http, _, payload = payload.partition(END.encode())
            kind = fields.get("warc-type")
            if kind == "revisit":
                told = fields.get("warc-payload-digest")
                size, digest, payload = _content_length(http), told and told.removeprefix("sha1:"), None
            else:
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            ids = _number(fields.get("warc-record-id")), _number(fields.get("warc-refers-to"))
            rows.append((ids[0], kind, fields.get("warc-target-uri"), ids[1], size, digest, payload))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, url, refers_to, payload_bytes, payload_digest, payload) of each record of the archives in a folder.

    Digests and sizes of responses are those of the payload as read; revisits tell those of the payload they stand for.
    """
    where = F.broadcast(entries(spark, path))
    segments = _segments(spark, path).join(where, ["file", "at"], "left").select("file", "at", "value", "base", "cover")
    kind = "file string, record bigint, place bigint, part binary"
    alone = segments.mapInArrow(_reached(True), kind).select(F.array("part").alias("parts"))
    crossing = segments.mapInArrow(_reached(False), kind).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts")
    )
    records = alone.unionByName(crossing.select(F.col("parts.part").alias("parts")))
    return records.mapInArrow(
        _parsed,
        "id bigint, type string, url string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary",
    )


def roundtrip(pages: DataFrame, **columns) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives of the pages, as read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, **columns)
    return read(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )
