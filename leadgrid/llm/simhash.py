"""Near-duplicates by SimHash, found through deletion-variant signatures.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles. Fingerprints link if they
differ in at most `bits` bits. They are cut into so few segments that of any two linked ones some segment differs by one
bit at most. Linked fingerprints so meet under that segment with one bit blanked out, and differ in that bit, or under
the whole segment; an equality join on these variants gives the candidates, which are verified.

A variant that many different fingerprints share is not turned into pairs: its members are keyed once more by the rest
of their bits with as many blanked out as may differ. All members of such a key are linked, so a star joins them, and
no link is lost to a limit. Groups of equal texts are one fingerprint from the start.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other. A document's
component is the smallest id that its links reach; null ids are never the smallest, and a component of null ids only
has a null. Repeated rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadgrid.llm import bloom, skew
from leadgrid.llm.components import connected
from leadgrid.llm.text import spaced_words, string_bytes, text_bytes
from leadgrid.sources.storage import stored

SEED = 42
SHINGLE = 3
BITS = 2
#: variants that more fingerprints share go on by finer keys
PAIRS_UP_TO = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned, of a text's bytes; A-Z count as a-z."""
    words = spaced_words(data.lower())
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=">u8").view(np.uint8).reshape(-1, 8)
    on = np.concatenate([np.bincount(h[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * on > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

    return docs.select(F.col(id_col).cast("bigint"), text_bytes(text_col)).mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments: with bits // 2 + 1 of them, one differs by one bit at most."""
    n = bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(fps: DataFrame, bits: int = BITS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(a, b): enough links between the distinct values of `fp` that components are those of all links."""
    segments = _segments(bits)
    # a variant is its segment, the blanked bit (none: 64) and the bits that are left
    kinds = [(s, w, blank) for s, (low, w) in enumerate(segments) for blank in (64, *range(low, low + w))]

    def variant(s: int, blank: int) -> Column:
        low, width = segments[s]
        mask = ((1 << width) - 1) << low
        value = F.lit(0 if blank == 64 else 1) if blank == 64 else F.shiftrightunsigned("fp", blank).bitwiseAND(F.lit(1))
        return F.struct(
            F.lit(s * 100 + blank).alias("kind"),
            F.col("fp").bitwiseAND(F.lit(_signed(mask & ~(0 if blank == 64 else 1 << blank)))).alias("rest"),
            value.cast("byte").alias("bit"),
        )

    # a fingerprint becomes as many rows as there are variants, so even a small table is worth many tasks
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp").repartition(parts, "fp").select("fp", F.explode(F.array(*(variant(s, blank) for s, _, blank in kinds))).alias("v")).select(
        F.col("v.kind").alias("kind"), F.col("v.rest").alias("rest"), F.col("v.bit").alias("bit"), "fp"
    )
    key = ["kind", "rest"]
    blanked = F.col("kind") % 100 < 64
    shared = (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("size"), F.min("bit").alias("lo"), F.max("bit").alias("hi"))
        # under a blanked bit only those meet that differ in it; those that don't meet under the whole segment
        .filter((F.col("size") > 1) & (~blanked | (F.col("lo") < F.col("hi"))))
        .drop("lo", "hi")
    )
    # a merge join, as the planner takes the exploded rows for a few and would broadcast them
    met = stored(rows.join(shared.hint("merge"), key), "simhash-variants")

    few = met.filter(F.col("size") <= pairs_up_to).groupBy(*key).agg(F.collect_list(F.struct("fp", "bit")).alias("m"))
    pairs = few.select("kind", F.explode("m").alias("x"), "m").select(
        F.col("x.fp").alias("a"),
        F.explode(
            F.transform(
                F.filter(
                    "m",
                    lambda y: (y["fp"] > F.col("x.fp"))
                    & (~blanked | (y["bit"] != F.col("x.bit")))
                    & (F.bit_count(y["fp"].bitwiseXOR(F.col("x.fp"))) <= bits),
                ),
                lambda y: y["fp"],
            )
        ).alias("b"),
    )
    many = met.filter(F.col("size") > pairs_up_to)
    if many.isEmpty():
        return pairs.distinct()

    def finer(s: int, blank_one: bool) -> list[int]:
        """Masks of the bits outside segment s with as many blanked out as may still differ."""
        low, width = segments[s]
        outside = [b for b in range(64) if not low <= b < low + width]
        every = sum(1 << b for b in outside)
        return [_signed(every & ~sum(1 << b for b in off)) for off in combinations(outside, bits - blank_one)]

    stars = []
    for s in range(len(segments)):
        for blank_one in (False, True):
            here = many.filter((F.floor(F.col("kind") / 100) == s) & (blanked if blank_one else ~blanked))
            masks = F.array(*(F.lit(m) for m in finer(s, blank_one)))
            fine = here.select(*key, "fp", F.posexplode(masks).alias("n", "mask")).select(
                *key, "n", F.col("fp").bitwiseAND(F.col("mask")).alias("other"), "fp"
            )
            fine_key = [*key, "n", "other"]
            least = stored(
                fine.groupBy(*fine_key).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1"),
                "simhash-stars",
            )
            stars.append(skew.join_groups(fine, least, fine_key, "members").filter("fp <> a").select("a", F.col("fp").alias("b")))
    return reduce(DataFrame.unionByName, stars, pairs).distinct()


def cluster(fps: DataFrame, bits: int = BITS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """For each distinct fingerprint of (doc_id, fp): its rows (`group_size`), its component's `root`, rows (`members`)
    and smallest id (`component_id`)."""
    distinct = stored(
        fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("group_size")), "simhash-distinct"
    )
    roots = stored(connected(links(distinct, bits, pairs_up_to)).withColumnRenamed("node", "fp"), "simhash-roots")
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = stored(labelled, "simhash-labelled")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("group_size").alias("members"))
    found = labelled.join(least, "root").select("fp", "group_size", "root", "members", "component_id")
    return stored(found, "simhash-components")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS,
    pairs_up_to: int = PAIRS_UP_TO,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    rows = skew.join_groups(fps, cluster(fps, bits, pairs_up_to), ["fp"], "group_size")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS,
    pairs_up_to: int = PAIRS_UP_TO,
) -> DataFrame:
    """One row of each component, columns as they were: that with the smallest id; rows with null ids go last."""
    names = docs.columns

    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(string_bytes(t), shingle) for t in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, "fp"])

    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    rows = stored(plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("fp", T.LongType())])), "simhash-rows")
    doc_id = F.col(f"row.c{names.index(id_col)}").cast("bigint")
    rows = rows.select(F.struct(*plain.columns).alias("row"), "fp")
    groups = cluster(rows.select(doc_id.alias("doc_id"), "fp"), bits, pairs_up_to)
    # rows that surely are alone in their component pass as they are; only the others are shuffled
    crowded = groups.filter("members > 1").select(F.xxhash64("fp").alias("h"))
    seen = bloom.build(crowded, bloom.slots_for(crowded.count()))
    rows = rows.withColumn("maybe", bloom.probe(rows, seen, F.xxhash64("fp")))
    first = F.struct(doc_id.isNull(), doc_id, F.xxhash64("row"))
    kept = (
        skew.join_groups(rows.filter("maybe"), groups, ["fp"], "group_size")
        .groupBy("root")
        .agg(F.min_by("row", first).alias("row"))
    )
    both = rows.filter(~F.col("maybe")).select("row").unionByName(kept.select("row"))
    return both.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))
