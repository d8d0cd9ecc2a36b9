"""Exact deduplication by two passes over a bit filter.

The first pass marks which text hashes occur more than once, as far as a filter can tell; the second lets every row
whose hash is surely unique straight through and shuffles only the others, which are compared by SHA-256.
Null texts count as empty, so they equal each other and empty texts. Of rows with equal texts and equal ids one stays.
A null id is smaller than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.llm import bloom, skew
from leadgrid.llm.text import text_bytes
from leadgrid.sources.storage import stored


def _filter(hashes: DataFrame, slots: int | None):
    return bloom.build(hashes, slots or bloom.slots_for(hashes.count()), "again")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """One row per input row: id, `keep_id`, `group_size`, `kept`, `text_sha256`; the largest id of equal texts stays.

    Texts are read once; what is shuffled is an id and a digest, of possibly repeated rows only.
    """
    row = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text_bytes(text_col), 256)).alias("digest"),
    )
    rows = stored(row.withColumn("h", F.xxhash64("digest")), "exact-hashes")
    again = _filter(rows.select("h"), slots)
    rows = stored(rows.withColumn("maybe", bloom.probe(rows, again, F.col("h"))).drop("h"), "exact-flags")
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = rows.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    maybe = rows.filter("maybe").drop("maybe")
    found = stored(
        maybe.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
        ),
        "exact-groups",
    )
    members = skew.join_groups(maybe, found, ["digest"], "group_size")
    return alone.unionByName(
        members.select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), sha
        )
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """The input without repeated texts, all columns as they were; the row with the largest id stays."""
    names = docs.columns
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    row = docs.select(F.struct(*fields).alias("row"), F.sha2(text_bytes(text_col), 256).alias("digest"))
    again = _filter(row.select(F.xxhash64("digest").alias("h")), slots)
    flagged = row.withColumn("maybe", bloom.probe(row, again, F.xxhash64("digest")))
    order = F.struct(F.col(f"row.c{names.index(id_col)}"), F.xxhash64("row"))
    kept = flagged.filter("maybe").groupBy("digest").agg(F.max_by("row", order).alias("row")).select("row")
    both = flagged.filter(~F.col("maybe")).select("row").unionByName(kept)
    return both.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))
