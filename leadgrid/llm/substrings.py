"""Removal of passages that repeat across documents, by seeds that are extended both ways.

A window is `window` consecutive words. Each window has one anchor, the least hash among its runs of `seed` words, so
equal windows have equal anchors in the same place (winnowing), and neighbouring windows mostly share theirs. The words
that an anchor's windows cover form its stretch: the seed extended to the left and right as far as its windows reach.

1. Documents are joined on anchors; those of one document only are done.
2. Occurrences of an anchor with equal stretches have the same windows, so all but the one in the smallest document
   repeat it. This settles copies, however many, without pairs.
3. Where an anchor has different stretches, one occurrence of each is extended word by word: each of its windows is
   looked up by (anchor, hash of the window), and the smallest document that has it wins.

Windows that repeat are united, so what goes are maximal repeats of at least `window` words. Positions of a window
start count, also inside one document; a document never counts against itself, nor do rows with an equal id.
Null texts have no words. Rows with a null id are neither earlier nor later than any other and stay as they are.
Windows are compared by two 64-bit hashes, of the anchor and of the whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgrid.llm import bloom, skew
from leadgrid.llm.text import spaced_words, text_bytes
from leadgrid.sources.storage import stored

WINDOW = 50
SEED = 16
#: windows handled at a time, so that a very long text takes bounded memory
_CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VOCABULARY = 300_000


class _Words(dict):
    """Word hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Hasher:
    """Hashes of runs of words, by prefix sums of word hashes times powers of a base, modulo 2**64."""

    def __init__(self):
        self.known = _Words()
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _VOCABULARY:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if n >= len(self.powers):
            one = np.ones(1, dtype=np.uint64)
            grow = lambda base: np.cumprod(np.concatenate([one, np.full(2 * n, base, dtype=np.uint64)]))
            self.powers, self.inverses = grow(_BASE), grow(_BASE_INVERSE)
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * self.powers[:n])])

    def runs(self, sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the runs of `length` words from each start."""
        h = (sums[start + length] - sums[start]) * self.inverses[start]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(27))


def anchors(hasher: Hasher, words: list[bytes], window: int = WINDOW, seed: int = SEED):
    """For each chunk of a text: its offset, its prefix sums, and of each anchor the first window, the number of
    windows, the seed's hash and the stretch's hash."""
    total = len(words) - window + 1
    width = window - seed + 1
    if total < 1:
        return
    all_hashes = hasher.words(words)
    for offset in range(0, total, _CHUNK):
        n = min(_CHUNK, total - offset)
        sums = hasher.sums(all_hashes[offset : offset + n + window - 1])
        seeds = hasher.runs(sums, np.arange(n + width - 1), seed)
        # the position in the low bits: the least hash wins, of equal ones the leftmost
        low = (seeds & ~np.uint64(0xFFFFFF)) | np.arange(len(seeds), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: n], low[width - span : width - span + n])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        count = np.diff(np.concatenate([first, [n]]))
        yield offset, sums, first, count, seeds[at[first]], hasher.runs(sums, first, count + window - 1)


_ANCHORS = "array<struct<lo:bigint,c:bigint,anchor:bigint,stretch:bigint>>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _lists(columns: dict[str, list[np.ndarray]], sizes: list[int]) -> pa.Array:
    """A list of structs for each row, from flat columns."""
    flat = [pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *parts]).astype(np.int64)) for parts in columns.values()]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, list(columns)))


def _scan(window: int, seed: int):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            out: dict[str, list] = {"lo": [], "c": [], "anchor": [], "stretch": []}
            sizes, counts, digests = [], [], []
            for text in batch.column(2):
                words = spaced_words(text.as_buffer().to_pybytes())
                size = 0
                for offset, _, first, count, anchor, stretch in anchors(hasher, words, window, seed):
                    for name, values in zip(out, (first + offset, count, _signed(anchor), _signed(stretch)), strict=True):
                        out[name].append(values)
                    size += len(first)
                sizes.append(size)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), _lists(out, sizes)],
                ["doc_id", "key", "n_words", "kept_sha256", "anchors"],
            )

    return run


def _extend(window: int, seed: int):
    """The hashes of the windows of the wanted anchors of each text."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids, anchor, stretch, c, windows, sizes = [], [], [], [], [], []
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                wanted = {w["lo"]: w["c"] for w in wanted}
                words = spaced_words(text.as_buffer().to_pybytes())
                for offset, sums, first, count, a, s in anchors(hasher, words, window, seed):
                    for i, lo in enumerate((first + offset).tolist()):
                        if wanted.get(lo) == count[i]:
                            ids.append(doc_id)
                            anchor.append(a[i])
                            stretch.append(s[i])
                            c.append(count[i])
                            windows.append(_signed(hasher.runs(sums, np.arange(first[i], first[i] + count[i]), window)))
                            sizes.append(len(windows[-1]))
            flat = pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *windows]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(_signed(np.array(anchor, dtype=np.uint64))),
                    pa.array(_signed(np.array(stretch, dtype=np.uint64))),
                    pa.array(c, pa.int64()),
                    lists,
                ],
                ["first", "anchor", "stretch", "c", "windows"],
            )

    return run


def kept_words(words: list[bytes], removed: list[dict], window: int) -> tuple[list[bytes], int]:
    """The words that no removed window covers; `removed` has first windows and bit masks of the windows from there."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for r in removed:
        bits = np.flatnonzero(np.unpackbits(np.array([r["mask"]], dtype="<i8").view(np.uint8), bitorder="little")) + r["lo"]
        np.add.at(edge, bits, 1)
        np.add.at(edge, bits + window, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], int((~keep).sum())


def _remove(window: int, texts: bool):
    def run(batches):
        for batch in batches:
            counts, gone, out = [], [], []
            for text, removed in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = spaced_words(text.as_buffer().to_pybytes())
                kept, n = kept_words(words, removed, window)
                counts.append(len(words))
                gone.append(n)
                line = b" ".join(kept)
                out.append(line.decode("utf-8", "replace") if texts else hashlib.sha256(line).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def _maybe(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose key may be among the wanted ones: only their texts are shuffled by the join that follows."""
    keys = wanted.select("key").distinct()
    return docs.filter(bloom.probe(docs, bloom.build(keys, bloom.slots_for(keys.count())), F.col("key")))


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, key, text): one row per document with its words and their digest, and, for documents with windows that
    start in a smaller document, (doc_id, key, removed)."""
    scan = "doc_id bigint, key bigint, n_words bigint, kept_sha256 string, anchors " + _ANCHORS
    scanned = stored(docs.mapInArrow(_scan(window, seed), scan), "substrings-scan")
    all_of = scanned.filter("doc_id is not null").select("doc_id", "key", F.inline("anchors"))
    shared = (
        all_of.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo_id"), F.max("doc_id").alias("hi_id"), F.count(F.lit(1)).alias("size"))
        .filter("lo_id < hi_id")
        .select("anchor", "size")
    )
    found = stored(skew.join_groups(all_of, stored(shared, "substrings-shared"), ["anchor"], "size").drop("size"), "substrings-seeds")

    key = ["anchor", "stretch", "c"]
    classes = stored(
        found.groupBy(*key).agg(
            F.min(F.struct("doc_id", "key", "lo")).alias("rep"), F.count(F.lit(1)).alias("size")
        ).select(*key, "size", F.col("rep.doc_id").alias("first"), F.col("rep.key").alias("key"), F.col("rep.lo").alias("lo")),
        "substrings-classes",
    )
    mixed = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reps = skew.join_groups(classes, stored(mixed, "substrings-mixed"), ["anchor"], "n")
    wanted = stored(
        reps.groupBy(F.col("first").alias("doc_id"), "key").agg(F.collect_list(F.struct("lo", "c")).alias("wanted")),
        "substrings-wanted",
    )
    texts = _maybe(docs, wanted).join(wanted, ["doc_id", "key"]).select("doc_id", "text", "wanted")
    extended = texts.mapInArrow(
        _extend(window, seed), "first bigint, anchor bigint, stretch bigint, c bigint, windows array<bigint>"
    )
    extended = stored(extended, "substrings-windows").select(
        *key, "first", F.posexplode("windows").alias("at", "w")
    )
    least = extended.groupBy("anchor", "w").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    later = skew.join_groups(extended, stored(least.filter("n > 1"), "substrings-least"), ["anchor", "w"], "n").filter("least < first")
    masks = later.groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, cast(at as int))")).alias("own"))
    settled = stored(classes.drop("key", "lo").join(masks, key, "left"), "substrings-settled")

    every = F.expr("shiftleft(1L, cast(c as int)) - 1")
    mask = F.when(F.col("doc_id") > F.col("first"), every).otherwise(F.coalesce("own", F.lit(0).cast("long")))
    removed = (
        skew.join_groups(found, settled, key, "size")
        .select("doc_id", "key", "lo", mask.alias("mask"))
        .filter("mask <> 0")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("lo", "mask")).alias("removed"))
    )
    return scanned.drop("anchors"), stored(removed, "substrings-removed")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text: Column = text_bytes(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def report(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row."""
    rows = _keyed(docs, id_col, text_col)
    scanned, removed = repeats(rows, window, seed)
    same = scanned.join(removed.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    changed = _maybe(rows, removed).join(removed, ["doc_id", "key"]).select("doc_id", "key", "text", "removed")
    changed = changed.mapInArrow(_remove(window, False), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    return same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionByName(
        changed.withColumnRenamed("kept", "kept_sha256")
    )


def kept_texts(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space, of documents that lose any."""
    rows = _keyed(docs, id_col, text_col)
    _, removed = repeats(rows, window, seed)
    changed = _maybe(rows, removed).join(removed, ["doc_id", "key"]).select("doc_id", "key", "text", "removed")
    return changed.mapInArrow(_remove(window, True), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
