"""Benchmark decontamination by a generalised suffix automaton of the test items.

An item's windows are its runs of `window` consecutive words; an item of fewer words, but not none, is one window. The
automaton holds all substrings of the normalised items. Document words stream through it while the longest match that
ends at each word is tracked: a match of at least `window` words, or one that ends with a whole short item, marks words
as hit. Stretches whose neighbouring word pairs are not all pairs of items cannot hold a match and are skipped.

Items are packed into blocks of a bounded number of words (longer items are cut with an overlap that keeps their
windows), so an automaton's size is bounded however many items there are; documents pass each block in turn.
Null or empty texts have no words and no hits; items without words are never found; items with equal ids count once;
a null item id has windows but no name, so it marks words and is not listed. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

import pickle
import re
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.llm import bloom
from leadgrid.llm.text import ALNUM_TABLE, alnum_words, merged, slices, string_bytes, text_bytes
from leadgrid.sources.storage import stored

WINDOW = 10
#: item words in one automaton, about 60 MB of tables
BLOCK_WORDS = 200_000
_PAIR_BITS = 22
_PAIR_MIX = 0x9E3779B97F4A7C15


def _pair_slots(ids: np.ndarray) -> np.ndarray:
    a, b = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
    return (((a << np.uint64(32)) | b) * np.uint64(_PAIR_MIX)) >> np.uint64(64 - _PAIR_BITS)


def automaton(items: list[tuple[str | None, list[bytes]]], window: int) -> dict:
    """The suffix automaton of the items' words, with the items of each window."""
    vocabulary: dict[bytes, int] = {}
    follow: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]

    def extend(last: int, w: int) -> int:
        if w in follow[last]:
            q = follow[last][w]
            if longest[q] == longest[last] + 1:
                return q
            return split(last, w, q)
        new = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            link[new] = q if longest[q] == longest[p] + 1 else split(p, w, q)
        return new

    def split(p: int, w: int, q: int) -> int:
        """A state for the shorter strings of q, those that p followed by w ends."""
        clone = len(follow)
        follow.append(dict(follow[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and follow[p].get(w) == q:
            follow[p][w] = clone
            p = link[p]
        return clone

    numbered = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for name, words in items if words]
    for _, words in numbered:
        state = 0
        for w in words:
            state = extend(state, w)

    names: dict[int, set] = {}  # of each window of full length, by the state that holds it
    whole: dict[int, dict[int, set]] = {}  # of short items, by state and length
    pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
    for name, words in numbered:
        pairs[_pair_slots(np.array(words, dtype=np.int64))] = True
        state = 0
        for w_at, w in enumerate(words, 1):
            state = follow[state][w]
            if w_at >= window:
                while longest[link[state]] >= window:
                    state = link[state]
                names.setdefault(state, set()).add(name)
        if len(words) < window:
            whole.setdefault(state, {}).setdefault(len(words), set()).add(name)
    # the nearest state on the way to the root, itself included, that ends a whole short item
    near = [-1] * len(follow)
    for state in sorted(range(len(follow)), key=longest.__getitem__):
        near[state] = state if state in whole else near[link[state]] if state else -1
    return {
        "window": window,
        "shortest": min((min(len(w), window) for _, w in numbered), default=0),
        "vocabulary": vocabulary,
        "follow": follow,
        "link": link,
        "longest": longest,
        "names": names,
        "whole": whole,
        "near": near,
        "pairs": np.packbits(pairs).tobytes(),
    }


class Matcher:
    """Finds the hit words of a text, and the items whose windows occur in it."""

    def __init__(self, tables: dict):
        self.t = tables
        self.pairs = np.unpackbits(np.frombuffer(tables["pairs"], dtype=np.uint8)).astype(bool)

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Sorted, disjoint spans of hit words, ends exclusive, and item names."""
        t, least = self.t, self.t["shortest"]
        if not least or len(words) < least:
            return [], set()
        ids = np.fromiter(map(t["vocabulary"].get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        if least > 1:
            # word i can be in a match if the pair with the word before or after it is a pair of items
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            ok &= self.pairs[_pair_slots(ids)]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
            runs = [(a, b + 1) for a, b in edges.reshape(-1, 2) if b - a + 1 >= least]
        else:
            runs = [(a, b) for a, b in np.flatnonzero(np.diff(known.astype(np.int8))).reshape(-1, 2)]
        spans: list[tuple[int, int]] = []
        names: set = set()
        for a, b in runs:
            self._stream(ids[a:b].tolist(), int(a), spans, names)
        return merged(spans), names

    def _stream(self, ids: list[int], start: int, spans: list, names: set) -> None:
        t, window = self.t, self.t["window"]
        follow, link, longest, near, whole = t["follow"], t["link"], t["longest"], t["near"], t["whole"]
        state = length = 0
        for at, w in enumerate(ids, start + 1):
            while state and w not in follow[state]:
                state = link[state]
                length = longest[state]
            if w not in follow[state]:
                continue
            state = follow[state][w]
            length += 1
            end = near[state]
            while end > 0:
                for n, found in whole[end].items():
                    if n <= length:
                        spans.append((at - n, at))
                        names |= found
                end = near[link[end]]
            if length >= window:
                spans.append((at - window, at))
                while longest[link[state]] >= window:
                    state = link[state]
                length = window
                names |= t["names"][state]


def automata(items: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """The automata of all items, one after another; each holds about `block_words` words at most."""
    step = max(block_words - window + 1, 1)

    def cut(batches):
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = alnum_words(text.as_buffer().to_pybytes())
                for a in range(0, max(len(words) - window + 1, 1 if words else 0), step):
                    part = words[a : a + step + window - 1]
                    rows.append((name, b" ".join(part), len(part)))
            kinds = (pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["name", "words", "n"])

    parts = items.select(F.col(item_col).cast("string"), text_bytes(text_col)).mapInArrow(
        cut, "name string, words binary, n bigint"
    )
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        # one automaton has at most block_words words and one part more, whatever the hash deals it
        out, group, size = [], [], 0
        for name, words, n in zip(rows["name"], rows["words"], rows["n"], strict=True):
            if group and size + n > block_words:
                out.append(pickle.dumps(automaton(group, window)))
                group, size = [], 0
            group.append((None if pd.isna(name) else name, words.split()))
            size += int(n)
        out.append(pickle.dumps(automaton(group, window)))
        return pd.DataFrame({"tables": out})

    if blocks:
        dealt = parts.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(blocks)))
        for row in dealt.groupBy("block").applyInPandas(build, "tables binary").toLocalIterator():
            yield row[0]


_SPANS = "array<struct<start:bigint,end:bigint>>"


def hits(
    docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: id, `n_words`, `spans` of hit words, `items` found (sorted, as strings)."""
    frame = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        text_bytes(text_col).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(_SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = frame.schema
    blocks = list(automata(items, item_col, item_text, window, block_words)) or [pickle.dumps(automaton([], window))]
    for n, tables in enumerate(blocks):
        held = docs.sparkSession.sparkContext.broadcast(tables)
        last = n == len(blocks) - 1

        def run(batches, held=held, last=last):
            match = Matcher(pickle.loads(held.value))
            for batch in batches:
                counts, spans, names = [], [], []
                for text, old, had in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    words = alnum_words(text.as_buffer().to_pybytes())
                    found, items_found = match(words)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(found + [(s["start"], s["end"]) for s in old])])
                    names.append(sorted({x for x in items_found if x is not None}.union(had)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([b""] * len(counts), pa.binary()) if last else batch.column(1),
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    ["doc_id", "text", "n_words", "spans", "items"],
                )

        frame = frame.mapInArrow(run, schema)
    return frame.drop("text")


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Counts and digests of `hits`, one row per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return hits(docs, items, **options).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORD = re.compile(rb"[^ ]+")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them; what is left is unchanged."""
    places = [m.span() for m in _WORD.finditer(text.translate(ALNUM_TABLE))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return b"".join(out)


def _rewritten(batch: pa.RecordBatch, new: list[bytes | None], text_at: int, chars_at: int | None) -> pa.RecordBatch:
    """The batch with new texts and their `n_chars`; rows whose text is None go, others keep what they have."""
    old = [string_bytes(t) for t in batch.column(text_at)]
    changed = [x is not None and x != y for x, y in zip(new, old, strict=True)]
    if any(changed):
        columns, texts = list(batch.columns), batch.column(text_at).to_pylist()
        texts = [x.decode("utf-8", "replace") if c else t for x, c, t in zip(new, changed, texts, strict=True)]
        columns[text_at] = pa.array(texts, columns[text_at].type)
        if chars_at is not None:
            counts = columns[chars_at].to_pylist()
            counts = [len(t) if c else n for t, c, n in zip(texts, changed, counts, strict=True)]
            columns[chars_at] = pa.array(counts, columns[chars_at].type)
        batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return batch.filter(pa.array([x is not None for x in new], pa.bool_()))


def _too_much(spans, words: list[bytes], longest_share: float) -> bool:
    return sum(b - a for a, b in spans) > longest_share * len(words)


def _cleaner(held, longest_share: float, text_at: int, chars_at: int | None):
    """Cuts the hits of one block, the only one, until nothing is hit."""

    def cleaned(match: Matcher, data: bytes) -> bytes | None:
        """The text without hits; None if the document goes."""
        words = alnum_words(data)
        found, _ = match(words)
        if _too_much(found, words, longest_share):
            return None
        while found:
            data = without(data, found)
            found, _ = match(alnum_words(data))
        return data

    def run(batches):
        match = Matcher(pickle.loads(held.value))
        for batch in (part for whole in batches for part in slices(whole, text_at)):
            yield _rewritten(batch, [cleaned(match, string_bytes(t)) for t in batch.column(text_at)], text_at, chars_at)

    return run


def _finder(held):
    """(row, spans) of the texts that a block hits, from (row, text)."""

    def run(batches):
        match = Matcher(pickle.loads(held.value))
        for batch in batches:
            rows, spans = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, _ = match(alnum_words(string_bytes(text)))
                if found:
                    rows.append(row)
                    spans.append([{"start": a, "end": b} for a, b in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, kind)], ["row", "spans"])

    return run


def _cutter(share: float | None, text_at: int, chars_at: int | None):
    """Cuts the spans, the last column, which it drops; the share rule is applied if there is a share."""

    def cut(data: bytes, spans: list[dict]) -> bytes | None:
        found = merged((s["start"], s["end"]) for s in spans)
        return None if share is not None and _too_much(found, alnum_words(data), share) else without(data, found)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_at)):
            plain = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            new = [cut(string_bytes(t), s) for t, s in zip(batch.column(text_at), batch.column(-1).to_pylist(), strict=True)]
            yield _rewritten(plain, new, text_at, chars_at)

    return run


def _clean_by_blocks(docs: DataFrame, blocks: list[bytes], longest_share: float, text_at: int, chars_at: int | None) -> DataFrame:
    """Whole passes: all blocks search the same texts, then what they found is cut at once, until no block hits."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    # the first pass reads the rows by number, so they are written with their numbers once
    rows = stored(plain.withColumn("row", F.monotonically_increasing_id()), "leaks-rows")
    sent = [docs.sparkSession.sparkContext.broadcast(tables) for tables in blocks]
    done, share = [], longest_share
    while True:
        texts = rows.select("row", f"c{text_at}")
        found = [stored(texts.mapInArrow(_finder(held), f"row bigint, spans {_SPANS}"), "leaks-spans") for held in sent]
        spans = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        spans = stored(spans, "leaks-found")
        n = spans.count()
        if not n:
            return reduce(DataFrame.unionByName, [*done, rows]).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
        # only rows that are hit are shuffled
        may = bloom.probe(rows, bloom.build(spans.select(F.xxhash64("row")), bloom.slots_for(n)), F.xxhash64("row"))
        flagged = rows.withColumn("maybe", may)
        done += [flagged.filter(~F.col("maybe")).drop("maybe")]
        maybe = flagged.filter("maybe").drop("maybe")
        done += [maybe.join(spans.select("row"), "row", "left_anti").select(*rows.columns)]
        hit = maybe.join(spans, "row").select(*rows.columns, "spans")
        rows = stored(hit.mapInArrow(_cutter(share, text_at, chars_at), rows.schema), "leaks-rows")
        share = None


def clean(
    docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
    window: int = WINDOW, longest_share: float = 0.8, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without hit spans, columns as they were and `n_chars`, if there is one, counted anew.

    Documents of which more than `longest_share` of the words are hit go; documents without a hit stay as they are.
    Words that come together where a span goes are matched again, until nothing is hit. Items in several blocks give
    the same result as items in one.
    """
    text_at = docs.columns.index(text_col)
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    blocks = list(automata(items, item_col, item_text, window, block_words))
    if len(blocks) > 1:
        return _clean_by_blocks(docs, blocks, longest_share, text_at, chars_at)
    for tables in blocks:
        held = docs.sparkSession.sparkContext.broadcast(tables)
        docs = docs.mapInArrow(_cleaner(held, longest_share, text_at, chars_at), docs.schema)
    return docs
