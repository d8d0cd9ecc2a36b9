"""Phrases whose words keep company, by set-oriented mining over sorted occurrence relations (SETM).

Relation R1 holds each word occurrence with its piece and position, sorted by them. Relation Rk+1 is the merge join of
the pruned Rk with itself on equal piece and adjacent position: two phrases of k words that overlap in k - 1 make one of
k + 1. Groups are counted per language, phrases below `least` are dropped, and the occurrences that are left, the
semi-join with the frequent groups, are stored before the next length. No phrase can be frequent unless both phrases it
is made of are, so counts are exact.

A stored relation is packed: one row holds the occurrences of many whole texts of one language in order of piece and
position, as codes of the phrases listed beside them, with 0 where no frequent phrase starts, such as the end of a piece.
Neighbours in the sequence thus are neighbours in a piece, and the merge join is one pass over sorted columns. Rows are
cut at text borders, after `CHUNK` bytes of text or one text, so a task's memory is bounded; a hot phrase reaches the shuffle once
for each of them. What a row counts is dealt out packed, too: by the phrases' hashes into pieces of some
`_ROWS` bytes, which Spark groups and Arrow sums. The semi-join asks a bit filter of bounded size, whose false positives only cost
occurrences of infrequent phrases that the exact counts drop again. A phrase's hash is made from those of its words, so the
filter is asked before a phrase is spelled out.

Null and empty texts have no pieces; null languages count as `und` and so join a language of that name. Repeated rows
count as often as they stand there; null ids do not matter, as ids are not read; a very long text is one row's share.
Equal scores are ordered by occurrences, then by the phrase's UTF-8 bytes. Other columns, whatever their names, are not
read. An empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadgrid.llm import bloom, skew
from leadgrid.llm.text import string_bytes, text_bytes
from leadgrid.sources.storage import stored

WORDS = 3
LEAST = 10
TOP = 2000
#: a candidate goes if a longer one that holds it has this share of its occurrences, in percent
ABSORBED = 50
UNKNOWN_LANG = "und"
#: bytes of text that a task holds, of all languages; then those of the largest one become a row
CHUNK = 3 << 19
_LANGS = 1 << 10
#: bytes of phrases, from all rows of a relation, that a group adds up at most, about
_ROWS = 1 << 24
#: no UTF-8 text holds this byte: it stands for the end of a piece
_END = b"\xff"
#: ASCII letters lower-cased, every border of a piece one and the same byte, and every border of a word
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else _END[0] if 0x0A <= b <= 0x0D or b in b".,;:!?" else 0x20 if b == 0x09 else b
    for b in range(256)
)
#: bits that a phrase's hash is rotated by for the next word
_TURN = 23
_RELATION = "lang string, items string, codes binary, size long"
_DEALT = "lang string, piece int, items string, counts binary"


def _coded(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The texts' words, and the sequence of their codes with a 0 before, between and after texts and pieces."""
    # the first token is an end mark, so that its code is 0
    raw = _END.join([b"", *texts, b""]).translate(_TABLE)
    data = np.frombuffer(raw, dtype=np.uint8)
    end, kept = data == _END[0], data != 0x20
    first = end.copy()
    first[1:] |= kept[1:] & (end[:-1] | ~kept[:-1])
    # blanks go, so that a token ends where the next one starts
    place = np.cumsum(kept, dtype=np.int32)
    offsets = np.append(place[first] - 1, place[-1])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw.translate(None, b" "))]
    tokens = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers).dictionary_encode()
    return tokens.dictionary[1:].cast(pa.string()), tokens.indices.to_numpy()


def _joined(items: pa.Array, cuts, separator: str = "\n") -> pa.Array:
    """The items from each cut to the next as one string; words hold no line feed."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items), separator)


def _split(joined: pa.Array) -> pa.Array:
    return pc.split_pattern(joined, "\n").flatten()


def _row(lang: str, items: pa.Array, codes: np.ndarray) -> pa.RecordBatch:
    counts = np.bincount(codes, minlength=len(items) + 1)[1:]
    size = (pc.binary_length(items).to_numpy().astype(np.int64) + 1) @ counts
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang], pa.string()),
            _joined(items, [0, len(items)]),
            pa.array([codes.astype("<u4").tobytes()], pa.binary()),
            pa.array([size], pa.int64()),
        ],
        ["lang", "items", "codes", "size"],
    )


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """R1: every word occurrence, in rows of `CHUNK` bytes of text at most, or one text."""
    chunk = CHUNK

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        size = 0

        def flush(lang):
            del sizes[lang]
            items, codes = _coded(held.pop(lang))
            if len(items):
                yield _row(lang, items, codes)

        for batch in batches:
            langs, text = batch.column(1).to_pylist(), None
            for text, lang in zip(batch.column(0), langs, strict=True):
                data = string_bytes(text)
                if not data:
                    continue
                if size + len(data) > chunk and sizes or len(sizes) > _LANGS:
                    most = max(sizes, key=sizes.get)
                    size -= sizes[most]
                    yield from flush(most)
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                size += len(data)
            del batch, text
            pa.default_memory_pool().release_unused()
        for lang in list(held):
            yield from flush(lang)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG))
    return docs.select(text_bytes(text_col), lang).mapInArrow(run, _RELATION)


def _turned(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(_TURN)) | (h >> np.uint64(64 - _TURN))


def _hashes(lang: str, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of phrases of equal length, as in `_hash`, and of their last words alone."""
    if not len(items):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    seed, digest = xxhash.xxh64_intdigest(lang.encode(), 42), xxhash.xxh64_intdigest
    words = _joined(items, [0, len(items)], " ")[0].as_buffer().to_pybytes().split(b" ")
    h = np.fromiter(map(digest, words, repeat(seed)), dtype=np.uint64, count=len(words)).reshape(len(items), -1)
    whole = h[:, 0]
    for i in range(1, h.shape[1]):
        whole = _turned(whole) ^ h[:, i]
    return whole, h[:, -1]


def _hash() -> Column:
    """A phrase's hash: its words' xxhash64(lang, word), all but the last turned on for each word behind."""
    turn = lambda h: F.shiftleft(h, _TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - _TURN))
    return F.aggregate(F.split("item", " ", -1), F.lit(0).cast("bigint"), lambda h, word: turn(h).bitwiseXOR(F.xxhash64("lang", word)))


def _rows(batches):
    """The rows of a relation; a batch is let go before the next one is read."""
    for batch in batches:
        for i in range(batch.num_rows):
            items = _split(batch.column("items").slice(i, 1))
            yield batch.column("lang")[i].as_py(), items, np.frombuffer(batch.column("codes")[i].as_buffer(), dtype="<u4")
            del items
        del batch
        pa.default_memory_pool().release_unused()


def _pruned(items: pa.Array, codes: np.ndarray, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The semi-join with the frequent groups: other occurrences become 0, other items go."""
    fresh = np.zeros(len(items) + 1, dtype=np.uint32)
    fresh[1:][kept] = np.arange(1, kept.sum() + 1, dtype=np.uint32)
    return items.filter(pa.array(kept)), fresh[codes]


def _neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge join with itself at the next position: where it has rows, and the places of both items."""
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    return at, codes[at].astype(np.int64) - 1, codes[at + 1].astype(np.int64) - 1


def _phrases(items: pa.Array, left: np.ndarray, right: np.ndarray) -> pa.Array:
    """The phrase of each pair of overlapping shorter ones."""
    last = pc.replace_substring_regex(items, pattern="^.* ", replacement="")
    return pc.binary_join_element_wise(items.take(pa.array(left)), last.take(pa.array(right)), " ")


def _dealt(lang: str, items: pa.Array, n: np.ndarray, hashes: np.ndarray, pieces: int) -> pa.RecordBatch:
    """Distinct items and their counts, one row for each piece that they are dealt to."""
    piece = (hashes >> np.uint64(32)) % np.uint64(pieces)
    order = np.argsort(piece.astype(np.uint16 if pieces <= 1 << 16 else np.uint32), kind="stable")
    piece = piece[order].astype(np.int32)
    cuts = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(piece)).astype(np.int32)
    joined = _joined(items.take(pa.array(order)), cuts)
    counts = [None, pa.py_buffer(4 * cuts), pa.py_buffer(n[order].astype("<u4"))]
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(lang, pa.string()), len(joined)),
            pa.array(piece[cuts[:-1]]),
            joined,
            pa.Array.from_buffers(pa.binary(), len(joined), counts),
        ],
        ["lang", "piece", "items", "counts"],
    )


def _summed(dealt: DataFrame, least: int) -> DataFrame:
    """(lang, item, f) of the items with f >= `least` occurrences."""

    def run(key, rows):
        items = _split(rows["items"].combine_chunks())
        n = np.frombuffer(b"".join(c.as_buffer() for c in rows["counts"]), dtype="<u4").astype(np.int64)
        found = pa.table({"item": items, "n": n}).group_by("item", use_threads=False).aggregate([("n", "sum")])
        found = found.filter(pc.greater_equal(found["n_sum"], least))
        return pa.table({"lang": pa.repeat(key[0], len(found)), "item": found["item"], "f": found["n_sum"]})

    return dealt.groupBy("lang", "piece").applyInArrow(run, "lang string, item string, f long")


def _pieces(relation: DataFrame) -> int:
    """A phrase one word longer is at most as long as the two that it is made of."""
    return 1 + 2 * (relation.agg(F.sum("size")).first()[0] or 0) // _ROWS


def count_words(relation: DataFrame) -> DataFrame:
    """(lang, item, f) of the items of R1."""
    pieces = _pieces(relation)

    def run(batches):
        for lang, items, codes in _rows(batches):
            n = np.bincount(codes, minlength=len(items) + 1)[1:]
            yield _dealt(lang, items, n, _hashes(lang, items)[0], pieces)

    return _summed(relation.select("lang", "items", "codes").mapInArrow(run, _DEALT), 1)


def count_longer(relation: DataFrame, bits: np.ndarray | None, least: int) -> DataFrame:
    """(lang, item, f) of the phrases one word longer than the relation's with f >= `least` occurrences.

    `bits` are those of the frequent phrases, or none if the relation is pruned."""
    pieces, held = _pieces(relation), relation.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for lang, items, codes in _rows(batches):
            whole, last = _hashes(lang, items)
            if held.value is not None:
                kept = bloom.held_in(held.value, whole)
                items, codes = _pruned(items, codes, kept)
                whole, last = whole[kept], last[kept]
            _, pair, right = _neighbours(codes)
            pair = pair * len(items) + right
            pair.sort()
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            if len(starts):
                n, pair = np.diff(starts, append=len(pair)), pair[starts]
                left, right = np.divmod(pair, len(items))
                yield _dealt(lang, _phrases(items, left, right), n, _turned(whole)[left] ^ last[right], pieces)

    return _summed(relation.select("lang", "items", "codes").mapInArrow(run, _DEALT), least)


def longer(relation: DataFrame, bits: np.ndarray | None, longer_bits: np.ndarray) -> DataFrame:
    """The pruned relation of the phrases one word longer; `bits` as in `count_longer`."""
    context = relation.sparkSession.sparkContext
    held, held_longer = context.broadcast(bits), context.broadcast(longer_bits)

    def run(batches):
        for lang, items, codes in _rows(batches):
            whole, last = _hashes(lang, items)
            if held.value is not None:
                kept = bloom.held_in(held.value, whole)
                items, codes = _pruned(items, codes, kept)
                whole, last = whole[kept], last[kept]
            at, left, right = _neighbours(codes)
            kept = bloom.held_in(held_longer.value, _turned(whole)[left] ^ last[right])
            at, pair = at[kept], pa.array(left[kept] * len(items) + right[kept]).dictionary_encode()
            longer_codes = np.zeros(len(codes), dtype=np.uint32)
            longer_codes[at] = pair.indices.to_numpy() + 1
            del at, left, right, kept, codes
            if len(pair):
                left, right = np.divmod(pair.dictionary.to_numpy(), len(items))
                yield _row(lang, _phrases(items, left, right), longer_codes)

    return relation.select("lang", "items", "codes").mapInArrow(run, _RELATION)


def _filter(frequent: DataFrame) -> np.ndarray:
    return bloom.build(frequent.select(_hash().alias("h")), bloom.slots_for(frequent.count()))


def mine(
    docs: DataFrame, longest: int = WORDS, least: int = LEAST, text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """(lang, k, item, f) of every phrase of 1 to `longest` words with f >= `least` occurrences, and (lang, n)."""
    relation = stored(occurrences(docs, text_col, lang_col), "phrases-r1")
    every = stored(count_words(relation), "phrases-words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = every.filter(F.col("f") >= least)
    found, bits = frequent.select("lang", F.lit(1).alias("k"), "item", "f"), _filter(frequent)
    for k in range(2, longest + 1):
        frequent = stored(count_longer(relation, bits, least), f"phrases-f{k}")
        found = found.unionByName(frequent.select("lang", F.lit(k).alias("k"), "item", "f"))
        if k < longest:
            relation, bits = stored(longer(relation, bits, _filter(frequent)), f"phrases-r{k}"), None
    return found, totals


def _part(words_col: str | Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words_col, first, size), " ")


def _with_part(rows: DataFrame, parts: DataFrame, side: str, count: str) -> DataFrame:
    """`rows` with the count of the part named in column `side`; one part may stand in a third of all rows."""
    rows = rows.withColumnRenamed("lang", "_lang")
    sizes = rows.groupBy("_lang", side).agg(F.count(F.lit(1)).alias("_rows"))
    named = parts.select(F.col("lang").alias("_lang"), F.col("item").alias(side), F.col("f").alias(count))
    groups = stored(named.join(sizes, ["_lang", side]), "phrases-parts")
    return skew.join_groups(rows, groups, ["_lang", side], "_rows").drop("_rows").withColumnRenamed("_lang", "lang")


def score(found: DataFrame, totals: DataFrame, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    split = F.split("item", " ", -1)
    candidates = found.filter("k > 1").select("lang", "k", F.col("item").alias("phrase"), F.col("f").alias("a"), split.alias("w"))
    cuts = candidates.select("lang", "k", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", _part("w", F.lit(1), F.col("cut")).alias("first"),
        _part("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"),
    )
    cuts = stored(cuts, "phrases-cuts")
    cuts = _with_part(stored(_with_part(cuts, found, "first", "l"), "phrases-left"), found, "rest", "r")
    # a, l and r in 14 digits: the product of the numerator has 37
    a, l, r = (F.col(c).cast("decimal(14,0)") for c in ("a", "l", "r"))
    cuts = cuts.select("lang", "phrase", "a", "l", "r", "cut", F.lit(1_000_000).cast("decimal(7,0)").alias("m"), (l * r).alias("lr"), (a * a).alias("aa"))
    cuts = cuts.withColumn("score", F.expr("cast((m * aa) div lr AS bigint)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "b.score", "b.a", "b.l", "b.r")

    # what longer candidates hold of each shorter one
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: _part("w", at, size)),
        )
    )
    inside = candidates.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < F.lit(absorbed) * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # one row a language, so a merge join without a hot side
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrases(
    docs: DataFrame, longest: int = WORDS, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The best `top` phrases of 2 to `longest` words in each language; see `score`."""
    found, totals = mine(docs, longest, least, text_col, lang_col)
    return score(found, totals, top, absorbed)
