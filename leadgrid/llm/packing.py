"""Packing token sequences: texts are cut and encoded, and their pieces packed into sequences of a bounded length.

A text's ids are those of a byte-level BPE tokenizer, and an end id. Texts longer than a sequence are cut from the end
into whole sequences, so only the first piece may be shorter. Whole pieces are sequences of their own; the others are
packed by best fit, longest first, and then by local search: bins with room left take a document from an emptier bin,
or exchange one for one, two for one or one for two with it, whichever fills them most. Each step moves length from an
emptier to a fuller bin, so the sum of squared fills grows and the search ends; bins that run empty are gone.

Tasks pack shards of at most about `SHARD` pieces, dealt by the hash of the row's number, so no key or group of copies
crowds one. Bins that still have room after a round give their pieces back, and the next round deals them anew
into fewer shards, until one holds them all or a round saves nothing. What reaches the driver is counts.

The ids of words between single blanks are remembered by a task: no token crosses a blank that something follows.
Null and empty texts are the end id alone; texts without blanks and very long ones are encoded whole. Repeated rows and
null or repeated ids are pieces like any other: each input row gives its own. Ties in length may go either way; the
bound and the counts of pieces do not depend on it. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.llm.text import string_bytes
from leadgrid.sources.storage import stored

SEQUENCE = 2048
END = 0
SHARD = 1 << 16
#: a bin with at most this much room is done
ROOM = 8
#: bins that others take from at a time, and how often the next ones give if none was emptied
DONORS = 64
WINDOWS = 12
#: words of a generation that a worker remembers from task to task
REMEMBERED = 150_000
_LONGEST_REMEMBERED = 48
#: Latin letters
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
# fixed values: how the byte-level kind of vocabulary cuts texts
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ROW_BITS, _SHARD_BITS = 56, 36
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", row bigint, sequence_id bigint, offset bigint, done boolean"


def merge_ranks(rules: dict) -> dict[bytes, int] | None:
    """Token bytes and ids, if ids follow the order of the merges, so that the least id is the next merge; else None."""
    vocab, merges = rules["model"]["vocab"], rules["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    first = len(vocab) - len(pairs)
    if first != 256 or any(vocab.get(a + b) != first + k for k, (a, b) in enumerate(pairs)):
        return None
    # byte-level vocabularies write bytes that are no printable Latin-1 characters as those from U+0100 on
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}


def encoder(model: str):
    """A function from a text to the bytes of its ids, little-endian unsigned 32-bit integers.

    They are those of the tokenizers library. Words of Latin letters, digits and ASCII signs are merged by tiktoken from
    the same vocabulary, which is faster; all others, and vocabularies of another kind, by the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    library = Tokenizer.from_str(model)
    rules = json.loads(model)
    added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in rules["added_tokens"]}
    at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def slow(text: str) -> bytes:
        return packed(library.encode(text, add_special_tokens=False).ids)

    ranks = merge_ranks(rules) if rules["model"]["type"] == "BPE" and rules["pre_tokenizer"] == BYTE_LEVEL and rules["normalizer"] is None else None
    if ranks is None:
        return slow
    merge = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    simple = re.compile(f"[\\x00-\\x1b\\x20-\\x7f{_LETTERS}]*").fullmatch

    def plain(text: str) -> bytes:
        return packed(merge(text)) if simple(text) else slow(text)

    # a sign ends a word's token, whatever follows it
    at_sign = re.compile(f"([{_LETTERS}]+)([.,;:!?)\"].*)", re.DOTALL).fullmatch

    class Memory(dict):
        """Two generations: what was not asked for while the younger filled up is forgotten."""

        old: dict[str, bytes] = {}

        def __init__(self, before: str):
            super().__init__()
            self.before = before

        def __missing__(self, word: str) -> bytes:
            cut = at_sign(word)
            if cut:
                return self[cut[1]] + ends[cut[2]]
            got = self.old.get(word)
            if got is None:
                got = plain(self.before + word)
            if len(word) <= _LONGEST_REMEMBERED:
                if len(self) >= REMEMBERED:
                    self.old = dict(self)
                    self.clear()
                self[word] = got
            return got

    # the ids of a blank and the word, and of what ends a word
    known, ends = Memory(" "), Memory("")
    look = known.__getitem__
    # a blank before something else than white space starts a token; Python counts more as white space than the pattern
    at_blank = re.compile(r" (?=\S)").split
    doubtful = re.compile(r" (?:\s|\Z)").search

    def part(text: str) -> bytes:
        words = at_blank(text) if doubtful(text) else text.split(" ")
        head = plain(words[0]) if words[0] else b""
        return head + b"".join(map(look, words[1:]))

    def encode(text: str) -> bytes:
        if at_added is None:
            return part(text)
        return b"".join(added[p] if p in added else part(p) for p in at_added(text) if p)

    return encode


def pieces(
    docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most `sequence` ids."""
    with open(tokenizer, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast({"model": f.read()})
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        tables = held.value
        encode = tables.get("encode") or tables.setdefault("encode", encoder(tables["model"]))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(string_bytes(text).decode("utf-8", "replace")) + last
                n = len(data) // 4
                borders = [0, *range(n % sequence or sequence, n + 1, sequence)]
                for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(memoryview(data)[4 * a : 4 * b])))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


class Bins:
    """Bins of one shard, by the numbers of their pieces."""

    def __init__(self, lengths: list[int], size: int):
        self.length, self.size = lengths, size
        self.held: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room for it."""
        by_room: list[list[int]] = [[] for _ in range(self.size + 1)]
        rooms = 0  # bit r: some bin has room r
        for i in sorted(range(len(self.length)), key=self.length.__getitem__, reverse=True):
            n = self.length[i]
            fitting = rooms >> n
            if fitting:
                room = (fitting & -fitting).bit_length() - 1 + n
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
                self.held[b].append(i)
            else:
                b, room = len(self.held), self.size
                self.held.append([i])
                self.fill.append(0)
            self.fill[b] += n
            room -= n
            if room:
                by_room[room].append(b)
                rooms |= 1 << room

    def _give(self, i: int, source: int, target: int) -> None:
        self.held[source].remove(i)
        self.held[target].append(i)
        self.fill[source] -= self.length[i]
        self.fill[target] += self.length[i]

    def _exchange(self, target: int, pool: "Pool") -> int:
        """The best step for the target, done: length gained, 0 if there is none.

        No step is longer than the target's room, and the donors are emptier, so the sum of squares grows.
        """
        room, own = self.size - self.fill[target], self.held[target]
        # one piece for none, one for one or two of the target's, two of one donor for one of the target's
        best, gives, two = at_most(pool.bits, 0, room), (), False
        for x, i in enumerate(own):
            if best == room:
                break
            n = self.length[i]
            gain = at_most(pool.bits, n, room)
            if gain > best:
                best, gives, two = gain, (i,), False
            gain = at_most(pool.pair_bits, n, room)
            if gain > best:
                best, gives, two = gain, (i,), True
            for j in own[x + 1 :]:
                gain = at_most(pool.bits, n + self.length[j], room)
                if gain > best:
                    best, gives, two = gain, (i, j), False
        if not best:
            return 0
        donor, got = pool.find(best + sum(self.length[i] for i in gives), two)
        for i in got:
            self._give(i, donor, target)
        for i in gives:
            self._give(i, target, donor)
        pool.changed(donor)
        return best

    def search(self) -> None:
        """Steps between bins with room until they empty no bin any more.

        The emptiest bins give first; while that empties none, the next ones do, up to `WINDOWS` times.
        """
        least, used, window = -(-sum(self.length) // self.size), len(self.held), 0
        while used > least and window < WINDOWS:
            open_bins = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.size), key=lambda b: (self.fill[b], b))
            low = window * DONORS
            donors = open_bins[low : low + min(DONORS, len(open_bins) // 2)]
            if not donors:
                return
            pool = Pool(self, donors)
            for b in reversed(open_bins[low + len(donors) :]):
                while self.fill[b] < self.size and self._exchange(b, pool):
                    pass
            # the donors fill each other, the emptier half the fuller
            donors = sorted((d for d in donors if self.fill[d]), key=lambda b: (self.fill[b], b))
            half = len(donors) // 2
            pool = Pool(self, donors[:half])
            for b in reversed(donors[half:]):
                while self.fill[b] < self.size and self._exchange(b, pool):
                    pass
            now = len(self.fill) - self.fill.count(0)
            used, window = now, 0 if now < used else window + 1


def at_most(bits: int, out: int, room: int) -> int:
    """The largest n from 1 to `room` for which bit `out` + n is set; 0 if none is."""
    return ((bits & ((2 << (out + room)) - 1)) >> (out + 1)).bit_length()


class Pool:
    """The lengths that the donors can give, alone or in pairs of one donor, as bits."""

    def __init__(self, bins: Bins, donors: list[int]):
        self.all, self.donors = bins, donors
        self.own: dict[int, tuple[int, int]] = {d: self._of(d) for d in donors}
        self._join()

    def _of(self, donor: int) -> tuple[int, int]:
        counts = Counter(self.all.length[i] for i in self.all.held[donor])
        single = sum(1 << n for n in counts)
        double = 0
        for n, k in counts.items():
            double |= (single if k > 1 else single ^ (1 << n)) << n
        return single, double

    def _join(self) -> None:
        self.bits = self.pair_bits = 0
        for single, double in self.own.values():
            self.bits |= single
            self.pair_bits |= double

    def find(self, length: int, two: bool) -> tuple[int, tuple[int, ...]]:
        """The first donor, the emptiest when the pool was made, that has this length, and its pieces."""
        donor = next(d for d in self.donors if self.own[d][two] >> length & 1)
        held, n = self.all.held[donor], self.all.length
        if not two:
            return donor, (next(i for i in held if n[i] == length),)
        at: dict[int, int] = {}
        for i in held:
            if length - n[i] in at:
                return donor, (at[length - n[i]], i)
            at[n[i]] = i
        raise AssertionError("a pair was promised")

    def changed(self, donor: int) -> None:
        self.own[donor] = self._of(donor)
        self._join()


def pack_lengths(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Numbers of the pieces in each bin; lengths are from 1 to `size`."""
    bins = Bins(lengths, size)
    bins.best_fit()
    bins.search()
    return [held for held in bins.held if held]


def _round(rows: DataFrame, number: int, shards: int, size: int, room: int) -> DataFrame:
    """One round: each row with its sequence, its place there, and whether the sequence is done."""

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("row", ignore_index=True)
        lengths = shard["length"].tolist()
        base = (number << _ROW_BITS) | (int(shard["shard"].iloc[0]) << (_ROW_BITS - _SHARD_BITS))
        sequence, offset, done = (np.zeros(len(lengths), dtype=t) for t in (np.int64, np.int64, bool))
        for b, held in enumerate(pack_lengths(lengths, size)):
            at = 0
            for i in held:
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
            done[held] = size - at <= room
        return shard.drop(columns="shard").assign(sequence_id=sequence, offset=offset, done=done)

    shard = F.pmod(F.xxhash64(F.col("row"), F.lit(number)), F.lit(shards)).alias("shard")
    dealt = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "row", shard)
    return dealt.groupBy("shard").applyInPandas(pack, PACKED)


def pack(pieces: DataFrame, size: int = SEQUENCE, shard: int = SHARD, room: int = ROOM) -> DataFrame:
    """The pieces with `sequence_id` and `offset`, in few sequences of at most `size` ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = [*names, "sequence_id", "offset"]
    rows = stored(pieces.select(*names, F.monotonically_increasing_id().alias("row")), "packing-pieces")
    whole = rows.filter(F.col("length") >= size)
    packed = whole.select(*names, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, number, before = rows.filter(F.col("length") < size), 1, None
    while True:
        n = left.count()
        if n == 0:
            return packed
        # a round that closes too few bins is the last: dealing the same pieces again would not help
        last = n <= shard or (before is not None and 4 * n > 3 * before)
        tried = stored(_round(left, number, -(-n // shard), size, room), f"packing-round{number}")
        if last:
            return packed.unionByName(tried.select(*out))
        packed = packed.unionByName(tried.filter("done").select(*out))
        left, before, number = tried.filter(~F.col("done")).select(*names, "row"), n, number + 1


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every text."""
    return pack(pieces(docs, tokenizer, size, END, id_col, text_col), size, shard)
