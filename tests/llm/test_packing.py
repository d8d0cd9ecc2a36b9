import random
import zlib
from collections import defaultdict
from itertools import product

import messy
import numpy as np
import pytest
from leadgrid.llm import packing
from leadgrid.llm.queries import BYTE_MODEL, QUERIES, TOKENIZERS
from tokenizers import Tokenizer

PATH = f"{TOKENIZERS}/{BYTE_MODEL}"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END]


def plain_pieces(ids, size):
    """(start, ids) of the pieces, cut from the end."""
    out, end = [], len(ids)
    while end > 0:
        out.append((max(0, end - size), ids[max(0, end - size) : end]))
        end -= size
    return out[::-1]


def check(rows, size):
    """Sequences hold their pieces without gaps and within the size; returns their number."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(held)


def fewest(lengths, size):
    """By trying every way, pieces in order, each into a bin in use or the next new one."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        tried = set()
        for b, room in enumerate(rooms):
            if room >= lengths[k] and room not in tried:
                tried.add(room)
                place(k + 1, [*rooms[:b], room - lengths[k], *rooms[b + 1 :]])
        place(k + 1, [*rooms, size - lengths[k]])

    place(0, [])
    return best


def test_ids_are_the_librarys(library):
    with open(PATH, encoding="utf-8") as f:
        model = f.read()
    encode = packing.encoder(model)
    pick = random.Random(4)
    odd = ["a", "b", " ", " ", "  ", "\n", "\t", "é", "1", "'s", ".", '."', "\x1c", "　", "日", "<|endoftext|>", "\x85", "​", "ß", "×", "ǅ", "😀", "\x00", "word", "ʰ"]
    texts = ["", " ", "a" * 3000, " " * 500, "ab " * 900, "x\n\n y", "it's  'll  don't "]
    texts += ["".join(pick.choice(odd) for _ in range(pick.randint(0, 16))) for _ in range(8000)]
    for text in texts:
        assert encode(text) == np.array(plain_ids(library, text)[:-1], dtype="<u4").tobytes(), repr(text[:60])


def test_small_memories_and_other_vocabularies(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        model = f.read()
    text = messy.prose(3, 300)
    want = np.array(plain_ids(library, text)[:-1], dtype="<u4").tobytes()
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    assert packing.encoder(model)(text) == want
    monkeypatch.setattr(packing, "merge_ranks", lambda rules: None)
    assert packing.encoder(model)(text) == want


def test_documents(spark, library):
    texts = messy.texts()
    rows = packing.pack_documents(messy.frame(spark, texts), PATH).collect()
    want = []
    for doc, text in texts:
        for k, (start, ids) in enumerate(plain_pieces(plain_ids(library, text), packing.SEQUENCE)):
            want.append((doc, k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(want, key=repr)
    total = sum(r.length for r in rows)
    assert -(-total // packing.SEQUENCE) <= check(rows, packing.SEQUENCE) <= -(-total // packing.SEQUENCE) + 1


def rows_of(spark, lengths, parts=3):
    df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    return df.repartition(parts)


@pytest.mark.parametrize("shard", [40, 1 << 16])
def test_rounds(spark, shard):
    """Small shards cost few sequences; every piece is packed once."""
    pick = random.Random(shard)
    lengths = [min(100, int(pick.lognormvariate(3, 1)) + 1) for _ in range(1500)] + [100] * 50 + [7] * 700
    rows = packing.pack(rows_of(spark, lengths), 100, shard, room=2).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert check(rows, 100) <= 1.04 * -(-sum(lengths) // 100)


def test_equal_lengths_end(spark):
    """Nothing can be saved: rounds end all the same."""
    rows = packing.pack(rows_of(spark, [60] * 900), 100, 40).collect()
    assert check(rows, 100) == 900


def test_near_the_fewest():
    pick = random.Random(9)
    over = 0
    for _ in range(60):
        lengths = [pick.randint(15, 60) for _ in range(11)]
        bins = packing.pack_lengths(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(11)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        over += len(bins) - fewest(lengths, 100)
    assert over <= 3


def test_search_saves_bins_and_squares_grow():
    pick = random.Random(2)
    lengths = [pick.randint(25, 55) for _ in range(3000)]
    bins = packing.Bins(lengths, 100)
    bins.best_fit()
    before, squares = len(bins.held), sum(f * f for f in bins.fill)
    bins.search()
    assert sum(f > 0 for f in bins.fill) < before and sum(f * f for f in bins.fill) > squares
    assert bins.fill == [sum(lengths[i] for i in held) for held in bins.held] and max(bins.fill) <= 100


@pytest.mark.parametrize("kind", ["move", "one for one", "two for one", "one for two"])
def test_each_step(kind):
    """A target with room 10, and a donor that can fill it in one way only."""
    own, donor, after = {
        "move": ([90], [10, 1], 100),
        "one for one": ([50, 40], [60, 3], 100),
        "two for one": ([90], [52, 48], 100),
        "one for two": ([30, 25, 35], [65, 2], 100),
    }[kind]
    lengths = own + donor
    bins = packing.Bins(lengths, 100)
    bins.held = [list(range(len(own))), list(range(len(own), len(lengths)))]
    bins.fill = [sum(own), sum(donor)]
    while bins._exchange(0, packing.Pool(bins, [1])):
        pass
    assert bins.fill[0] == after and bins.fill == [sum(lengths[i] for i in held) for held in bins.held]


def test_pairs_of_lengths():
    for own, donor in product(([70], [40, 30]), ([50, 50], [50])):
        bins = packing.Bins(own + donor, 100)
        bins.held, bins.fill = [list(range(len(own))), list(range(len(own), len(own + donor)))], [sum(own), sum(donor)]
        pool = packing.Pool(bins, [1])
        assert (pool.pair_bits >> 100 & 1) == (len(donor) == 2) and pool.bits == 1 << 50


def test_whole_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    rows = QUERIES["op13_packing"](spark, sf_dir).collect()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for k, (start, ids) in enumerate(plain_pieces(plain_ids(library, r.text), packing.SEQUENCE)):
            want.append((r.doc_id, k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(tuple(r[:5]) for r in rows) == sorted(want)
    assert check(rows, packing.SEQUENCE) <= -(-sum(r.length for r in rows) // packing.SEQUENCE) + 1


def test_empty(spark):
    assert packing.pack_documents(messy.empty(spark), PATH).collect() == []
