import hashlib
import random

import messy
import numpy as np
import pytest
from leadgrid.llm import substrings


def brute(texts, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, w in split:
        for a in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[a : a + window])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_contract(spark):
    got = substrings.report(messy.frame(spark, messy.texts()))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(messy.texts(), 50)


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    pick = random.Random(seed)
    passages = [[pick.choice("abc") for _ in range(pick.randint(4, 40))] for _ in range(6)]
    texts = []
    for i in range(60):
        w = []
        for _ in range(pick.randint(0, 5)):
            p = pick.choice(passages)
            a = pick.randrange(len(p))
            w += p[a : a + pick.randint(1, 30)] + [pick.choice("abcdefg")] * pick.randint(0, 3)
        texts.append((pick.randint(0, 40), " ".join(w)))
    got = substrings.report(messy.frame(spark, texts), window=8, seed=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts, 8)


def test_a_chunk_border_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_CHUNK", 64)
    hasher = substrings.Hasher()
    words = messy.prose(1, 300).encode().split()
    pieces = list(substrings.anchors(hasher, words))
    assert len(pieces) == 4 and sum(int(c.sum()) for _, _, _, c, _, _ in pieces) == 251
    got = substrings.report(messy.frame(spark, messy.texts()))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(messy.texts(), 50)


def test_one_passage_in_most_documents(spark):
    shared = messy.prose(5, 70)
    texts = [(i, f"{messy.prose(100 + i, 60)} {shared} {messy.prose(900 + i, 60)}") for i in range(150)]
    texts += [(1000 + i, messy.prose(6, 80)) for i in range(150)]
    got = substrings.report(messy.frame(spark, texts))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts, 50)


def test_kept_texts(spark):
    shared = messy.prose(5, 60)
    rows = substrings.kept_texts(messy.frame(spark, [(1, shared), (2, f"a {shared} b"), (3, "c")])).collect()
    assert [(r.doc_id, r.n_removed, r.kept) for r in rows] == [(2, 60, "a b")]


def test_run_hashes_do_not_depend_on_the_place():
    hasher = substrings.Hasher()
    h = hasher.words([b"a", b"b", b"c"] * 40)
    sums = hasher.sums(h)
    assert len(set(hasher.runs(sums, np.arange(0, 90, 3), 10).tolist())) == 1
    assert len(set(hasher.runs(sums, np.arange(3), 10).tolist())) == 3


def test_empty(spark):
    assert substrings.report(messy.empty(spark)).collect() == []
    assert substrings.kept_texts(messy.empty(spark)).collect() == []
