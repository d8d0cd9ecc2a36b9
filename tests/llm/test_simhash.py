import random

import messy
import pytest
import xxhash
from leadgrid.llm import components, simhash


def plain_fingerprint(text, k=3):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps, bits):
    """The smallest id that each of the (id, fingerprint) pairs reaches."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    texts = messy.texts()
    fps = [(i, plain_fingerprint(t)) for i, t in texts]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, components_of(fps, 2), strict=True)), key=repr)
    got = simhash.near_duplicates(messy.frame(spark, texts)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def planted(seed, n):
    """Fingerprints with many close ones, and many that share a segment."""
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        kind = pick.random()
        if out and kind < 0.5:
            fp = pick.choice(out)
            for _ in range(pick.randint(1, 4)):
                fp ^= 1 << pick.randrange(64)
        elif out and kind < 0.7:
            fp = pick.choice(out) & 0xFFFFFFFF | pick.getrandbits(32) << 32
        else:
            fp = pick.getrandbits(64)
        out.append(fp)
    return out


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("pairs_up_to", [1, 4, 64])
def test_no_link_is_lost(spark, bits, pairs_up_to):
    if bits == 3 and pairs_up_to == 1:
        pytest.skip("every variant goes on by thousands of finer keys: too slow for a test")
    fps = list(enumerate(planted(bits, 250)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps]
    groups = simhash.cluster(spark.createDataFrame(signed, "doc_id long, fp long"), bits, pairs_up_to)
    got = {r.fp: r.component_id for r in groups.collect()}
    assert [got[f] for _, f in signed] == components_of(fps, bits)


def test_keep_one(spark):
    texts = messy.texts()
    df = messy.frame(spark, texts)
    fps = [(i, plain_fingerprint(t)) for i, t in texts]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    comps = components_of(fps, 2)
    nameless = sum(c is None for c in comps)  # "only here" has no other
    assert sorted(i for i in ids if i is not None) == sorted({c for c in comps if c is not None})
    assert ids.count(None) == nameless == 1


def test_empty(spark):
    assert simhash.near_duplicates(messy.empty(spark)).collect() == []
    assert simhash.keep_one(messy.empty(spark)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    pick = random.Random(7)
    edges = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(1000, i) for i in range(100)],
        "random": [(pick.randrange(300), pick.randrange(300)) for _ in range(200)],
        "none": [],
    }[shape]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
