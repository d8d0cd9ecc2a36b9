import hashlib

import messy
import pytest
from leadgrid.llm import bloom, exact

import numpy as np


def expected(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return groups, keep


@pytest.mark.parametrize("slots", [None, bloom.PIECE])
def test_groups_match_brute_force(spark, slots):
    texts = messy.texts()
    groups, keep = expected(texts)
    rows = exact.groups(messy.frame(spark, texts), slots=slots).collect()
    assert len(rows) == len(texts)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text_sha256, r.keep_id, r.group_size) for r in rows)
    want = sorted(
        (i if i is not None else -1, hashlib.sha256((t or "").encode()).hexdigest(), keep[t or ""], len(groups[t or ""])) for i, t in texts
    )
    assert got == want
    # one row of each text stays, repeated rows included
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_one_text_may_be_most_rows(spark):
    texts = [(i, "same" if i % 3 else f"own {i}") for i in range(3000)]
    rows = exact.groups(messy.frame(spark, texts)).collect()
    same = [r for r in rows if r.group_size > 1]
    assert len(rows) == 3000 and len(same) == 2000
    assert {r.keep_id for r in same} == {2999} and sum(r.kept for r in rows) == 1001


def test_dedup_keeps_rows_whole(spark):
    texts = messy.texts()
    _, keep = expected(texts)
    df = messy.frame(spark, texts)
    kept = exact.dedup(df)
    assert kept.columns == df.columns and kept.schema.simpleString() == df.schema.simpleString()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i is None, i or 0, t) for t, i in keep.items())


def test_empty(spark):
    assert exact.groups(messy.empty(spark)).collect() == []
    assert exact.dedup(messy.empty(spark)).collect() == []


def test_filter_has_no_false_negatives(spark):
    df = spark.range(20_000).selectExpr("xxhash64(id % 15000) AS h")
    for column, wanted in (("seen", range(15_000)), ("again", range(5_000))):
        bits = bloom.build(df, bloom.slots_for(20_000), column)
        probed = spark.range(40_000).selectExpr("id", "xxhash64(id) AS h")
        rows = probed.withColumn("may", bloom.probe(probed, bits, probed.h)).filter("may").collect()
        found = {r.id for r in rows}
        assert set(wanted) <= found and len(found) < len(wanted) * 1.2 + 400
    assert bloom.slots_for(10**12) == bloom.MAX_SLOTS and isinstance(bits, np.ndarray)
