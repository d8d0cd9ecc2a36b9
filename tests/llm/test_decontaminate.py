import hashlib
import pickle
import re
from types import SimpleNamespace

import messy
import pyarrow as pa
import pytest
from leadgrid.llm import decontaminate
from leadgrid.llm import text as llm_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(texts, items, window=10):
    windows = {}
    for name, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(name)
    out = []
    for doc, text in texts:
        w, hit, names = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    names |= found
        names = sorted(str(x) for x in names if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items():
    base = messy.prose(1, 300)
    return [
        (1, base[200:500]), (2, messy.prose(9, 30)), (3, None), (4, "!!"), (5, "Alpha7 BETA9"), (6, "aa aa aa aa aa aa aa aa aa aa aa"),
        (None, messy.prose(2, 20)), (7, messy.prose(2, 60)), (8, "x"), (2, messy.prose(9, 30)), (9, " ".join(["p q"] * 12)),
    ]


def texts():
    more = [(20, "say ALPHA7, beta9! " + messy.prose(9, 30)), (21, "aa " * 15), (22, "q p " * 9 + "p"), (23, "beta9 alpha7 x")]
    return messy.texts() + more


@pytest.mark.parametrize("block_words", [200_000, 100, 12])
@pytest.mark.parametrize("window", [10, 3])
def test_matches_brute_force(spark, block_words, window):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = decontaminate.report(messy.frame(spark, texts()), bench, window=window, block_words=block_words)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts(), items(), window)


@pytest.mark.parametrize("block_words", [200_000, 100])
def test_clean_leaves_no_window_and_spares_the_rest(spark, block_words):
    some = [x for x in items() if x[0] not in (5, 8)]
    bench = spark.createDataFrame(some, "item_id long, text string")
    df = messy.frame(spark, texts())
    kept = decontaminate.clean(df, bench, block_words=block_words)
    assert kept.schema.simpleString() == df.schema.simpleString()
    rows = [(r.doc_id, r.text, r.n_chars) for r in kept.collect()]
    left = brute([r[:2] for r in rows], some)
    assert not any(r[5] for r in left)
    hit = {(r[0], r[1]): r[2] / max(r[1], 1) for r in brute(texts(), some) if r[5]}
    clean = [(i, t) for i, t in texts() if (i, len(words_of(t))) not in hit]
    assert all((i, t, None if t is None else len(t)) in rows for i, t in clean)
    gone = [k for k, share in hit.items() if share > 0.8]
    assert len(rows) == len(texts()) - sum((i, len(words_of(t))) in gone for i, t in texts())


def test_blocks_do_not_change_what_is_cut(spark):
    w = messy.prose(60, 60).split()
    line = lambda a, b: " ".join(w[a:b])
    some = [(1, line(0, 10)), (2, line(5, 15)), (3, line(20, 30)), (4, line(15, 20) + " " + line(30, 35)), (5, line(40, 50)), (6, line(48, 60))]
    far = messy.prose(61, 30)
    docs = [
        (1, far + " " + line(0, 15) + " " + far), (2, far + " " + line(15, 35) + " " + far), (3, line(40, 60) + " far off"),
        (4, far), (5, None), (6, line(0, 10) + " " + messy.prose(62, 11) + " " + line(20, 30)),
    ]
    bench = spark.createDataFrame(some, "item_id long, text string")
    got = [
        sorted((r.doc_id, r.text, r.n_chars) for r in decontaminate.clean(messy.frame(spark, docs), bench, block_words=n).collect())
        for n in (200_000, 12)
    ]
    assert got[0] == got[1]
    assert [(i, t) for i, t, _ in got[0]] == [(1, far + "  " + far), (2, far + "  " + far), (4, far), (5, None), (6, f" {messy.prose(62, 11)} ")]


def test_text_round_a_span_is_unchanged():
    text = b"One, two;  THREE four. Five"
    assert decontaminate.without(text, [(1, 3)]) == b"One,  four. Five"
    assert decontaminate.without(text, [(0, 5)]) == b""


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontaminate.report(messy.empty(spark), bench).collect() == []
    none = decontaminate.report(messy.frame(spark, texts()), bench.limit(0)).collect()
    assert len(none) == len(texts()) and not any(r.contaminated for r in none)
    assert decontaminate.clean(messy.frame(spark, texts()), bench.limit(0)).count() == len(texts())


def test_a_batch_is_cleaned_in_parts(monkeypatch):
    """New texts of a whole batch are never held: many parts come out, with the rows of one."""
    leak = messy.prose(99, 12)
    texts = [f"{messy.prose(n, 30)} {leak if n % 3 else ''} {messy.prose(n + 50, 9)}" for n in range(20)] + [None, "", leak]
    held = SimpleNamespace(value=pickle.dumps(decontaminate.automaton([("x", leak.encode().split())], 10)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    whole = list(decontaminate._cleaner(held, 0.8, 1, None)(iter([batch])))
    assert len(whole) == 1 and whole[0].num_rows == len(texts) - 1
    monkeypatch.setattr(llm_text, "PART_BYTES", 500)
    parts = list(decontaminate._cleaner(held, 0.8, 1, None)(iter([batch])))
    assert len(parts) > 10
    assert [row for part in parts for row in part.to_pylist()] == whole[0].to_pylist()
