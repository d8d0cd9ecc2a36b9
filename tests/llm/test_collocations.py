import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import messy
import numpy as np
import pyarrow as pa
import pytest
from leadgrid.llm import collocations

DELIMITERS = ".,;:!?\n\x0b\x0c\r"


def plain_pieces(text):
    out, word, piece = [], "", []
    for c in (text or "") + "\n":
        if c in DELIMITERS or c in " \t":
            if word:
                piece.append(word)
            word = ""
            if c in DELIMITERS:
                if piece:
                    out.append(piece)
                piece = []
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def brute(rows, longest, least, top, absorbed):
    """The definition, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in plain_pieces(text):
            n[lang] += len(piece)
            for k in range(1, longest + 1):
                for i in range(len(piece) - k + 1):
                    f[lang][tuple(piece[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(
                len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= absorbed * a
                for q, b in candidates.items()
            ):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, rest) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, rest, n[lang], -s))
    return sorted(out)


def mined(spark, rows, **limits):
    df = spark.createDataFrame([(t, g, 1, "x", "y") for t, g in rows], "text string, lang string, n long, item string, phrase string")
    return sorted(tuple(r) for r in collocations.phrases(df.repartition(3), **limits).collect())


def prose(seed, n):
    pick = random.Random(seed)
    common = ["New York", "the", "of", "state of", "Ünï", "日本", "a", "city hall", "x y z"]
    return "".join(pick.choice(common) + pick.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for _ in range(n))


@pytest.mark.parametrize("longest,least,top,absorbed", [(3, 10, 2000, 50), (3, 3, 7, 50), (2, 2, 50, 100), (5, 2, 400, 30)])
def test_equals_brute_force(spark, longest, least, top, absorbed):
    rows = [(prose(i, 60), pick) for i, pick in enumerate(["en", "de", None, "und", ""] * 4)]
    rows += [(t, "en") for _, t in messy.texts() if t is None or len(t) < 5000] + [(None, None), ("", "fr"), (" . \n", "fr")]
    rows += rows[:3]
    got = mined(spark, rows, longest=longest, least=least, top=top, absorbed=absorbed)
    assert got == brute(rows, longest, least, top, absorbed) and got


def test_rows_of_a_relation_change_nothing(spark, monkeypatch):
    rows = [(prose(i, 80), "en" if i % 3 else "de") for i in range(30)]
    whole = mined(spark, rows, least=3)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    monkeypatch.setattr(collocations, "_ROWS", 7)
    assert mined(spark, rows, least=3) == whole == brute(rows, 3, 3, collocations.TOP, collocations.ABSORBED)


def test_false_positives_of_the_filter_change_nothing(spark, monkeypatch):
    rows = [(prose(i, 60) + messy.prose(i, 30), "en") for i in range(12)]
    monkeypatch.setattr(collocations.bloom, "held_in", lambda bits, hashes: hashes == hashes)
    assert mined(spark, rows, least=4) == brute(rows, 3, 4, collocations.TOP, collocations.ABSORBED)


def test_one_phrase_may_be_most_words(spark):
    rows = [("same words " * 3000, "en")] * 20 + [(f"own{i} words. same own{i}", "en") for i in range(300)] + [("rare pair. " * 10, "en")]
    got = mined(spark, rows)
    assert got == brute(rows, 3, 10, 2000, 50)
    assert ("en", 1, "rare pair", 10, 10, 10) in [r[:6] for r in got]


def test_scores_are_exact_past_64_bits(spark):
    a, left, rest = 9_000_000_000_001, 9_999_999_999_999, 9_000_000_000_003
    found = spark.createDataFrame(
        [("en", 1, "p", left), ("en", 1, "q", rest), ("en", 2, "p q", a)], "lang string, k int, item string, f long"
    )
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    assert [tuple(r) for r in collocations.score(found, totals).collect()] == [
        ("en", 1, "p q", a, left, rest, 10**14, 1_000_000 * a * a // (left * rest))
    ]


def test_cut_ties_go_to_the_first(spark):
    rows = [("p q r", "en")] * 10
    assert mined(spark, rows) == brute(rows, 3, 10, 2000, 50) == [("en", 1, "p q r", 10, 10, 10, 30, 1_000_000)]


def test_empty(spark):
    assert mined(spark, [(None, "en"), ("one word. only", "en")]) == []
    assert collocations.phrases(messy.empty(spark)).collect() == []


class Here:
    """A stored relation whose tasks run in this process."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))

    def __init__(self, relation):
        self.relation = relation

    def select(self, *columns):
        return Here(self.relation.select(*columns))

    def mapInArrow(self, run, schema):
        return list(run(iter(self.relation.toArrow().to_batches())))


def test_only_phrases_that_may_be_frequent_are_spelled_out(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(["a b c", *(f"x{i} y{i} z" for i in range(500))]), "en")], "text string, lang string")
    relation = collocations.occurrences(docs)
    words = spark.createDataFrame([("en", w) for w in ["a", "b", "z", *(f"{c}{i}" for c in "xy" for i in range(500))]], "lang string, item string")
    pairs = spark.createDataFrame([("en", "a b"), ("en", "x7 y7")], "lang string, item string")
    spelled, join = [], collocations.pc.binary_join_element_wise
    monkeypatch.setattr(collocations.pc, "binary_join_element_wise", lambda *a: spelled.extend(join(*a).to_pylist()) or join(*a))
    rows = collocations.longer(Here(relation), collocations._filter(words), collocations._filter(pairs))
    # the filter may let some more through; 1,500 pairs stand side by side
    assert {"a b", "x7 y7"} <= set(spelled) and len(spelled) < 100
    assert sum(len(r.column("items")[0].as_py().split("\n")) for r in rows) == len(spelled)


@pytest.mark.parametrize("lang", ["en", "", "日本"])
def test_filters_are_asked_for_the_hashes_they_hold(spark, lang):
    pick = random.Random(5)
    for k in (1, 2, 4):
        items = sorted({" ".join(pick.choice(["a", "b", "Ünï", "日本", "\x1c", "\u00a0é"]) for _ in range(k)) for _ in range(50)})
        df = spark.createDataFrame([(lang, i) for i in items], "lang string, item string")
        told = dict(tuple(r) for r in df.select("item", collocations._hash()).collect())
        whole, last = collocations._hashes(lang, pa.array(items))
        assert whole.view(np.int64).tolist() == [told[i] for i in items]
        assert last.tolist() == collocations._hashes(lang, pa.array([i.split(" ")[-1] for i in items]))[0].tolist()


def test_codes_are_the_words_of_pieces():
    texts = [t for _, t in messy.texts() if t and len(t) < 5000] + ["\tTab\t\ttab. .;\x0b  a\u00a0b\x00C ", "...", " "]
    items, codes = collocations._coded([t.encode() for t in texts])
    found = " ".join(["."] + [items[int(c) - 1].as_py() if c else "." for c in codes]).split(" ")
    wanted = [word for t in texts for piece in plain_pieces(t) for word in [*piece, "."]]
    squeezed = [w for w, before in zip(found[1:], found) if w != "." or before != "."]
    assert squeezed == wanted
