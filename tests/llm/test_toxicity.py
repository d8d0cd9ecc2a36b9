import random

import messy
import pytest
from leadgrid.llm import toxicity
from leadgrid.llm.toxicity import Fuzzy, Lexicon


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_match(terms, word):
    best = None
    for term, (weight, stem) in terms.items():
        ends = [word] if not stem else [word[:n] for n in range(len(word) + 1)]
        e = min(distance(term, x) for x in ends)
        if e <= toxicity.edits(term) and (best is None or (e, -weight, term) < best):
            best = (e, -weight, term)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_plain_distance(seed):
    pick = random.Random(seed)
    make = lambda a, b: "".join(pick.choice("abcd") for _ in range(pick.randint(a, b)))
    terms = {make(3, 11): (float(pick.randint(1, 9)), pick.random() < 0.4) for _ in range(25)}
    fuzzy = Fuzzy(Lexicon(terms))
    words = ["", *(make(0, 13) for _ in range(1500))]
    for term in terms:  # close ones
        for _ in range(20):
            w = list(term)
            for _ in range(pick.randint(1, 3)):
                at = pick.randint(0, len(w))
                w[at : at + pick.randint(0, 1)] = pick.choice(["", "a", "b", "x"])
            words.append("".join(w))
    for w in words:
        assert fuzzy.match(w) == plain_match(terms, w), (w, terms)


def test_quoted_hits_are_told_apart():
    features = toxicity.featurizer(Lexicon({"moron": (8.0, False)}))
    names = dict(zip(toxicity.FEATURES, features(b"you moron"), strict=True))
    quoted = dict(zip(toxicity.FEATURES, features(b'the word in "that moron" here'), strict=True))
    said = dict(zip(toxicity.FEATURES, features(b"he said moron"), strict=True))
    near = dict(zip(toxicity.FEATURES, features(b"you mor0n and morron"), strict=True))
    assert names["plain"] > 0 and names["quoted"] == 0
    assert quoted["plain"] == said["plain"] == 0 and quoted["quoted"] > 0 and said["quoted"] > 0
    assert quoted["window"] < names["window"] and near["near"] > 0 and near["plain"] == 0
    marked = dict(zip(toxicity.FEATURES, features("so “moron” it".encode()), strict=True))
    assert marked["quoted"] > 0 and marked["plain"] == 0
    assert features(b"") == features(b"clean words") == [0.0] * len(toxicity.FEATURES)


def corpus(n=700):
    pick, texts, labels = random.Random(5), [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = messy.prose(1000 + i, 40).split()
        if toxic:
            for _ in range(4):
                words.insert(pick.randrange(len(words)), pick.choice(["vilewort", "grotbag", "snidelout" + pick.choice(["s", "ing", "ed", "ish"])]))
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return texts, labels


def test_learns_and_scores_held_out_rows(spark):
    texts, labels = corpus()
    docs, marks = messy.frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    rows = toxicity.score(docs, model).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(texts) and len(held) > 80
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted == 0)


def test_held_out_labels_teach_nothing(spark):
    texts, labels = corpus(200)
    docs = messy.frame(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    other = marks.withColumn("toxic", (toxicity.held_out().cast("int") * (1 - marks.toxic) + (1 - toxicity.held_out().cast("int")) * marks.toxic).cast("int"))
    a, b = toxicity.learn(docs, marks), toxicity.learn(docs, other)
    assert a.lexicon.terms == b.lexicon.terms and list(a.weights) == list(b.weights)


def test_odd_rows_and_empty_tables(spark):
    texts, labels = corpus(300)
    docs = messy.frame(spark, texts + messy.texts())
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (7, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) + len(messy.texts()) and all(r.score is not None and r.held_out is not None for r in rows)
    assert toxicity.score(messy.empty(spark), model).collect() == []
    untaught = toxicity.learn(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, untaught).collect()} == {0.0}
    assert toxicity.keep_clean(docs, untaught).count() == docs.count()
    assert toxicity.score(docs, toxicity.learn(messy.empty(spark), marks)).count() == docs.count()
