"""Toxicity scores: a lexicon learnt from labels, matched with misspellings, and weighed by its context.

Lexicon: words, and stems that words of a class begin with, which occur far more often in documents labelled toxic.
Matching: Levenshtein automata intersected with a trie of the lexicon. A state holds the trie nodes that a word's
characters so far can reach with their fewest edits; the states that occur are made once and remembered, so a word costs
one step for each character until nothing can match any more. Short terms allow no edit, longer ones one or two.
Context: hits are weighed in windows of words. A hit inside quotation marks, or close after a word of reporting, counts
as quoted, and the classifier sees quoted and plain hits apart.

The lexicon and the classifier learn from a sample of labelled rows, `SAMPLE` at most for both, by the order of a hash;
each learns from its own half. Scores use the text only. Rows with a null label teach nothing. Null texts count as
empty; an empty text has a score like any other. Without labels, or with one class only, every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgrid.llm.text import alnum_words, string_bytes, text_bytes

#: labelled rows that the lexicon and the classifier learn from
SAMPLE = 40_000
#: terms in the lexicon
TERMS = 2_000
STEMS = (4, 5, 6)
LEAST_DOCS = 4
#: ... and in such a share of the toxic documents, so that what a few copies share is no term
LEAST_SHARE = 0.01
#: a term's share among toxic documents must be so many times that among others
LEAST_RATIO = 20.0
#: words on either side of a hit that make its window
REACH = 10
#: words over which a word of reporting reaches
MENTION = 4
FEATURES = ("plain", "quoted", "near", "window", "share", "weight")
_STATES = 200_000
_SEEN = 600_000

# Words that announce a quotation, in the languages of the documents.
REPORTING = frozenset(
    "said says say called calls quote quoted wrote word term sagte sagt schrieb genannt wort dit disait mot appelé dijo dice palabra llamado".split()
)

_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F\u201c-\u201e\u00ab\u00bb]+|[\"“”„«»]")
# quotation marks are not ASCII, so the fast cut into words leaves them on words
_QUOTES = "“”„«»"
_MARKS = frozenset('"' + _QUOTES)


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """Terms with their weights; a stem stands for all words that begin with it."""

    terms: dict[str, tuple[float, bool]]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[str | None] = field(default_factory=lambda: [None])
    most: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for term in self.terms:
            node = 0
            self.most[0] = max(self.most[0], edits(term))
            for ch in term:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], edits(term))
            self.ends[node] = term


class Fuzzy:
    """The product of the lexicon's trie and its Levenshtein automata, made deterministic as words need it."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._closed({0: 0}), None)
        self.dead = self._state({}, None)

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that skipping characters of a term reaches."""
        lex, todo = self.lexicon, list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for child in lex.children[node].values():
                if e <= lex.most[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        return nodes

    def _best(self, nodes: dict[int, int], stems_only: bool):
        """The term that ends here with the fewest edits; of equals the heaviest, then the first."""
        lex, best = self.lexicon, None
        for node, e in nodes.items():
            term = lex.ends[node]
            if term is not None and e <= edits(term):
                weight, stem = lex.terms[term]
                if (stem or not stems_only) and (best is None or (e, -weight, term) < best):
                    best = (e, -weight, term)
        return best

    def _state(self, nodes: dict[int, int], stem) -> int:
        """`stem`: the best stem that the word has already begun with."""
        begun = self._best(nodes, stems_only=True)
        if begun is not None and (stem is None or begun < stem):
            stem = begun
        key = (frozenset(nodes.items()), stem)
        number = self.numbers.get(key)
        if number is None:
            ends = self._best(nodes, stems_only=False)
            result = min((x for x in (ends, stem) if x is not None), default=None)
            number = self.numbers[key] = len(self.states)
            self.states.append((nodes, stem, result))
            self.steps.append({})
        return number

    def _step(self, number: int, ch: str) -> int:
        lex, (nodes, stem, _) = self.lexicon, self.states[number]
        after: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= lex.most[node] and e < after.get(node, 99):
                after[node] = e

        for node, e in nodes.items():
            reach(node, e + 1)  # a character too many
            for c, child in lex.children[node].items():
                reach(child, e + (c != ch))
        to = self.steps[number][ch] = self._state(self._closed(after), stem)
        return to

    def match(self, word: str) -> tuple[int, float, str] | None:
        """(edits, -weight, term) of the closest term, if any is close enough."""
        if len(self.states) > _STATES:
            self.clear()
        state = self.start
        for ch in word:
            state = self.steps[state].get(ch) or self._step(state, ch)
            if not self.states[state][0]:
                break
        return self.states[state][2]


def tokens(text: str) -> list[str]:
    """Words and quotation marks."""
    return _TOKEN.findall(text.lower())


def word_of(raw: bytes) -> str:
    """A word as it is matched, from a word of `alnum_words`."""
    return raw.decode("utf-8", "replace").lower().strip(_QUOTES)


def featurizer(lexicon: Lexicon):
    """A function from a text to the values of FEATURES."""
    fuzzy = Fuzzy(lexicon)

    class Seen(dict):
        def __missing__(self, raw: bytes):
            if len(self) > _SEEN:
                self.clear()
            got = self[raw] = fuzzy.match(word_of(raw))
            return got

    match = Seen().__getitem__

    def features(data: bytes) -> list[float]:
        if not lexicon.terms or not any(map(match, alnum_words(data))):
            return [0.0] * len(FEATURES)
        at, quote, mention, hits = 0, False, -MENTION - 1, []
        for token in tokens(data.decode("utf-8", "replace")):
            if token in _MARKS:
                quote = token not in "”»" and (token in "“„«" or not quote)
                continue
            if token in REPORTING:
                mention = at
            found = match(token.encode())
            if found:
                hits.append((at, found[0], -found[1], quote or at - mention <= MENTION))
            at += 1
        weigh = lambda h: h[2] * (0.5 if h[1] else 1.0) * (0.3 if h[3] else 1.0)
        window, low = 0.0, 0
        for i, hit in enumerate(hits):
            while hits[low][0] < hit[0] - REACH:
                low += 1
            window = max(window, sum(weigh(h) for h in hits[low : i + 1][-4 * REACH :]))
        exact = [h for h in hits if not h[1]]
        return [
            math.log1p(sum(not h[3] for h in exact)),
            math.log1p(sum(h[3] for h in exact)),
            math.log1p(len(hits) - len(exact)),
            min(window, 30.0) / 10,
            min(len(exact) / max(at, 1), 0.2) * 10,
            max((h[2] for h in exact), default=0.0) / 5,
        ]

    return features


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning; not so without an id, but labels without one teach nothing either."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic, half) of a sample of labelled rows. Equal texts count once, or a copied text's words would all be
    telling; of several labels of an id or a text the largest counts."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    # at most `sample` rows
    rows = rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.xxhash64("text").alias("h"))
    rows = rows.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.select("text", "toxic", (F.pmod(F.shiftright("h", 5), F.lit(2)) == 0).alias("half"))


def learn_lexicon(rows: DataFrame, terms: int = TERMS) -> Lexicon:
    """Counts documents with each word and stem by class, and keeps those that are telling."""
    kinds = "term string, stem boolean, toxic bigint, clean bigint"

    def count(batches):
        n = ({}, {})
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {w for w in map(word_of, set(alnum_words(text.as_buffer().to_pybytes()))) if len(w) > 2}
                own = {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) >= k} | {("", False)}
                side = n[1 if toxic else 0]
                for key in own:
                    side[key] = side.get(key, 0) + 1
        keys = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.bool_()),
                pa.array([n[1].get(k, 0) for k in keys], pa.int64()),
                pa.array([n[0].get(k, 0) for k in keys], pa.int64()),
            ],
            ["term", "stem", "toxic", "clean"],
        )

    counted = rows.select("text", "toxic").mapInArrow(count, kinds).groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    telling = (
        counted.filter((F.col("term") == "") | ((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * 3 > F.col("clean"))))
        .orderBy(F.col("term") != "", F.desc("toxic"), "term", "stem")
        .limit(20 * terms)
        .collect()
    )
    total = next(((r.toxic, r.clean) for r in telling if r.term == ""), (0, 0))
    if not all(total):
        return Lexicon({})
    weight = lambda r: math.log((r.toxic + 0.5) / (total[0] + 1)) - math.log((r.clean + 0.5) / (total[1] + 1))
    least = max(LEAST_DOCS, LEAST_SHARE * total[0])
    good = {
        (r.term, r.stem): (weight(r), r.toxic)
        for r in telling
        if r.term and r.toxic >= least and weight(r) >= math.log(LEAST_RATIO)
    }
    # a stem that one longer stem explains adds nothing; nor do words that a chosen stem covers
    longer = Counter()
    for (term, stem), (_, toxic) in good.items():
        if stem:
            for k in STEMS:
                if k < len(term):
                    longer[term[:k]] = max(longer[term[:k]], toxic)
    stems = {t: w for (t, stem), (w, n) in good.items() if stem and longer[t] < 0.95 * n}
    shortest = {t: w for t, w in stems.items() if not any(t[:k] in stems for k in STEMS if k < len(t))}
    chosen = {t: (w, True) for t, w in shortest.items()}
    for (term, stem), (w, _) in good.items():
        if not stem and not any(term[:k] in shortest for k in STEMS):
            chosen[term] = (w, False)
    return Lexicon(dict(sorted(chosen.items(), key=lambda x: (-x[1][0], x[0]))[:terms]))


def _featured(docs: DataFrame, lexicon, kind: str):
    """`docs` has the text first; the other columns go on."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon.terms)

    def run(batches):
        features = featurizer(Lexicon(held.value))
        for batch in batches:
            rows = [features(t.as_buffer().to_pybytes()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["features", *batch.schema.names[1:]]
            )

    return docs.mapInArrow(run, kind)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """The model that scores with; what reaches the driver is bounded by `sample` and the lexicon's size."""
    rows = training_rows(docs, labels, sample, id_col, text_col, label_col)
    lexicon = learn_lexicon(rows.filter("half"))
    featured = _featured(rows.filter("not half").select("text", "toxic"), lexicon, "features array<double>, toxic int").collect()
    y = np.array([r.toxic for r in featured], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None)
    return Model(lexicon, fit(np.array([r.features for r in featured]), y))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    if model.weights is None:
        probability = F.lit(0.0)
    else:
        *w, constant = (float(x) for x in model.weights)
        z = F.lit(constant)
        for i, x in enumerate(w):
            z = z + F.col("features")[i] * x
        probability = 1 / (1 + F.exp(-z))
    rows = docs.select(text_bytes(F.col(f"`{text_col}`")).alias("text"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"))
    featured = _featured(rows, model.lexicon, "features array<double>, doc_id bigint")
    scored = featured.select("doc_id", held_out().alias("held_out"), probability.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col="text", threshold: float = 0.5) -> DataFrame:
    """The rows with scores below the threshold, columns as they were."""
    if model.weights is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast((model.lexicon.terms, [float(x) for x in model.weights]))

    at = docs.columns.index(text_col)

    def run(batches):
        terms, (*w, constant) = held.value
        features = featurizer(Lexicon(terms))
        bar = math.log(threshold / (1 - threshold))
        for batch in batches:
            toxic = (float(np.dot(features(string_bytes(t)), w)) + constant >= bar for t in batch.column(at))
            yield batch.filter(pa.array([not x for x in toxic], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
