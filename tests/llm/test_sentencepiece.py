import hashlib
import random
from types import SimpleNamespace

import messy
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from leadgrid.llm import sentencepiece_bpe
from leadgrid.llm import text as llm_text
from leadgrid.llm.queries import PIECE_MODEL, TOKENIZERS

PATH = f"{TOKENIZERS}/{PIECE_MODEL}"


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        raw = f.read()
    return sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepiece_bpe.read_model(raw)


def test_equals_the_library_on_odd_texts(model):
    sp, tables = model
    encode = sentencepiece_bpe.encoder(tables)
    pick = random.Random(1)
    odd = ["a", "b", "th", "e", " ", "  ", "▁", "é", "日", "本", "\n", "\t", "0", "1", ".", "ing", "😀", "́", "A", "'", "<s>", "<0x41>", "\x00", "ｱ", "\U000e0001"]
    pieces = list(tables["scores"])
    texts = ["", " ", "▁", "a" * 5000, "ab" * 3000, "  " * 700]
    texts += ["".join(pick.choice(odd) for _ in range(pick.randint(0, 24))) for _ in range(6000)]
    texts += ["".join(pick.choice(pieces) for _ in range(pick.randint(1, 8))).replace("▁", " ") for _ in range(6000)]
    texts += [pick.choice("ab el") * pick.randint(1, 300) + pick.choice(pieces) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encode(sp.normalize(text)), dtype="<u4").tolist() == sp.encode(text), repr(text[:80])


def test_small_memories_change_nothing(model, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 5)
    sp, tables = model
    encode = sentencepiece_bpe.encoder(tables)
    text = messy.prose(3, 200)
    assert np.frombuffer(encode(sp.normalize(text)), dtype="<u4").tolist() == sp.encode(text)


def test_compatible_is_remerging(model):
    _, tables = model
    pick, pieces, scores = random.Random(2), list(tables["whole"]), tables["scores"]
    ranks, splits = tables["ranks"], tables["splits"]
    known, valid = set(pieces), 0
    for _ in range(20000):
        a, b = pick.choice(pieces), pick.choice(pieces)
        if len(a) > 1 and pick.random() < 0.5:  # parts of one piece
            cut = pick.randrange(1, len(a))
            a, b = (a[:cut], a[cut:]) if {a[:cut], a[cut:]} <= known else (a, b)
        want = sentencepiece_bpe.remerge(list(a + b), scores) == [a, b]
        valid += want
        assert sentencepiece_bpe.compatible(a, b, ranks, splits) == want, (a, b)
    assert 5000 < valid < 18000


def test_documents(spark, model):
    sp, _ = model
    texts = messy.texts()
    df = messy.frame(spark, texts)
    rows = sentencepiece_bpe.encode_decode(df, PATH).collect()
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in rows), key=repr)
    want = []
    for i, t in texts:
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        want.append((i, len(ids), np.array(ids, dtype="<u4").tobytes(), sp.decode(ids)))
    assert got == sorted(want, key=repr)
    digests = sentencepiece_bpe.encode_decode(df, PATH, digests=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests), key=repr) == sorted(
        ((i, n, sha(ids), sha(t.encode())) for i, n, ids, t in want), key=repr
    )


def test_empty(spark):
    assert sentencepiece_bpe.encode_decode(messy.empty(spark), PATH).collect() == []


@pytest.mark.parametrize("digests", [False, True])
def test_a_batch_is_worked_on_in_parts(model, monkeypatch, digests):
    """Neither ids nor texts of a whole batch are held: a part comes out before the next is encoded."""
    sp, tables = model
    texts = [messy.prose(n, 40) for n in range(30)] + ["", "a" * 5000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
    seen = []
    monkeypatch.setattr(llm_text, "PART_BYTES", 1000)
    monkeypatch.setattr(sentencepiece_bpe, "encoder", lambda tables, real=sentencepiece_bpe.encoder: lambda t, one=real(tables): seen.append(t) or one(t))
    out = sentencepiece_bpe._encoding(SimpleNamespace(value=dict(tables)), digests)(iter([batch]))
    got = [next(out)]
    assert 0 < len(seen) < 10
    got += out
    assert all(sum(len(texts[i]) for i in part.column(0).to_pylist()) <= 1000 or part.num_rows == 1 for part in got)
    rows = [row for part in got for row in part.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for row, t in zip(rows, texts, strict=True):
        ids = [sp.bos_id(), *sp.encode(t), sp.eos_id()]
        raw = np.array(ids, dtype="<u4").tobytes()
        assert row["n_tokens"] == len(ids)
        if digests:
            assert row["ids_sha256"] == hashlib.sha256(raw).hexdigest() and row["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        else:
            assert row["ids"] == raw and row["decoded"] == sp.decode(ids)
