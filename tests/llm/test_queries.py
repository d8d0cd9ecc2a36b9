"""The registered queries on the given tables, and the pipeline against its parts."""

import os

import compare
import corpus_pipeline
import messy
import numpy as np
import pytest
import sentencepiece
from leadgrid.llm import decontaminate, simhash, toxicity
from leadgrid.llm.queries import ORACLES, PIECE_MODEL, QUERIES, TOKENIZERS
from test_simhash import components_of, plain_fingerprint

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# no SQL: a learnt score, bootstrapped spans, a tokenizer, hash bits; each has a test of its own by brute force
WITHOUT_SQL = {"op1_toxicity", "op2_pii", "op3_sentencepiece", "op9_simhash", "op13_packing"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF_DIR).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    assert compare.schema_of(got) == compare.schema_of(want)
    assert compare.rows_of(got) == compare.rows_of(want)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL - {"op13_packing"}))
def test_one_row_per_document(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, SF_DIR).collect()) == ids


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept."""
    texts = messy.texts() + [(500 + i, "you vilewort " + messy.prose(i, 30) + " grotbag vilewort") for i in range(60)]
    texts += [(700 + i, messy.prose(3000 + i, 40)) for i in range(200)]
    items = [(1, messy.prose(3007, 40)[:120])]
    docs = messy.frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    sf_dir = f"file://{tmp_path}"
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, int(500 <= i < 700)) for i, _ in texts if i is not None and i >= 500], "doc_id long, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, at, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns, name
        result.write.parquet(f"{sf_dir}/out{k}")
        at = spark.read.parquet(f"{sf_dir}/out{k}")
        kept.append(sorted(((r.doc_id, r.text) for r in at.collect()), key=repr) if "text" in at.columns else at.collect())
    assert kept[0] == sorted(((i, t) for i, t in texts if i is None or not 500 <= i < 700), key=repr)
    last = {}
    for i, t in kept[0]:
        last[t or ""] = max((i for i in (i, last.get(t or "")) if i is not None), default=None)
    assert sorted(((i, t or "") for i, t in kept[1]), key=repr) == sorted(((i, t) for t, i in last.items()), key=repr)
    fps = [(i, plain_fingerprint(t)) for i, t in kept[1]]
    least = {c for c in components_of(fps, simhash.BITS) if c is not None}
    assert {i for i, _ in kept[2]} - {None} == least and len({i for i, _ in kept[2]}) == len(kept[2])
    match = decontaminate.Matcher(decontaminate.automaton([("1", items[0][1].encode().split())], 10))
    assert not any(match((t or "").encode().split())[0] for _, t in kept[3])
    assert {i for i, _ in kept[3]} >= {i for i, _ in kept[2]} - {707}
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{PIECE_MODEL}")
    final = dict(kept[3])
    assert len(kept[4]) == len(final)
    for r in kept[4]:
        ids = [sp.bos_id(), *sp.encode(final[r.doc_id] or ""), sp.eos_id()]
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids and r.decoded == sp.decode(ids)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, kept[4]))
    assert toxicity.SAMPLE > 0
