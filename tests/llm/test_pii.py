import hashlib
import random
import re

import messy
import pytest
from leadgrid.llm import pii

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def valid(kind, match):
    digits = [int(c) for c in re.sub("[^0-9]", "", match)]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def base_of(text):
    text, need = text or "", {"email": "@", "ip": ".", "phone": "+"}
    # without its sign a format has no match, and the plain expression would search a long run from every start
    return [(k, m.start(), m.end()) for k, r in PLAIN if need.get(k, "") in text for m in r.finditer(text) if valid(k, m.group())]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def check(spark, texts):
    rows = pii.find(messy.frame(spark, texts)).collect()
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows), key=repr)
    want = [(i, *(sum(s[0] == k for s in base_of(t)) for k in pii.KINDS), digest(base_of(t))) for i, t in texts]
    assert got == sorted(want, key=repr)
    return rows


def test_formats_match_plain_expressions(spark):
    pick = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.com", "1", "12", "255", "256", ".", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+", "+49 (30) 1234567", "é", "😀", "(", ")", "_", "%", "\n", "1.2.3.4", "..", "0", "7"]
    texts = [(i, "".join(pick.choice(parts) for _ in range(pick.randint(0, 30)))) for i in range(3000)]
    check(spark, texts + messy.texts())


def test_very_long_texts(spark):
    texts = ["a" * 200_000 + "@b.c", "1 " * 60_000, "1." * 60_000, "a@" + "b." * 30_000 + "c", "+1" + "(" * 100_000, "x@y.com " * 20_000, "9" * 100_000]
    check(spark, list(enumerate(texts)))


def test_contexts_discover_unseen_identifiers(spark):
    # seeds: emails after two contexts; the same contexts hold account numbers that no format knows
    texts = [(i, f"please reach member: user{i:04d}@mail.example and later contact: person{i:04d}@mail.example now") for i in range(40)]
    texts += [(100 + i, "member: AB-12345678 then contact: AB-12345678 end") for i in range(2)]
    texts += [(200, "serial: XY-99887766 and part: XY-99887766"), (201, "member: AB-5"), (202, "member: nothing here")]
    rows = {r.doc_id: r for r in pii.find(messy.frame(spark, texts)).collect()}
    assert rows[100].spans == "id:8:19,id:34:45" and rows[101].spans == rows[100].spans
    assert all(rows[i].spans == "" for i in (200, 201, 202))
    assert rows[0].n_email == 2 and "id" not in rows[0].spans


@pytest.mark.parametrize("name", ["AB12-CD34", "12-34-56", "a1b2c3d4e5"])
def test_identifiers_without_a_run_of_digits(spark, name):
    texts = [(i, f"please reach member: user{i:04d}@mail.example and later contact: person{i:04d}@mail.example now") for i in range(40)]
    plain = f"member: {name} then contact: {name} end"
    texts += [(100, plain), (101, plain + " 123"), (102, plain + " 1.5")]
    rows = {r.doc_id: r.spans for r in pii.find(messy.frame(spark, texts)).collect()}
    assert rows[100].count("id:") == 2 and rows[100] == rows[101] == rows[102]


def test_no_python_runs(spark):
    plan = pii.find(messy.frame(spark, messy.texts()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("texts", [[], [(1, None)], [(None, "a@b.co"), (None, "a@b.co")]])
def test_small_tables(spark, texts):
    df = messy.frame(spark, texts) if texts else messy.empty(spark)
    assert [r.n_email for r in pii.find(df).collect()] == [len(base_of(t)) for _, t in texts]
