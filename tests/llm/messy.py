"""Small tables with everything that may be in a table: nulls, empty and very long texts, ties, repeated rows, and
columns named like those that operators make."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, fp string, h long, new string, old string, words long, size long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon phi".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randint(0, 40)) for _ in range(n))


def frame(spark, texts, parts: int = 3):
    """`texts`: (doc_id, text) pairs."""
    rows = [(i, t, "en", None, None if t is None else len(t), "r", None, "f", 1, "n", "o", 3, 7) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS).repartition(parts)


def texts():
    base = prose(1, 300)
    near = base.replace(" ", "  ", 3) + " end"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, near), (7, prose(2, 60)), (7, prose(2, 60)), (8, None),
        (None, base), (None, "only here"), (9, "word"), (10, "Ünïcode 日本 text é́ " * 3), (11, "x" * 200_000), (12, "a b " * 60_000),
        (13, base[:900] + " " + prose(3, 80)), (14, prose(4, 80) + " " + base[300:1500]), (15, "WORD"), (16, "tail\x00nul ▁ piece"),
    ]


def empty(spark):
    return frame(spark, [(1, "x")]).limit(0)
