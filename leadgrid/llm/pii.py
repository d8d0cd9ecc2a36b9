"""Personal data: formats with checks, and identifiers that their contexts give away.

Formats (email, ip, card, phone) are found by regular expressions; where a text is cut at the matches, the lengths of
the pieces give the places. Beyond these, contexts are bootstrapped: tokens that look like identifiers are instances,
the word and signs before them are patterns, and instances that a format has found are the seeds. In each round a
pattern's confidence is the share of its instances that are trusted, and instances that trusted patterns surround
become trusted themselves; those that no format knows are returned with kind `id`.

All of it is DataFrame code. Places are code points, ends exclusive. Null texts are empty; rows are returned once each,
also if ids repeat or are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadgrid.llm import skew
from leadgrid.sources.storage import stored

# The formats. Possessive quantifiers and the looks behind keep the matches of the plain expressions
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+                               \+[0-9][\x20().0-9-]+[0-9]
# and need no backtracking over long texts: a match starts where a run of its first characters does, or where the
# match before it has ended.
FORMATS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
KINDS = [kind for kind, _ in FORMATS]
_IN_TOKEN = "A-Za-z0-9._%+@/-"
#: a run of token characters with a digit
TOKEN = rf"(?<![{_IN_TOKEN}])[{_IN_TOKEN}]*[0-9][{_IN_TOKEN}]*+"
#: characters before a token that its pattern is taken from
_CONTEXT = 32

ROUNDS = 3
#: a pattern is trusted from so many trusted instances and such a share of them
SUPPORT = 5
CONFIDENCE = 0.8
#: an instance is trusted from this probability, patterns being independent evidence
TRUST = 0.9
_CERTAIN = 0.98


def _guard(kind: str, text: Column) -> Column:
    """False only where the format has no valid match; cheap."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": text.contains("+"),
    }[kind]


def _valid(kind: Column, match: Column) -> Column:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    luhn = F.aggregate(
        F.transform(
            F.split(F.reverse(F.when(n <= 19, digits).otherwise(F.lit("1"))), ""),
            lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")),
        ),
        F.lit(0),
        lambda total, d: total + F.coalesce(d, F.lit(0)),
    )
    return (
        F.when(kind == KINDS.index("email"), F.lit(True))
        .when(kind == KINDS.index("ip"), match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == KINDS.index("card"), n.between(13, 19) & (luhn % 10 == 0))
        .otherwise(n.between(9, 15))
    )


def _cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each row the matches of every format and of TOKEN, each with the piece of text before it."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    kind = "array<struct<match:string,gap:int,before:string>>"

    def found(pattern: str, context: bool) -> Column:
        gaps = F.transform(
            F.split("text", pattern, -1),
            lambda p: F.struct(F.length(p).alias("gap"), (F.right(p, F.lit(_CONTEXT)) if context else F.lit("")).alias("before")),
        )
        # the piece after the last match has none
        return F.zip_with(
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), gaps,
            lambda m, g: F.struct(m.alias("match"), g["gap"].alias("gap"), g["before"].alias("before")),
        )

    columns = [
        F.when(_guard(name, F.col("text")), found(pattern, False)).otherwise(F.array().cast(kind)).alias(name)
        for name, pattern in FORMATS
    ]
    # a token that looks like an identifier has four digits, so a text with fewer has none
    digits = F.col("text").rlike(r"\A(?:[^0-9]*+[0-9]){4}")
    tokens = F.when(digits, found(TOKEN, True)).otherwise(F.array().cast(kind)).alias("token")
    return stored(rows.select("doc_id", "row", *columns, tokens), "pii-matches")


def _placed(cut: DataFrame) -> DataFrame:
    """(row, kind, match, before, start, end): valid matches of the formats by their index, and tokens after them."""
    every = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).alias("found")) for i, k in enumerate([*KINDS, "token"])))
    lists = cut.select("row", F.explode(every).alias("x")).select("row", "x.kind", F.posexplode("x.found").alias("at", "m"))
    rows = lists.filter(F.col("m.match").isNotNull()).select("row", "kind", "at", "m.match", "m.before", "m.gap")
    upto = Window.partitionBy("row", "kind").orderBy("at")
    size = F.length("match")
    end = F.sum(F.col("gap") + size).over(upto)
    rows = rows.repartition("row").withColumn("end", end.cast("bigint")).withColumn("start", F.col("end") - size)
    token = F.regexp_replace("match", "[.%+@/_-]+$", "")
    is_token = F.col("kind") == len(KINDS)
    rows = rows.select(
        "row", "kind", "start",
        F.when(is_token, F.col("start") + F.length(token)).otherwise(F.col("end")).alias("end"),
        F.when(is_token, token).otherwise(F.col("match")).alias("match"), "before",
    )
    looks = F.col("match").rlike("(?:[^0-9]*[0-9]){4}") & (F.length("match") >= 6)
    return rows.filter(F.when(is_token, looks).otherwise(_valid(F.col("kind"), F.col("match"))))


def _with_seeds(placed: DataFrame) -> DataFrame:
    """Tokens know whether a format's span overlaps them, and their pattern."""
    base = F.col("kind") < len(KINDS)
    forth = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    known = (F.coalesce(F.max(F.when(base, F.col("end"))).over(forth), F.lit(-1)) > F.col("start")) | (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(back), F.lit(1 << 60)) < F.col("end")
    )
    # the last word before the token with the signs and blanks between; tokens without one have no pattern
    tail = F.regexp_extract(F.lower("before"), r"([^\s0-9=:;,.!?\"'()<>\[\]]+[\s=:;,.!?\"'()<>\[\]]*)$", 1)
    pattern = F.regexp_replace(tail, r"\s+", " ")
    return placed.select(
        "row", "kind", "start", "end", "match",
        F.when(~base & (pattern != ""), pattern).alias("pattern"),
        (~base & known).alias("known"),
    )


def trusted_instances(tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(match, trust) of instances that no format knows and that trusted patterns surround.

    `tokens`: (pattern, match, known). Edges of the graph are distinct, so one copied text counts once.
    """
    edges = tokens.filter("pattern is not null").groupBy("pattern", "match").agg(F.max("known").alias("known"))
    edges = stored(edges.withColumn("trust", F.col("known").cast("double")), "pii-edges")
    for _ in range(rounds):
        trusted = F.when(F.col("trust") >= TRUST, F.col("trust")).otherwise(0.0)
        patterns = (
            edges.groupBy("pattern")
            .agg(F.sum(trusted).alias("good"), F.count(F.lit(1)).alias("n"), F.sum((F.col("trust") >= TRUST).cast("int")).alias("support"))
            .withColumn("confidence", F.col("good") / F.col("n"))
            .filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        )
        patterns = stored(patterns.select("pattern", "n", "confidence"), "pii-patterns")
        doubt = F.log(1 - F.least(F.col("confidence"), F.lit(_CERTAIN)))
        scored = (
            skew.join_groups(edges.filter(~F.col("known")), patterns, ["pattern"], "n")
            .groupBy("match")
            .agg((1 - F.exp(F.sum(doubt))).alias("now"))
        )
        joined = edges.join(scored, "match", "left")
        edges = stored(
            joined.select("pattern", "match", "known", F.when(F.col("known"), F.lit(1.0)).otherwise(F.coalesce("now", F.lit(0.0))).alias("trust")),
            "pii-edges",
        )
    found = edges.filter(~F.col("known") & (F.col("trust") >= TRUST))
    return found.groupBy("match").agg(F.max("trust").alias("trust"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row.

    `spans` lists all spans as kind:start:end, by kind as in FORMATS with `id` last, then by start.
    """
    cut = _cut(docs, id_col, text_col)
    rows = stored(_with_seeds(_placed(cut)), "pii-spans")
    tokens = rows.filter(F.col("kind") == len(KINDS))
    trusted = trusted_instances(tokens.select("pattern", "match", "known"))
    unknown = tokens.filter(~F.col("known"))
    sizes = unknown.groupBy("match").agg(F.count(F.lit(1)).alias("n"))
    groups = stored(trusted.join(sizes, "match").select("match", "n"), "pii-instances")
    extra = skew.join_groups(unknown, groups, ["match"], "n")
    spans = rows.filter(F.col("kind") < len(KINDS)).select("row", "kind", "start", "end")
    spans = spans.unionByName(extra.select("row", "kind", "start", "end"))

    own = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("own"))
    names = F.array(*(F.lit(k) for k in [*KINDS, "id"]))
    joined = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    full = cut.select("doc_id", "row").join(own, "row", "left")
    full = full.withColumn("own", F.coalesce("own", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    count = lambda i: F.size(F.filter("own", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("own", lambda s: s["kind"] < len(KINDS))
    return full.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("own")).alias("spans"),
    )
