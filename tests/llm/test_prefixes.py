import hashlib
import random
import zlib
from collections import defaultdict

import messy
import pytest
from leadgrid.llm import prefixes


def brute(rows):
    """The definition, with whole prefixes as keys."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])
        path = tuple(base[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        extra = (len(who) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += extra
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(who), len(p), min(members[p[:-1]]) if p else -1, len(who), children[p], leaves[p], saved[p], sha(ends[p]))
        for p, who in members.items()
    )


def nodes(spark, rows, shard=None, parts=3):
    df = spark.createDataFrame(
        [(*r, "x", 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, depth string, num long, key binary"
    )
    got = [tuple(r) for r in prefixes.trie(df.repartition(parts), shard).collect()]
    return sorted((a, b, -1 if c is None else c, *rest) for a, b, c, *rest in got)


def conversations(seed, n, ids, texts=("a", "bb", "", "Ünï", None, "c" * 50)):
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        c = pick.choice(ids)
        out += [(c, pick.choice([None, t, t, t]), pick.choice(["user", "assistant", None, ""]), pick.choice(texts)) for t in range(pick.randint(1, 9))]
    return out


@pytest.mark.parametrize("shard", [None, 3])
def test_equals_brute_force(spark, shard):
    rows = conversations(shard or 1, 60, [0, 1, 2, 7, 99, 100, 101, 150, 205, 206, -1, -100, -130, 5000, 10**12], ("a", "b"))
    rows += [(None, 1, "user", "nobody's"), *rows[:5], (300, 1, "u", "x"), (301, 1, "u", "x"), (302, 1, "u", "x"), (303, 1, "u", "x")]
    assert nodes(spark, rows, shard) == brute(rows)


def test_role_and_text_are_apart(spark):
    rows = [(1000 + i, t, r, x) for i, (r, x) in enumerate([("a", "bc"), ("ab", "c"), ("", "abc"), (None, "abc")]) for t in range(8)]
    assert nodes(spark, rows) == brute(rows)


def test_a_long_conversation_lies_in_many_tasks(spark):
    """One conversation is most rows, with equal rows among them; its chain crosses ranges and shards."""
    pick = random.Random(3)
    rows = [(7, t, "user", pick.choice("ab")) for t in range(1500)] + [(7, 2000, "user", "same")] * 500
    rows += [(c, t, "user", "ab"[t % 2]) for c in range(0, 40) for t in range(4) if c != 7]
    assert nodes(spark, rows, 64) == brute(rows)


def test_one_conversation_may_be_most_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "_IDS", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1400) for t in range(7)]
    rows += [(c, 0, "user", f"own {c}") for c in range(3000, 3060)]
    assert nodes(spark, rows, 30) == brute(rows)


def test_a_queue_that_spills(monkeypatch):
    pick = random.Random(8)
    queue, left = prefixes.SpillingQueue(16), []
    for k in range(3000):
        if pick.random() < 0.6 or not left:
            item = (pick.randint(k, k + 500), pick.randrange(50), k)
            queue.push(item)
            left.append(item)
        else:
            left.sort()
            first = left.pop(0)
            assert queue.pop_if((first[0], first[1] + 1)) is None
            assert queue.pop_if(first[:2]) == first
    assert queue.made > 10


@pytest.mark.parametrize("seed", [0, 2, 3])
def test_totals_of_trees(spark, monkeypatch, seed):
    """Any tree, numbered so that parents often lie in other shards, with queues that spill."""
    monkeypatch.setattr(prefixes, "IN_MEMORY", 8)
    pick = random.Random(seed)
    n = 400
    parent = [-1] + [pick.randrange(max(0, i - (1 if seed == 0 else 30)), i) if seed < 3 else 0 for i in range(1, n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    number = list(range(n))
    if seed == 2:
        pick.shuffle(number)
    own = [(pick.randrange(2), pick.randrange(100)) for _ in range(n)]
    want = [list(x) for x in own]
    for i in range(n - 1, 0, -1):
        want[parent[i]][0] += want[i][0]
        want[parent[i]][1] += want[i][1]
    rows = [(number[i], number[parent[i]] if i else -1, -depth[i], 1 - depth[i], *own[i]) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in prefixes._TREE))
    got = {r.num: [r.leaves, r.saved] for r in prefixes.subtree_totals(df, 10, 3).collect()}
    assert got == {number[i]: want[i] for i in range(n)}


def test_limbs_wrap_alone():
    a = prefixes._limbs(bytes(range(200, 216)))
    total = 0
    for _ in range(1000):
        total = prefixes._added(total, a)
    limbs = [int.from_bytes(bytes(range(200, 216))[k : k + 4], "big") for k in range(0, 16, 4)]
    assert total == sum((x * 1000 % 2**64) << (64 * i) for i, x in enumerate(reversed(limbs)))
    top = ((1 << 64) - 1) << 64
    assert prefixes._added(top, 1 << 64) == 0


def test_empty_and_turnless(spark):
    assert nodes(spark, [(None, 1, "user", "x")]) == []
    rows = [(c, 1, "user", "only") for c in range(1, 30)]  # bases are absent
    got = nodes(spark, rows)
    assert got == brute(rows) and got[0][1] == 0
    alone = [c for c in range(1, 30) if zlib.crc32(str(c).encode()) % 6 >= 1][:1]
    assert nodes(spark, [(alone[0], 1, "user", "x")]) == brute([(alone[0], 1, "user", "x")])
    assert messy.WORDS
