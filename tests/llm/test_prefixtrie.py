"""Conversation prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelkit.llm import prefixtrie, queries

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """By the contract's words."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    original = {c: [(role, text) for _, _, role, _, text in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        sequence = original.get(base, [])[:h] + original[c][h:]
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append(c)
        ends[tuple(sequence)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    sha = lambda node: hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], sha(n)) for n in members
    )


def table(spark, rows):
    clashing = [(*r, "x", 7, 1) for r in rows]
    return spark.createDataFrame(clashing, "conv_id long, turn long, role string, text string, key string, depth int, n int").repartition(3)


def got(df):
    assert df.columns == list(COLUMNS) and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def randoms(seed, conversations, longest, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice("ua"), "w " * rng.randrange(texts)))
    return rows


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_prefix_trie(spark, SF)) == brute(rows)


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_random_conversations(spark, batches):
    rows = randoms(batches, 150, 12, 2)
    assert got(prefixtrie.prefix_tree(table(spark, rows), batches)) == brute(rows)


def test_shared_long_prefixes(spark):
    # deep edges that are split again and again, by keys that leave them, end in them or pass through
    rng = random.Random(4)
    spine = [("u" if i % 2 else "a", f"turn {i}") for i in range(40)]
    rows = []
    for c in range(0, 1200, 20):  # multiples of 20 keep their own turns
        cut = rng.randrange(1, 41)
        own = spine[:cut] + [("u", f"own {rng.randrange(3)}")] * rng.randrange(0, 3)
        rows += [(c, i, *t) for i, t in enumerate(own)]
    assert got(prefixtrie.prefix_tree(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "u", "first by null"), (1, 0, None, "b"), (1, 1, "a", None), (1, 1, "a", "tie"), (1, 1, "a", "tie"), (1, 1, "", ""),
        (None, 0, "u", "nobody"), (20, 0, "u", "x " * 50_000), (21, 0, "u", "only"), (22, 5, "u", ""), (-1, 0, "u", "neg"), (-1, -7, "a", "neg"),
        (40, 0, "u", "same"), (60, 3, "u", "same"), (60, 3, "u", "same"), (2**40, 0, "u", "far"), (5, 0, "", ""), (6, 0, "", ""), (7, 0, "", ""),
    ]
    assert got(prefixtrie.prefix_tree(table(spark, rows))) == brute(rows)


def test_nothing(spark):
    assert got(prefixtrie.prefix_tree(table(spark, [(None, 0, "u", "x")]).where("conv_id = 1"))) == []
    assert got(prefixtrie.prefix_tree(table(spark, [(None, 0, "u", "x")]))) == []


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SPAN", 4)
    rows = [(c, t, "u", f"{t} word" if t < 15 else f"{c} {t}") for c in (20, 40, 47, 60, 63) for t in range(30)] + [(80, None, "a", "n"), (80, None, "a", "m")]
    assert got(prefixtrie.prefix_tree(table(spark, rows))) == brute(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 20) for b in range(a + 1, 21)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefixtrie.two_fattest(F.col("a"), F.col("b")).alias("f"))
    for r in df.collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)
