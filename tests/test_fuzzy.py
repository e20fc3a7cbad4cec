"""The exact fuzzy top-k against all pairs."""

import random

import pytest

from panelkit.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a, b):
    a, b = a.lower(), b.lower()
    return 100 * (1 - distance(a, b) / max(len(a), len(b), 1))


def brute(names, candidates, k):
    out = []
    for name in {n for n in names if n is not None}:
        best = sorted(((-score(name, c), c) for c in {c for c in candidates if c is not None}))[:k]
        out += [(name, i, c, -s) for i, (s, c) in enumerate(best, 1)]
    return sorted(out)


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def check(spark, names, candidates, k=5, **bounds):
    got = fuzzy.top(column(spark, "name", names), column(spark, "candidate", candidates), k, **bounds).collect()
    want = brute(names, candidates, k)
    assert sorted((r.name, r["rank"], r.candidate) for r in got) == [w[:3] for w in want]
    assert [s for *_, s in sorted((r.name, r["rank"], r.score) for r in got)] == pytest.approx([w[3] for w in want])


def test_candidate_without_a_common_pair_wins(spark):
    # five candidates share the pair "ab"; the best one shares no pair at all
    check(spark, ["abc"], ["axc"] + [f"abzzzzzzzz{i}" for i in range(5)])


@pytest.mark.parametrize("seed,letters,longest", [(1, "ab", 6), (2, "abcdefgh", 9), (3, "abcdefghijklmnopqrstuvwxyz", 14)])
def test_random_names(spark, seed, letters, longest):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(0, longest)))
    check(spark, [word() for _ in range(40)], [word() for _ in range(120)], budget=10, part=7)


def test_edited_names(spark):
    rng = random.Random(4)
    places = ["".join(rng.choice("aeioubrtknslp") for _ in range(rng.randrange(4, 16))).capitalize() for _ in range(150)]

    def edited(x):
        x = list(x)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "h", " ", "A"])
        return "".join(x)

    check(spark, [edited(rng.choice(places)) for _ in range(50)], places, k=3, part=20)


def test_few_candidates_ties_and_nulls(spark):
    check(spark, ["a", "a", None, "", "zzz", "Ä"], ["b", "c", "b", None, "", "ä"], k=5)
    check(spark, ["Bara Banki"], ["Barabanki", "Bareilly", "Agra"], k=2)
    check(spark, ["xyz"], [f"ab{i}" for i in range(10)], k=5)  # nothing in common: the first ones by name
    check(spark, ["abc"], [None], k=5)
    check(spark, [None], ["abc"], k=5)
