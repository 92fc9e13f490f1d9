import math
import random

import numpy as np
import pytest
from junctura.llm import near_dedup as N


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\v\f\r":
        low = low.replace(s, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if find(j) == find(i) and e is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [N.BLOCK, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows, d = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 12, 30, 90, 200]))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = word()
            rows.append((d, rng.choice([" ", "\n", "  "]).join(w)))
            d += 1
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE\x0btwo"), (905, "Äone two"), (906, "äone two"), (907, "x " * 3000), (908, "x " * 2999), (None, rows[0][1])]
    rng.shuffle(rows)
    got = N.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_chain(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each is near its neighbours, far from the others
        rows.append((i, " ".join(base[: 100 - i] + [f"n{i}x{k}" for k in range(0)] + base[100 : 200 - i // 2] + [f"t{j}" for j in range(i)])))
    got = N.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert N.components_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 7, "x", 1), (2, "a b c d e f", 8, "y", 2), (1, "a b c d e f", 7, "x", 1)], "doc_id long, text string, cid int, label string, component_id int")
    assert [tuple(r) for r in N.dedup(df).collect()] == [(1, "a b c d e f", 7, "x", 1)]
    rows = [(0, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand in this text"), (1, "other words stand in this text"), (2, None), (2, ""), (3, None), (None, "a b c d e f")]
    for repeated in (rows, rows[:3]):
        got = N.dedup(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
        want = {(0, "a b c d e f"), (1, "other words stand in this text")} | ({(2, ""), (3, "")} if len(repeated) > 3 else set())
        assert len(got) == len(want) and {(d, t or "") for d, t in got} == want
    assert N.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_union_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    for same, each in ((0, 5), (10, 4), (150, 25), (60, 60), (200, 0), (3, 2)):
        a, b = np.unique(pool[: same + each]), np.unique(np.r_[pool[:same], pool[same + each : same + 2 * each]])
        union = np.unique(np.r_[a, b])[: N.K]
        size, shared = N.union_estimate(N._filled([a[: N.K]]), N._filled([b[: N.K]]))
        assert (size[0], shared[0]) == (len(union), len(set(union.tolist()) & set(a.tolist()) & set(b.tolist())))


@pytest.mark.parametrize("star, small", [(N.STAR, N.SMALL), (3, N.SMALL), (1, 8)])
def test_hot_star(spark, monkeypatch, star, small):
    """One text near very many others, whose numbers all meet in it; parts of a star of any size give the same."""
    monkeypatch.setattr(N, "STAR", star)
    monkeypatch.setattr(N, "SMALL", small)
    edges = spark.range(1, 3000).selectExpr("id AS a", "CAST(0 AS LONG) AS b").union(spark.createDataFrame([(5000, 5001), (5001, 5002), (2999, 7000)], "a long, b long"))
    got = dict(map(tuple, N.components(edges).collect()))
    assert len(got) == 3004 and got[7000] == 0 and got[5002] == 5000 and sum(v == 0 for v in got.values()) == 3001


def test_lost_links_are_rarer_than_equal_hashes():
    near = N.PERCENT / 100
    lost = sum(math.comb(N.K, i) * near**i * (1 - near) ** (N.K - i) for i in range(N.NEED))
    assert lost < 2**-64
