import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from junctura.llm import common, merkle, prefix_trie, url_filter
from junctura.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

from tests.compare import compare

NEW = ["op11_prefix_trie", "op12_merkle_manifest", "op13_url_filter"]


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) > 0


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- conversations


def trie_by_hand(rows):
    """Nodes by a dictionary of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(k) == len(n) + 1 and k[: len(n)] == n for k in members)
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = sha(",".join(str(c) for c in sorted(c for c in who if full[c] == node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids(node), sum(kids(n) == 0 for n in below), saved, ends))
    return sorted(out, key=repr)


def trie(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.withColumn("depth", F.lit("x")).withColumn("idx", F.lit(1))
    return sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df))).collect()), key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a b", "", None, "c\td e", "é\u00a0f"])))
    rows += [rows[0], rows[0], (None, 0, "user", "lost"), (40, 0, "user", "w " * 5000)]
    rows += [(c, t, "user", f"turn {t}") for c, last in ((901, 30), (902, 29), (903, 31), (904, 30)) for t in range(last)]
    return rows


def test_trie_against_whole_prefixes(spark, monkeypatch):
    rows = conversations(1, 60)
    assert trie(spark, rows, extra=True) == trie_by_hand(rows)
    monkeypatch.setattr(common, "STRETCH", 4)  # conversations of several stretches
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "FAN", 2)  # several rounds of merges
    monkeypatch.setattr(prefix_trie, "SPAN", 7)  # end lists of several ranges
    rows = conversations(2, 40)
    assert trie(spark, rows) == trie_by_hand(rows)


def test_trie_of_growing_logs_and_of_nothing(spark):
    logs = [(c, t, "user", f"t{t}") for c in range(1, 12) for t in range(c)]  # each conversation goes on from the one before
    assert trie(spark, logs) == trie_by_hand(logs)
    assert trie(spark, []) == []
    lone = [(5, 0, "user", "hi")]  # its turn is cut and nothing stands in for it, or it stays
    assert trie(spark, lone) == trie_by_hand(lone)


# --- manifest


def manifest_by_hand(docs, altered):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def up(level):
        return [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]

    def climb(level, i):
        """The steps of node i, and the root."""
        steps = []
        while len(level) > 1:
            lo = i - i % 3
            steps.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 3])))
            level, i = up(level), i // 3
        return steps, level[0]

    by = defaultdict(list)
    for r in docs:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: [leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))] for s in order}
    sub = [climb(trees[s], 0)[1] for s in order]
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = climb(trees[s], i)[0] + climb(sub, g)[0]
            h = leaf((*r[:4], altered(r)))
            for left, right in steps:
                h = sha(left + h + right)
            root = climb(sub, g)[1]
            out.append((r[0], leaf(r), sub[g], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=repr)


def manifest(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).withColumn("idx", F.lit("x"))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.verify(df, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def without_breaks(r):
    return r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[4].replace("\n", "")


def test_manifest_by_hand(spark, monkeypatch):
    rng = random.Random(4)
    sources = ["hot"] * 12 + ["a", "é", "Z", "", None, "\uffff", "\U0001f600"] + [f"s{k}" for k in range(12)]
    docs = [(i, rng.choice(sources), rng.choice(["de", None]), rng.choice([3, None]), rng.choice(["", None, "a\nb", "c", "é\n" * 3])) for i in range(330)]
    docs += [docs[7], docs[7], (None, "hot", None, None, None), (None, "hot", None, None, "x\n"), (-3, "hot", "de", 1, "y\n" * 4000)]
    want = manifest_by_hand(docs, without_breaks)
    assert any(not r[6] for r in want) and any(r[6] for r in want)
    assert manifest(spark, docs) == want
    monkeypatch.setattr(merkle, "BAND", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    assert manifest(spark, docs[:60]) == manifest_by_hand(docs[:60], without_breaks)


def test_small_manifests(spark):
    for n in (0, 1, 2, 3, 4):
        docs = [(i, "s", "en", 1, "a\nb") for i in range(n)]
        assert manifest(spark, docs) == manifest_by_hand(docs, without_breaks)
        apart = [(i, f"s{i}", "en", 1, "a\nb") for i in range(n)]
        assert manifest(spark, apart) == manifest_by_hand(apart, without_breaks)


# --- urls


def judged_by_hand(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, a == "block") for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[2] if best else None, "allow" if best is None else "block" if best[3] else "allow")


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict int")
    found = url_filter.judge(pages, url_filter.listed_rules(spark, rules))
    return [tuple(r)[1:] for r in found.select("row.page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]


ODD = [None, "", "no scheme", "a.net/en/", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://x.example.net/en/1", "http://example.net/en", "http://nexample.net/en/", "https://ÄB.org/fr/?a://b", "http://a.org/fr/#x/y",
       "http://u@a.net:80/p", "http://net./x", "http://..net/x", "x\ny://q.net/a\nb?c", "http://a.com/?u=http://b.net/", "http://example.com/de/" + "z" * 50000, "http://" + "a." * 3000 + "net/k"]


def test_odd_urls(spark):
    assert judged(spark, ODD, url_filter.RULES) == [judged_by_hand(u, url_filter.RULES) for u in ODD]
    assert judged(spark, [], url_filter.RULES) == []
    assert [r[2:] for r in judged(spark, ODD, [])] == [(None, "allow")] * len(ODD)


def test_long_lists_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    label = lambda: rng.choice("abcdef") + rng.choice("gh")
    urls = [f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}/{label()}/{label()}?q" for _ in range(3000)]
    rules = [(".".join(label() for _ in range(rng.randint(1, 3))), "/" + label()[: rng.randint(0, 2)], rng.choice(["block", "allow"])) for _ in range(500)]
    want = [judged_by_hand(u, rules) for u in urls]
    assert judged(spark, urls, rules) == want
    monkeypatch.setattr(url_filter, "LIMIT", 200)
    assert judged(spark, urls, rules) == want


def test_cascade_is_exact_and_alternates(spark):
    keys = url_filter.hashed(spark.range(20000).selectExpr("concat('k', id) AS key", "id"))
    listed = keys.where("substr(key, 2) % 17 = 0").drop("key")
    others = keys.where("substr(key, 2) % 17 <> 0").drop("key")
    found = url_filter.cascade(listed, others)
    assert len(found.levels) > 2 and found.size() < 20000 * 2
    for side, answer in ((listed, True), (others, False)):
        k = side.toPandas()
        assert (found.listed(k.h1.to_numpy(), k.h2.to_numpy()) == answer).all()
