"""Near duplicates by bottom-k sketches (operator 9).

A document's set holds its distinct WIDTH-word shingles. One hash function orders them; the K smallest
values are its sketch. Documents with equal sets are one class, and classes are what is compared:

1. Inverted lists of the retained values. A pair with similarity 0.75 shares at least NEED values (but for a chance of
   4e-20, less than that of two shingles with one 64-bit hash), so values that no other class retains are left out, classes with fewer than NEED values
   left cannot have a partner, and the rarest `left - NEED + 1` values of a class are enough to meet every partner.
2. Classes that lists join, directly or through others, are a group. A group is dealt to blocks of about BLOCK classes; each
   two of its blocks meet in one task, which counts the overlaps by inverted lists of the full sets' values and
   returns only as many links as connect what is connected there. A group of thousands of near copies so is many small tasks.

   Of each pair whose sketches share enough, the sketch of the union is formed; the share of its values that both hold estimates
   the similarity. Pairs that it places too low to be near (again but for 4e-20) are passed over, the others judged on full sets.

A set is known by 128 bits of its hashes; classes have numbers of their own, so no two classes are taken for one.
Lists, groups and components are joins and partial aggregates; no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, forget, give_back

WIDTH = 5
PERCENT = 75
K = 96
NEED = 30  # values that a pair at PERCENT shares in the sketch of its union
BLOCK = 384  # classes of a group in one block
COLUMNS = 8192  # values whose overlaps are counted at a time
SMALL = 1_000_000  # ids that may be broadcast (8 MB, or 24 MB of keys of rows)
PAIRS = 4096  # pairs whose union sketches are formed at a time
STAR = 512  # edges of a node that are met in one part
REMEMBERED = 150_000  # words whose hashes a task remembers
_TOP = np.uint64(1 << 63)  # so that signed order is that of the hashes
_FILL = np.uint64((1 << 64) - 1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: dict | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.lower and bytes.split know A-Z and the six ASCII spaces alone."""
    words = _Words() if words is None else words
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(len(h), WIDTH)
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = (x ^ h[i : len(h) - n + 1 + i]) * _MIX[i]
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def _each(of, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = _Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                if len(words) > REMEMBERED:
                    words.clear()
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *of(sets)], names)
        words.clear()
        give_back()

    return run


def _sketch_columns(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([len(s) for s in sets], pa.int64()), *_keys(sets), pa.array([(s[:K] ^ _TOP).view(np.int64) for s in sets], pa.list_(pa.int64()))]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t1 and t2 (of the text), n_shingles, k1 and k2 (of the set, null for the empty one) and sketch, a row for each of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *_text_key(text)).alias("id"), text.alias("text"))
    made = source.mapInArrow(_each(_sketch_columns, ["id", "n_shingles", "k1", "k2", "sketch"]), "id struct<doc_id:bigint,t1:bigint,t2:bigint>, n_shingles long, k1 long, k2 long, sketch array<bigint>")
    return made.select("id.*", "n_shingles", "k1", "k2", "sketch")


def _text_key(text: F.Column) -> list[F.Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def lists(classes: DataFrame) -> DataFrame:
    """v, cid: the retained values under which classes can meet a partner."""
    n = F.least(F.col("n_shingles"), F.lit(K))
    need = F.when(F.col("n_shingles") >= NEED * 100 / PERCENT, F.lit(NEED)).otherwise(F.ceil(F.col("n_shingles") * PERCENT / 100)).cast("int")
    posts = classes.where(n > 0).select("cid", need.alias("need"), F.explode("sketch").alias("v"))
    for last in (False, True):
        often = posts.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
        posts = posts.join(often, "v")
        held = posts.groupBy("cid", "need").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("vs"))  # K values at most
        left = F.size("vs") - F.col("need") + 1
        held = held.where(left > 0)
        posts = held.select("cid", "need", F.explode(F.slice("vs", 1, left) if last else F.col("vs")).alias("x")).select("cid", "need", F.col("x.v").alias("v"))
        posts = checkpoint(posts)
    often = posts.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    return checkpoint(posts.join(often, "v").select("v", "cid"))


def full_sets(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cid and s (the sorted hashes of its full set, 8 bytes each) of the classes in members, from the whole text of one document each."""
    few = members.count() < SMALL
    dealt = lambda x: F.broadcast(x) if few else x
    reps = classes.join(dealt(members.select("cid")), "cid", "left_semi").select(F.struct("cid", "k1", "k2").alias("id"), F.col("holder").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(dealt(reps), texts["doc_id"].eqNullSafe(reps["doc_id"])).select("id", "text")
    full = texts.mapInArrow(_each(lambda sets: [pa.array([s.tobytes() for s in sets], pa.binary()), *_keys(sets)], ["id", "s", "own1", "own2"]), "id struct<cid:bigint,k1:bigint,k2:bigint>, s binary, own1 long, own2 long")
    full = full.where("own1 = id.k1 and own2 = id.k2").select("id.cid", "s")  # another text may have the same doc_id
    return checkpoint(full.dropDuplicates(["cid"]))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks (right None: of one block with itself), by lists of their values."""
    sets = left + (right or [])
    value = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.r_[True, value[1:] != value[:-1]]
    many = np.r_[~new[1:], False] | ~new  # values that two sets hold
    column = (np.cumsum(new) - 1)[many]
    row = row[many]
    m = len(left)
    out = np.zeros((m, len(right) if right else m), np.float32)
    if len(column):
        column = np.cumsum(np.r_[0, np.diff(column) != 0])
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        held = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        held[row[a:b], column[a:b] - lo] = 1
        out += held[:m] @ (held[m:] if right else held).T
    return out


def union_estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two sketches (sorted, filled up with the largest value) the size of their union's sketch and how many of its values both hold."""
    both = np.sort(np.concatenate([a, b], 1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    real = both != _FILL
    rank = np.cumsum(~again & real, 1)  # of each value in the union
    return np.minimum(rank[:, -1], K), np.count_nonzero(again & real & (rank <= K), 1)


def _likely(left: list[np.ndarray], right: list[np.ndarray] | None, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Pairs whose sketches and whose union sketch do not rule out that they are near: NEED values in common of a full sketch, else their part of PERCENT."""
    least = np.minimum(n_left[:, None], n_right[None])
    need = np.where(100 * NEED <= PERCENT * least, NEED, np.ceil(least * PERCENT / 100))
    out = (100 * least >= PERCENT * np.maximum(n_left[:, None], n_right[None])) & (overlaps(left, right) >= need)
    if right is None:
        out &= np.tri(*out.shape, -1, bool)
    x, y = _filled(left), _filled(right) if right is not None else _filled(left)
    i, j = np.nonzero(out)
    for lo in range(0, len(i), PAIRS):
        a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
        size, shared = union_estimate(x[a], y[b])
        out[a, b] = np.where(size < K, 100 * shared >= PERCENT * size, shared >= NEED)  # below K the union is known in full
    return out | out.T if right is None else out


def _filled(sketches_: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(sketches_), K), _FILL)
    for row, s in zip(out, sketches_):
        row[: len(s)] = s
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """Links within one block, or between two, as many as connect what is connected there."""
    table = table.sort_by([("side", "ascending"), ("cid", "ascending")])
    cid, side = table.column("cid").to_numpy(), table.column("side").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
    m = int(np.count_nonzero(side == 0))
    two = m < len(sets)
    n = np.array([len(x) for x in sets], np.float64)
    right = n[m:] if two else n
    near = _likely([x[:K] for x in sets[:m]], [x[:K] for x in sets[m:]] if two else None, n[:m], right)
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if len(rows):  # full sets of what may be near something
        shared = overlaps([sets[i] for i in rows], [sets[m + j] for j in columns]) if two else overlaps([sets[i] for i in rows], None)
        at = np.ix_(rows, columns)  # within one block both are the same
        near[at] &= 100 * shared >= PERCENT * (n[rows, None] + right[None, columns] - shared)
    base = m if two else 0
    out, free = [], np.ones(len(sets), bool)
    for i in range(len(sets)):
        if not free[i]:
            continue
        free[i] = False
        stack = [i]
        while stack:
            u = stack.pop()
            if two and u >= m:
                found = np.flatnonzero(near[:, u - m] & free[:m])
            else:
                found = base + np.flatnonzero(near[u] & free[base:])
            free[found] = False
            out.extend((u, v) for v in found.tolist())
            stack.extend(found.tolist())
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pa.table({"a": cid[a], "b": cid[b]})


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits that tell a set from all others, in two columns; null for the empty set."""
    whole = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
    half = lambda x, shift: None if x is None else (x >> shift & (1 << 64) - 1) - (1 << 63)
    return [pa.array([half(x, shift) for x in whole], pa.int64()) for shift in (64, 0)]


def _ordered(pairs: DataFrame) -> DataFrame:
    """a < b, each pair once."""
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) by alternating stars; a node without an edge has no row.

    A star of more than STAR edges is met in parts: its edges are dealt by their other ends, its smallest neighbour once to each part.
    """
    e = checkpoint(_ordered(edges))
    rows, seen = 2 * e.count(), None
    while True:
        both = e.union(e.select("b", "a"))  # large star: larger neighbours move to the smallest neighbour
        star = _with_least(both, rows).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        down = _ordered(star).select(F.col("b").alias("a"), F.col("a").alias("b"))  # small star: a > b
        moved = _with_least(down, rows)
        e = checkpoint(_ordered(moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == seen:
            return e.select(F.col("b").alias("node"), F.col("a").alias("label")).union(e.select("a", "a").distinct())
        rows, seen = 2 * now[0], now


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """edges a, b with m, the smallest b of each a; `rows` is no less than their number.

    Nodes with more than `each` edges are cut into parts of about so many. There are rows / each of them at most, which is
    no more than SMALL, so their numbers of parts may be broadcast at any size.
    """
    each = max(STAR, -(-rows // SMALL))
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.ceil(F.count("*") / each).cast("int").alias("parts"))
    large = F.broadcast(least.where("parts > 1").select("a", "parts"))
    dealt = edges.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return dealt.join(least.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["a", "part"]).select("a", "b", "m")


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links between classes, as many as their components need and no false one."""
    found = lists(classes)
    lead = found.groupBy("v").agg(F.min("cid").alias("lead"))
    groups = components(found.join(lead, "v").select(F.col("cid").alias("a"), F.col("lead").alias("b"))).select(F.col("node").alias("cid"), F.col("label").alias("gid"))
    sizes = groups.groupBy("gid").agg(F.count("*").alias("n")).select("gid", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = checkpoint(groups.join(sizes, "gid").select("gid", "cid", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = members.select("gid", "cid", "block", other.alias("other")).select("gid", "cid", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return checkpoint(met.join(full_sets(members, classes, docs), "cid").groupBy("gid", "x", "y").applyInArrow(_block_links, "a long, b long"))


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, n_shingles, component_id and kept, for each row of docs."""
    rows = checkpoint(sketches(docs.select("doc_id", "text")))
    found = rows.where("k1 is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("holder"), F.first("sketch").alias("sketch"))
    classes = checkpoint(found.withColumn("cid", F.monotonically_increasing_id()))  # numbers hold from here on, as the rows are written
    named = components(links(classes, docs.select("doc_id", "text")))
    held = classes.select("cid", "k1", "k2", "holder").join(named, classes["cid"] == named["node"], "left").select("k1", "k2", "holder", F.coalesce("label", "cid").alias("label"))
    least = held.groupBy("label").agg(F.min("holder").alias("least"))
    ids = checkpoint(held.join(least, "label").select("k1", "k2", "least"))
    out = rows.drop("sketch").join(ids, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "t1", "t2", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, for each row of docs.

    A text without words has an empty set and is linked with nothing: it is its own component. A null doc_id counts after all
    others; if a component has no other, its id is null. Rows that repeat a doc_id are judged each by their text.
    """
    return _judged(docs).drop("t1", "t2")


def dedup(docs: DataFrame) -> DataFrame:
    """The kept documents, in the columns of docs. Rows are judged by doc_id and text; of rows that repeat both one stays, a null text counts as empty.

    Only the keys of rows that go, or that stand more than once, move; texts are not shuffled as long as these are few.
    """
    key = ["doc_id", "t1", "t2"]
    # a row is told by its doc_id and 128 bits of its text; rows with equal keys are all kept or all not
    told = checkpoint(_judged(docs).groupBy(*key).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    few = told.count() < SMALL
    near = lambda x: F.broadcast(x) if few else x
    again = told.where("kept")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), *_text_key(text))
    met = lambda x: [named[c].eqNullSafe(x[c]) for c in key]
    kept = named.join(near(told), met(told), "left_anti")
    if not again.isEmpty():
        kept = kept.union(named.join(near(again), met(again), "left_semi").dropDuplicates(key))
    return kept.select("row.*")
