"""Toxic spans by a linear-chain conditional random field (operator 4).

Training takes a bounded sample of labelled documents (SAMPLE_ROWS rows, half of them toxic, SAMPLE_BYTES of text, by
hash of doc_id; near copies within it that have one label count once). Words and word beginnings that toxic documents
hold and clean ones hardly ever do, measured by the sizes of both classes, mark the tokens of toxic documents; on these tagged tokens the field is trained by the
gradient of its likelihood. Forward-backward gives each token of a text the probability of being toxic;
the largest and the sum of them give a document's score through a logistic curve fitted on the sample,
and the tokens above one half its offending offsets.

Scoring reads texts only. It takes whole texts, in batches that run through the chains side by side.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm.common import forget, give_back, row_and_text, strings

SAMPLE_ROWS = 4_000  # half of them toxic, if there are so many
SAMPLE_BYTES = 32 << 20  # half of them for each class; a text that does not fit is passed over
CRF_ROWS = 1_200  # documents of the sample that the field is trained on, half of them toxic
LEAST_SHARE = 0.008  # of the toxic documents of the sample hold a marker
EVIDENCE = 1e-3  # chance at most that so many of a marker's holders are toxic
MOST_CLEAN = 0.02  # share of clean documents with a marker for that of toxic ones, but for two standard deviations
COPY = 4  # of six minimal hashes that near copies have in common
FOLDS = 5
BEGINNINGS = (3, 4, 5, 6)
REMEMBERED = 120_000  # words whose scores a task remembers

WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text is 0 mod FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) > n)]


def chain(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: float) -> np.ndarray:
    """Each token's probability of the toxic state, for chains that lie end to end.

    emission: log odds of each token; transition: 2 x 2 log weights from state to state; start: log odds of the first state.
    """
    forward, back = _sides(emission, lengths, transition, start)
    odds = forward * back
    return odds / (1 + odds)


def chain_loss(emission: np.ndarray, lengths: np.ndarray, gold: np.ndarray, transition: np.ndarray, start: float):
    """Gradients of the log likelihood: by token (emission), by transition, by start."""
    fw, bw = _sides(emission, lengths, transition, start)
    p = fw * bw / (1 + fw * bw)
    ends = np.cumsum(lengths)
    inner = np.ones(len(emission), bool)
    inner[ends[lengths > 0] - 1] = False
    i = np.flatnonzero(inner)  # a token with one after it
    # P(y_i = a, y_i+1 = b) from the odds that reach i from the left and i + 1 from the right
    left = np.stack([np.ones(len(i)), fw[i]])
    right = np.stack([np.ones(len(i)), np.exp(np.clip(emission[i + 1], -30, 30)) * bw[i + 1]])
    joint = left[:, None] * right[None] * np.exp(transition)[:, :, None]
    joint /= joint.sum((0, 1))
    expected = joint.sum(2)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[i], gold[i + 1]), 1)
    heads = (ends - lengths)[lengths > 0]
    return gold - p, seen - expected, float((gold[heads] - p[heads]).sum())


def _sides(emission, lengths, transition, start):
    """Odds of the toxic state by what stands up to each token, and by what stands after it."""
    n = len(emission)
    e, a = np.exp(np.clip(emission, -30, 30)), np.exp(transition)
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, size = begin[order], lengths[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    fw, bw, o = np.ones(n), np.ones(n), None
    for t, k in enumerate(active):
        at = first[:k] + t
        o = e[at] * np.exp(start) if t == 0 else e[at] * (a[0, 1] + a[1, 1] * o[:k]) / (a[0, 0] + a[1, 0] * o[:k])
        fw[at] = o
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        at = first[:k] + t
        x = e[at + 1] * bw[at + 1]
        bw[at] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    return fw, bw


@dataclass
class Tagger:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0, 0.0]))
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def emission(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        get = self.weights.get
        for w in set(words).difference(seen):
            seen[w] = self.bias + sum(get(f, 0.0) for f in features(w))
        return np.fromiter(map(seen.__getitem__, words), float, len(words))

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [WORD.findall(t.lower()) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        return chain(self.emission([x for w in words for x in w]), lengths, self.transition, self.start), lengths

    def scores(self, texts: list[str]) -> np.ndarray:
        p, lengths = self.marginals(texts)
        z = aggregate(p, lengths) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """Begin, end (in characters) and probability of the tokens above one half."""
        found = list(WORD.finditer(text))
        p = chain(self.emission([m[0].lower() for m in found]), np.array([len(found)]), self.transition, self.start) if found else ()
        return [(m.start(), m.end(), float(x)) for m, x in zip(found, p) if x >= 0.5]


def aggregate(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each chain: 1, the logs of its largest probability and of their sum, and of its length."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    out[:, 1], out[:, 2] = np.log(1e-4), np.log(1e-2)
    some = np.flatnonzero(lengths > 0)
    if len(some):
        at = (np.cumsum(lengths) - lengths)[some]
        out[some, 1] = np.log(1e-4 + np.maximum.reduceat(p, at))
        out[some, 2] = np.log(1e-2 + np.add.reduceat(p, at))
    out[:, 3] = np.log1p(lengths) / 10
    return out


def without_copies(texts: list[str], labels: list[int] | None = None) -> list[int]:
    """Places of the texts that share fewer than COPY of six minimal hashes of three words with each kept one of their label."""
    mix = np.random.default_rng(11).integers(1, 1 << 31, (6, 2), dtype=np.int64)
    holders: dict[tuple, list[int]] = {}
    keep = []
    for i, t in enumerate(texts):
        h = np.array([zlib.crc32(w.encode()) for w in t.split()], np.int64)
        if len(h) >= 3:
            h = (h[:-2] * 31 + h[1:-1]) * 31 + h[2:] & 0x7FFFFFFF
        if len(h):
            label = labels[i] if labels else 0
            lists = [holders.setdefault((label, k, m), []) for k, m in enumerate(((h[None] * mix[:, :1] + mix[:, 1:]) & 0x7FFFFFFF).min(1).tolist())]
            if max(Counter(j for x in lists for j in x).values(), default=0) >= COPY:
                continue
            for x in lists:
                x.append(i)
        keep.append(i)
    return keep


def markers(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features mark toxicity, by the documents of each class that hold them, out of n_toxic and n_clean.

    All bounds follow the sizes of the classes: a share of the toxic documents, holders that are more toxic than chance (by the
    bound of Chernoff), and clean holders no more than MOST_CLEAN allows, with room for labels that are wrong.
    """
    n = np.maximum(toxic + clean, 1)
    share, by_chance = toxic / n, n_toxic / (n_toxic + n_clean)
    far = share * np.log(np.maximum(share, 1e-9) / by_chance) + (1 - share) * np.log(np.maximum(1 - share, 1e-9) / (1 - by_chance))
    some = MOST_CLEAN * toxic * n_clean / n_toxic
    return (toxic >= LEAST_SHARE * n_toxic) & (share > by_chance) & (n * far >= -np.log(EVIDENCE)) & (clean <= some + 2 * np.sqrt(some))


def train(texts: list[str], labels: list[int], rounds: int = 60) -> Tagger:
    """A tagger from whole texts and their labels. Without both classes it knows nothing but their share."""
    keep = without_copies(texts, labels)
    texts, y = [texts[i] for i in keep], np.array([labels[i] for i in keep], int)
    share = (y.sum() + 1) / (len(y) + 4)
    unsure = Tagger(curve=np.array([np.log(share / (1 - share)), 0, 0, 0]))
    if not y.any() or y.all():
        return unsure
    vocabulary: dict[str, int] = {}
    codes = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t.lower())), np.int32) for t in texts]
    names: dict[str, int] = {}
    each = [[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary]
    of = np.array([f for x in each for f in x], np.int32)
    end = np.cumsum([len(x) for x in each])
    begin = end - np.array([len(x) for x in each])
    docs_with = np.zeros((2, len(names)), np.int32)  # clean and toxic documents that hold each feature
    for c, label in zip(codes, y):
        if len(c):
            u = np.unique(c)
            docs_with[label, np.unique(np.concatenate([of[begin[k] : end[k]] for k in u]))] += 1
    marks = markers(docs_with[1], docs_with[0], int(y.sum()), int((1 - y).sum()))
    if not marks.any():
        return unsure
    rng = np.random.default_rng(5)
    pick = np.sort(np.concatenate([rng.permutation(np.flatnonzero(y == c))[: CRF_ROWS // 2] for c in (0, 1)]))
    code = np.concatenate([codes[i] for i in pick]).astype(np.int64)
    lengths = np.array([len(codes[i]) for i in pick], np.int64)
    kept = {f: k for k, f in enumerate(sorted(f for f, i in names.items() if marks[i]))}
    new = np.full(len(names), -1, np.int64)
    for f, k in kept.items():
        new[names[f]] = k
    pair = np.stack([np.repeat(np.arange(len(each)), end - begin), new[of]], 1)
    pair = pair[pair[:, 1] >= 0]
    names = kept
    marked = np.zeros(len(vocabulary), bool)
    marked[pair[:, 0]] = True
    gold = (marked[code] & np.repeat(y[pick] == 1, lengths)).astype(int)
    w, rest = np.zeros(len(names)), np.array([-4.0, 0, 0, 0, 0])  # bias, start, transitions 01, 10, 11
    moments = [np.zeros(len(w) + 5), np.zeros(len(w) + 5)]
    for r in range(1, rounds + 1):
        by_word = np.bincount(pair[:, 0], w[pair[:, 1]], len(vocabulary))
        transition = np.array([[0, rest[2]], [rest[3], rest[4]]])
        d, dt, ds = chain_loss(rest[0] + by_word[code], lengths, gold, transition, rest[1])
        per_word = np.bincount(code, d, len(vocabulary))
        g = np.r_[np.bincount(pair[:, 1], per_word[pair[:, 0]], len(w)) - 0.5 * w, d.sum(), ds, dt[0, 1], dt[1, 0], dt[1, 1]]
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        step = 0.3 * (moments[0] / (1 - 0.9**r)) / (np.sqrt(moments[1] / (1 - 0.99**r)) + 1e-6)
        w, rest = w + step[:-5], np.clip(rest + step[-5:], -12, 12)
    out = Tagger({f: float(w[k]) for f, k in names.items()}, float(rest[0]), np.array([[0, rest[2]], [rest[3], rest[4]]]), float(rest[1]))
    by_word = out.bias + np.bincount(pair[:, 0], w[pair[:, 1]], len(vocabulary))
    x = np.concatenate([aggregate(chain(by_word[np.concatenate(part)], np.array([len(c) for c in part]), out.transition, out.start), np.array([len(c) for c in part])) for part in (codes[i : i + 256] for i in range(0, len(codes), 256))])
    curve = np.zeros(4)
    for _ in range(30):  # Newton's steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(4) * 1e-1
        curve = curve + np.linalg.solve(h, x.T @ (y - q) - 1e-1 * curve)
    out.curve = curve
    return out


def that_fit(sizes: list[int], most: int) -> list[int]:
    """Places of the texts taken in order, each unless it would pass `most` bytes with those before it."""
    out, total = [], 0
    for i, n in enumerate(sizes):
        if total + n <= most:
            out.append(i)
            total += n
    return out


def sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int) -> list:
    """_id, text and _toxic of at most `rows` documents outside the held-out fold, in the order of a hash; each class has half of the rows and bytes.

    Of the rows with one doc_id one is taken, and a document with two labels is toxic. Sizes come first; only texts that fit reach the driver.
    """
    order = F.xxhash64(F.lit(3), "_id")
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    first = lambda part: known.where(part).orderBy(order, "_id").limit(rows // 2)
    wanted = first("_toxic = 1").union(first("_toxic = 0"))
    source = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    one = source.select("_id", key.alias("key")).join(F.broadcast(wanted), "_id").groupBy("_id", "_toxic").agg(F.min("key").alias("key"))
    listed = sorted(one.select(order.alias("k"), "_id", "_toxic", "key.hash", "key.size").collect())
    picked = []
    for label in (0, 1):
        of = [r for r in listed if r["_toxic"] == label]
        picked += [of[i] for i in that_fit([r["size"] for r in of], most_bytes // 2)]
    if not picked:
        return []
    spark = docs.sparkSession
    kinds = T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("_toxic int, hash long, size int").fields])
    chosen = spark.createDataFrame([(r["_id"], r["_toxic"], r["hash"], r["size"]) for r in picked], kinds)
    met = source.withColumns({"hash": F.xxhash64("text"), "size": F.octet_length("text")}).join(F.broadcast(chosen), ["_id", "hash", "size"])
    texts = met.groupBy("_id", "_toxic").agg(F.min("text").alias("text"))
    return sorted(texts.select(order.alias("k"), "_id", "text", "_toxic").collect())


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Tagger:
    """Trains on a sample of the labelled documents outside the held-out fold; at most `rows` of them and `most_bytes` of text reach the driver.

    Labels that are null are left out, as are documents without a label.
    """
    found = sample(docs, labels, rows, most_bytes)
    return train([r["text"] for r in found], [r["_toxic"] for r in found])


def score(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """row (a struct of the columns but text), text and score for each row of docs; a null text counts as empty."""
    return _with(docs, tagger, "score double", lambda tagger, texts: pa.array(tagger.scores(texts), pa.float64()))


def offsets(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """row, text and spans: begin, end (in characters) and probability of each offending token."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    return _with(docs, tagger, "spans array<struct<begin:int,end:int,p:double>>", lambda tagger, texts: pa.array([[{"begin": a, "end": b, "p": p} for a, b, p in tagger.spans(t)] for t in texts], kind))


def _with(docs: DataFrame, tagger: Tagger, ddl: str, of) -> DataFrame:
    source = row_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from junctura.llm.bpe import chunks

        forget()
        for batch in batches:
            parts = [of(tagger, part) for part in chunks(strings(batch.column(1)), 2 << 20)]
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.concat_arrays(parts)], ["row", "text", ddl.split()[0]])
        tagger.seen.clear()
        give_back()

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *T.StructType.fromDDL(ddl).fields]))


def clean(docs: DataFrame, tagger: Tagger, at: float = 0.5) -> DataFrame:
    """The documents that score below `at`, in the columns of docs."""
    kept = score(docs, tagger).where(F.col("score") < at)
    return kept.select(*[kept["text"] if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
