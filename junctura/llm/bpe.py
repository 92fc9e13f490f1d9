"""Byte-level BPE encoding and decoding (operator 2).

A text is cut into pieces by the tokenizer's pattern. Over the byte positions of a piece stands a
segment tree whose leaves hold the rank of the pair that starts there; every inner node holds the
leftmost smallest rank below it, so the root names the next merge. A merge changes three leaves (the
merged pair, its dead right half, its live left neighbour), each a logarithmic update. Short pieces of
a batch are merged together, one tree a row; long ones alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from junctura.llm.common import strings

SHORT = 64  # bytes of the longest piece that is merged in a batch
PIECES = 200_000  # pieces in each of the two generations that a worker remembers
CHUNK = 2 << 20  # characters encoded at a time
NONE = np.int64(1) << 40  # no pair


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values(), default=0) >= 1 << 20:
            raise ValueError("ids of 2^20 and more")  # pairs of ids are packed by 20 bits
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.seen: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.seen_ids = {str(i): t for i, t in self.bytes_of.items()}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the two don't merge. b < 0: there is no right half."""
        key = a << 20 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((b >= 0) & (self.keys[at] == key), self.values[at], NONE)

    def merge_batch(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces of at most SHORT bytes."""
        n = np.array([len(p) for p in pieces])
        width = 1 << max(1, int(n.max() - 1).bit_length())
        w = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(w, width)
        at = np.arange(width)
        live = at < n[:, None]
        token = np.full((w, width + 1), -1, np.int64)  # the last column stands for the end
        token[:, :width] = np.where(live, self.byte_id[raw], -1)
        right = np.tile(np.r_[at + 1, width], (w, 1))
        right[:, :width][at + 1 >= n[:, None]] = width
        left = np.tile(np.r_[at - 1, width - 1], (w, 1))  # -1: none
        tree = np.full((w, 2 * width), NONE << 8, np.int64)
        leaf = self._rank(token[:, :width], token[np.arange(w)[:, None], right[:, :width]])
        tree[:, width:] = np.where(live, leaf << 8 | at, NONE << 8)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2

        def put(row, pos, rank):
            node = pos + width
            tree[row, node] = np.where(rank < NONE, rank << 8 | pos, NONE << 8)
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.arange(w)
        while True:
            root = tree[row, 1]
            row, root = row[root < NONE << 8], root[root < NONE << 8]
            if not len(row):
                break
            p, rank = root & 255, root >> 8
            dead = right[row, p]
            after = right[row, dead]
            token[row, p] = rank
            live[row, dead] = False
            right[row, p] = after
            left[row, after] = p
            put(row, dead, np.full(len(row), NONE))
            put(row, p, self._rank(rank, token[row, after]))
            before = left[row, p]
            has = before >= 0
            if has.any():
                r, b = row[has], before[has]
                put(r, b, self._rank(token[r, b], rank[has]))
        ids = token[:, :width][live].tolist()
        ends = np.cumsum(live.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = 1 << 60
        token = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(token[i] << 20 | token[i + 1])
            if rank is not None:
                tree[width + i] = rank << 32 | i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(pos, rank):
            k = pos + width
            tree[k] = none if rank is None else rank << 32 | pos
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] < none:
            p, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            dead = right[p]
            after = right[dead]
            token[p], token[dead], right[p] = rank, -1, after
            put(dead, None)
            put(p, None if after >= n else pairs.get(rank << 20 | token[after]))
            if after < n:
                left[after] = p
            if left[p] >= 0:
                put(left[p], pairs.get(token[left[p]] << 20 | rank))
        return [t for t in token if t >= 0]

    def learn(self, pieces) -> None:
        """Puts the ids of pieces, as decimals joined by commas, into seen."""
        short, names = [], []
        for piece in pieces:
            b = piece.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                self.seen[piece] = str(whole)
            elif len(b) <= SHORT:
                short.append(b)
                names.append(piece)
            else:
                self.seen[piece] = ",".join(map(str, self.merge_long(b)))
        order = sorted(range(len(short)), key=lambda i: len(short[i]))
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            for i, ids in zip(part, self.merge_batch([short[i] for i in part])):
                self.seen[names[i]] = ",".join(map(str, ids))

    def encode_joined(self, texts: list[str]) -> Iterator[str]:
        """For each text its ids as decimals joined by commas."""
        if len(self.seen) > PIECES:
            self.old, self.seen = self.seen, {}
        pieces = [self.split(t) for t in texts]
        need = set().union(*pieces).difference(self.seen)
        old = {p: x for p in need if (x := self.old.get(p)) is not None}
        self.seen.update(old)
        self.learn(p for p in need if p not in old)
        get = self.seen.__getitem__
        for p in pieces:
            yield ",".join(map(get, p))

    def encode(self, text: str) -> list[int]:
        (joined,) = self.encode_joined([text])
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.seen_ids.__getitem__, joined.split(","))) if joined else b""


@lru_cache(maxsize=1)
def bpe_of(path: str, pattern: str) -> ByteBPE:
    """One for each worker process; what it remembers serves the next task too."""
    return ByteBPE(load_ranks(path), pattern)


def chunks(texts: Iterable[str], most: int = CHUNK) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each row of docs: row (a struct of its columns but text), n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the digests of nothing. Repeated rows and ids stay as they are.
    """
    schema, source = _source(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in batches:
            out = []
            for part in chunks(strings(batch.column(1))):
                for joined in bpe.encode_joined(part):
                    out.append((joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(bpe.decode_joined(joined)).hexdigest()))
            n, ids, dec = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], ["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, T.StructType([schema, *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields]))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """row and ids (array<int>) for each row of docs; null and empty texts have no ids."""
    schema, source = _source(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in batches:
            ids = [np.fromstring(j, np.int32, sep=",") if j else np.zeros(0, np.int32) for part in chunks(strings(batch.column(1))) for j in bpe.encode_joined(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])

    return source.mapInArrow(run, T.StructType([schema, *T.StructType.fromDDL("ids array<int>").fields]))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """row and bytes of what encode() returned; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in batches:
            out = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["row", "bytes"])

    return encoded.select("row", "ids").mapInArrow(run, T.StructType([encoded.schema["row"], *T.StructType.fromDDL("bytes binary").fields]))


def _source(docs: DataFrame):
    from junctura.llm.common import row_and_text

    source = row_and_text(docs)
    return source.schema["row"], source
