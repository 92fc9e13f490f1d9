"""Token ids in binary files (operator 3).

Documents are dealt by ranges of doc_id; each range becomes one or more files in ascending order. A file holds one
independent zstandard frame for each document (little-endian unsigned 32-bit ids, end id included), then a
skippable frame with the doc_ids, then the seek table of the seekable format: sizes and checksum of every
frame. A reader takes the seek table from the end of the file and decompresses only what is asked for.

A task that is run again writes another file; the manifest, a table with one row for each file, names
those that count. Both lie under one folder that all executors reach.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.bpe import chunks
from junctura.llm.common import FORGET, LOT, before, fresh_path, forget, give_back, pieces, strings, text_bytes

SEEK_MAGIC, SKIP_MAGIC, IDS_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
FILE_BYTES = 24 << 20  # of text for each file
RANGES = 20_000  # of doc_id at most, one task each; a task writes as many files as its range fills
CHUNK = 8 << 20  # characters whose words are looked up together
COUNTED = 1 << 20  # the same where they are only counted
SPLIT = 1 << 18  # characters whose words are parted together
PART = 1 << 26  # ids in one frame at most; a longer document takes several frames
WORDS = 200_000  # words in each of the two generations that a worker remembers, half of it where ids are only counted
GATHER = 1 << 20  # words whose ids are laid out at a time

#: What a byte of a text is: a gap between words, a sign (ASCII but letters, digits and the apostrophe), a to z, or perhaps the second byte of a letter from ß to ÿ.
_GAP, _SIGN, _AZ, _HIGH = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \n")] = _GAP
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'")]] = _SIGN
_KIND[ord("a") : ord("z") + 1] = _AZ
_KIND[[x.encode()[1] for x in map(chr, range(0xDF, 0x100)) if x != "÷"]] = _HIGH


class WordEncoder:
    """The ids of whole texts by the tokenizers library, which is asked once for each word that isn't remembered.

    The normaliser and the pattern of the tokenizer work within what spaces and line ends part, so the ids of
    a text are those of its words in a row; tests hold this against whole texts. A text is lower-cased here only
    where that is what the normaliser does (composed text that stays so, without a final sigma), and punctuation between a
    letter and a space is a piece of its own; so fewer words differ. Words are found and told apart by arrays of all
    bytes of some texts. Words of a to z go to the same model without the normaliser, the pattern and the letters for
    bytes, which would leave them as they are.

    With `added`, the strings of added tokens get their ids, as the library does by default: it takes them from the
    raw text and works on what stands between them apart. Without it they are text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.added, self.parted = {}, None
        if added:
            tokens = self.tokenizer.get_added_tokens_decoder()
            if any(x.normalized or x.lstrip or x.rstrip or x.single_word for x in tokens.values()):
                raise ValueError("added tokens that take in more than their string")
            self.added = {x.content: np.array([i], "<u4").tobytes() for i, x in tokens.items()}
            if self.added:
                self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.tokenizer.encode_special_tokens = True  # the words asked for hold no added token that counts
        self.bare = Tokenizer(self.tokenizer.model)  # shares the model; a copy by way of its text takes 400 MB on the way
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.seen: list[dict[str, bytes]] = [{}, {}]  # a young and an old generation
        self.seen_counts: list[dict[str, int]] = [{}, {}]

    @staticmethod
    def lowered(text: str) -> str:
        lower = text.lower()
        return lower if text.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower) else text

    @classmethod
    def words(cls, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of some texts, the number of each word in a row among them, and the bounds of each text's."""
        parts = [cls.parts(x) for x in chunks(texts, SPLIT)]
        row = pa.chunked_array([x for x, _ in parts], pa.large_string()).combine_chunks().dictionary_encode()
        counts = np.concatenate([np.zeros(1, np.int64), *(n for _, n in parts)])
        return row.dictionary.to_numpy(zero_copy_only=False).tolist(), row.indices.to_numpy(), np.cumsum(counts)

    @classmethod
    def parts(cls, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of some texts in a row and how many each text has.

        A text is parted at spaces and line ends; signs between a letter and a gap or the end are a word of their own.
        """
        column = pa.array(map(cls.lowered, texts), pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1)
        if not at[-1]:
            return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8, at[-1])
        kind = _KIND[data]
        gap, sign, bound = kind == _GAP, kind == _SIGN, np.zeros(len(data) + 1, bool)
        bound[at] = True
        first, last = bound[:-1].copy(), bound[1:].copy()  # bytes that begin or end what gaps and the bounds of texts part
        first[1:] |= gap[:-1]
        last[:-1] |= gap[1:]
        inner = sign[1:] & sign[:-1] & ~bound[1:-1]  # a sign after a sign of the same text
        a, b = np.flatnonzero(sign & ~np.r_[False, inner]), np.flatnonzero(sign & ~np.r_[inner, False])
        a = a[last[b] & ~first[a]]
        first[a[(kind[a - 1] == _AZ) | (kind[a - 1] == _HIGH) & (data[a - 2] == 0xC3)]] = True
        starts = np.flatnonzero(first & ~gap)
        kept = data[~gap]
        offsets = np.r_[starts - np.cumsum(gap)[starts], len(kept)]
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept)), np.diff(np.searchsorted(starts, at))

    def learned(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Some of the words at a time, their ids in a row and the bounds of each word's."""
        bare, more, rest = [], [], []
        for w in words:
            (rest if not w.isalpha() else bare if w.isascii() and w.islower() else more).append(w)
        for tokenizer, plain in ((self.bare, bare), (self.tokenizer, more)):
            lots = [plain[i : i + 128] for i in range(0, len(plain), 128)]
            for lo in range(0, len(lots), 64):
                part = lots[lo : lo + 64]
                for lot, e in zip(part, tokenizer.encode_batch_fast([" ".join(x) for x in part], add_special_tokens=False)):
                    ids = np.array(e.ids, "<u4")
                    at = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
                    if len(at) != len(lot) + 1 or at[-1] != len(ids):
                        rest.extend(lot)
                    else:
                        yield lot, ids, at
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            yield part, np.array([i for x in each for i in x], "<u4"), np.cumsum([0, *map(len, each)])

    def known(self, seen: list[dict], words: list[str], of: Callable[[np.ndarray, np.ndarray], Iterable], most: int) -> list:
        """For each of some words, all different, what `of` makes of ids in a row and the bounds of each word's; `seen` remembers it, in generations of about `most` words."""
        if len(seen[0]) > most:
            seen[:] = {}, seen[0]
        young, old = seen
        out = list(map(young.get, words))
        missed = [i for i, x in enumerate(out) if x is None]
        asked = [(words[i], old.get(words[i])) for i in missed]
        young.update([x for x in asked if x[1] is not None])
        for lot, ids, at in self.learned([w for w, x in asked if x is None]):
            young.update(zip(lot, of(ids, at)))
        for i in missed:
            out[i] = young[words[i]]
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.parted or not any(a in t for t in texts for a in self.added):
            yield from self._encode(texts)
            return
        parts = [self.parted(t) for t in texts]  # text, added token, text, ...
        plain = self._encode([x for p in parts for x in p[::2]])
        for p in parts:
            yield b"".join(self.added[x] if k % 2 else next(plain) for k, x in enumerate(p))

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        words, row, bounds = self.words(texts)
        each = self.known(self.seen, words, _cut, WORDS)
        pool, sizes = np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4
        first, ends, out = np.cumsum(sizes) - sizes, np.r_[0, np.cumsum(sizes[row])], []
        for lo in range(0, len(row), GATHER):
            part = row[lo : lo + GATHER]
            out.append(pool[np.repeat(first[part] - ends[lo : lo + len(part)], sizes[part]) + np.arange(ends[lo], ends[lo + len(part)])].tobytes())
        data, at = b"".join(out), (4 * ends[bounds]).tolist()
        for a, b in zip(at, at[1:]):
            yield data[a:b]

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids each text has, as encode() gives them."""
        if not self.parted or not any(a in t for t in texts for a in self.added):
            return self._counts(texts).tolist()
        parts = [self.parted(t) for t in texts]
        plain = iter(self._counts([x for p in parts for x in p[::2]]).tolist())
        return [len(p) // 2 + sum(next(plain) for _ in p[::2]) for p in parts]

    def _counts(self, texts: list[str]) -> np.ndarray:
        words, row, bounds = self.words(texts)
        sizes = np.array(self.known(self.seen_counts, words, lambda ids, at: np.diff(at).tolist(), WORDS // 2), np.int64)
        return np.diff(np.r_[0, np.cumsum(sizes[row])][bounds])


def _cut(ids: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    data, at = ids.tobytes(), (4 * at).tolist()
    return (data[a:b] for a, b in zip(at, at[1:]))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One for each worker process; what it remembers serves the next task too."""
    return WordEncoder(path, added=True)


FORGET.append(encoder_of.cache_clear)


def write_file(out, docs: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Writes the frames and tables of one file; returns its documents and ids."""
    press = zstandard.ZstdCompressor(level=3)
    table, ids, frames, total = [], [], [], 0
    for doc, data in docs:
        parts = [data[i : i + 4 * PART] for i in range(0, len(data), 4 * PART)] or [b""]
        for x in parts:
            z = press.compress(x)
            out.write(z)
            table.append(struct.pack("<III", len(z), len(x), xxhash.xxh64_intdigest(x) & 0xFFFFFFFF))
        ids.append(doc)
        frames.append(len(parts))
        total += len(data) // 4
    known = np.array([x is not None for x in ids], np.uint8)
    index = np.array([x or 0 for x in ids], "<i8").tobytes() + np.array(frames, "<u4").tobytes() + known.tobytes()
    out.write(struct.pack("<II", IDS_MAGIC, len(index)) + index)
    body = b"".join(table)
    out.write(struct.pack("<II", SKIP_MAGIC, len(body) + 9) + body + struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC))
    return len(ids), total


class TokenFile:
    """Reads documents of one file, each without the others."""

    def __init__(self, source):
        self.source, size = source, source.size()
        frames, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        start = size - 9 - 12 * frames - 8
        table = np.frombuffer(source.read_at(12 * frames, start + 8), "<u4").reshape(frames, 3)
        self.packed, self.plain, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.at = np.r_[0, np.cumsum(self.packed)]
        magic, length = struct.unpack("<II", source.read_at(8, int(self.at[-1])))
        if magic != IDS_MAGIC:
            raise ValueError("no document index")
        index = source.read_at(length, int(self.at[-1]) + 8)
        n = length // 13
        known = np.frombuffer(index, np.uint8, n, 12 * n)
        self.docs = [int(x) if k else None for x, k in zip(np.frombuffer(index, "<i8", n), known)]
        self.first = np.r_[0, np.cumsum(np.frombuffer(index, "<u4", n, 8 * n))].astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor()

    def read(self, i: int) -> bytes:
        """The ids of the i-th document of the file."""
        out = []
        for k in range(self.first[i], self.first[i + 1]):
            x = self.unpack.decompress(self.source.read_at(int(self.packed[k]), int(self.at[k])), max_output_size=int(self.plain[k])) if self.plain[k] else b""
            if xxhash.xxh64_intdigest(x) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            out.append(x)
        return b"".join(out)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the ids of all texts under folder (a URI that all executors reach); returns the manifest.

    A null text counts as empty and has the end id alone. A null doc_id comes before all others. Rows with the
    same doc_id follow each other in either order. Other columns of docs are left out. An empty table has an empty manifest.
    """
    spark, most = docs.sparkSession, FILE_BYTES
    n = min(pieces(text_bytes(docs), most, 1), RANGES)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    dealt = source.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
        fs, path = pafs.FileSystem.from_uri(folder)

        def each():
            for batch in batches:
                ids = iter(batch.column(0).to_pylist())
                for part in chunks(strings(batch.column(1)), CHUNK):
                    for text, data in zip(part, encoder.encode(part)):
                        yield next(ids), data + end, len(text)

        stream, seq = each(), 0
        while (first := next(stream, None)) is not None:
            name, seen, left = f"{uuid.uuid4().hex}.ids", [], most

            def one_file(item=first):
                nonlocal left
                while item is not None:
                    seen.append(item[0])
                    yield item[:2]
                    left -= item[2]
                    item = next(stream, None) if left > 0 else None

            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}") as out:
                n_docs, n_ids = write_file(out, one_file())
            known = [x for x in seen if x is not None]
            row = {"seq": seq, "file": f"{folder}/{name}", "n_docs": n_docs, "n_ids": n_ids, "first_doc": min(known, default=None), "last_doc": max(known, default=None)}
            yield pa.RecordBatch.from_pylist([row], LISTED)
            seq += 1
            give_back()
        give_back()

    listed = dealt.select("*").mapInArrow(run, "seq long, file string, n_docs long, n_ids long, first_doc long, last_doc long").withColumn("part", F.spark_partition_id())
    listed.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


LISTED = pa.schema([("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file: part and seq (its place), file, n_docs, n_ids, first_doc and last_doc (the least and largest doc_id) and start (ids in the files before it)."""
    listed = spark.read.parquet(f"{folder}/manifest").withColumn("here", F.col("n_ids"))
    return before(listed, [], F.struct("part", "seq"), F.expr(f"part div {LOT}")).drop("here").withColumnRenamed("before", "start")


def _dealt(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()), "file")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian bytes) of every document of a manifest, checksums tested."""
    return _dealt(files).mapInArrow(_reader(lambda x: x, pa.binary()), "doc_id long, start long, n_tokens long, ids binary")


def digests(files: DataFrame) -> DataFrame:
    """As read(), with ids_crc32 in place of the ids."""
    return _dealt(files).mapInArrow(_reader(zlib.crc32, pa.int64()), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the asked documents; only files that can hold them are opened, only their frames read and decompressed."""
    wanted = set(doc_ids)
    asked = F.array(*[F.lit(x).cast("long") for x in sorted(wanted)])
    files = files.where(F.exists(asked, lambda x: x.between(F.col("first_doc"), F.col("last_doc"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    f = TokenFile(source)
                    found = [(d, f.read(i)) for i, d in enumerate(f.docs) if d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["doc_id", "ids"])

    return _dealt(files).select("file").mapInArrow(run, "doc_id long, ids binary")


def _reader(of, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the encoder of the task before
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    f = TokenFile(source)
                    out = [[], [], [], []]
                    for i, doc in enumerate(f.docs):
                        x = f.read(i)
                        for column, value in zip(out, (doc, start, len(x) // 4, of(x))):
                            column.append(value)
                        start += len(x) // 4
                        if len(out[0]) == 2048:
                            yield _batch(out, kind)
                            out = [[], [], [], []]
                    if out[0]:
                        yield _batch(out, kind)

    return run


def _batch(out, kind):
    names = ["doc_id", "start", "n_tokens", "ids" if kind == pa.binary() else "ids_crc32"]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], kind)], names)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes all documents to a new folder of the shared one and returns the digests of what is read back."""
    return digests(write(docs, fresh_path(docs.sparkSession, "ids"), tokenizer, end_id))
