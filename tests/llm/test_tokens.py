import hashlib
import io
import os
import random
import subprocess
import sys
import tempfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from junctura.llm import bpe, packing, token_files
from junctura.llm.queries import BYTE_BPE, QUERIES, WORD_BPE
from tokenizers import Tokenizer

TEXTS = ["", "don't stop, it's 12345!", "a" * 70, "=" * 900, " \n\n  x\t\r\n", "日本語とÄ̈é ŽŠ. ΣΑΣ'S", "x,. y., <|endoftext|> 😀😃", "word " * 400, "\x1c \x85   z"]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_ranks(BYTE_BPE)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, reference):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(50, None, None), (0, TEXTS[1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(tuple(r) for r in bpe.digest(docs, BYTE_BPE, P.PATTERN).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)
    encoded = bpe.encode(docs, BYTE_BPE, P.PATTERN)
    back = bpe.decode(encoded, BYTE_BPE, P.PATTERN).select("row.doc_id", "bytes").collect()
    assert sorted((r[0], bytes(r[1])) for r in back) == sorted((i, (t or "").encode()) for i, t, _ in rows)


def test_bpe_random_pieces(reference):
    own, rng = bpe.ByteBPE(bpe.load_ranks(BYTE_BPE), P.PATTERN), random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abcé tion\n'") for _ in range(rng.randint(0, 200)))
        assert own.encode(t) == reference.encode_ordinary(t)


def test_word_encoder_equals_the_library():
    t, own = Tokenizer.from_file(WORD_BPE), token_files.WordEncoder(WORD_BPE)
    t.encode_special_tokens = True
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in TEXTS]
    assert list(own.encode(TEXTS)) == want and list(own.encode(TEXTS[::-1])) == want[::-1]


def test_word_encoder_on_random_texts():
    t, own, rng = Tokenizer.from_file(WORD_BPE), token_files.WordEncoder(WORD_BPE), random.Random(7)
    t.encode_special_tokens = True
    signs = [*"abß éÉİıΣσςHT'’.,!?<|>&#*-_ 09\n\t\xa0\u3000e\u0301\u0338\u0331\u0308ªµǅ中文\u2028😀´`~[]{}@", "<|endoftext|>", "'s", "don't ", "straße! "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_counts_are_those_of_the_ids(monkeypatch):
    """Numbers of ids without the ids, over small generations and few texts at a time; added tokens count as in encode()."""
    rng = random.Random(8)
    signs = [*"abß éÉİıΣσςHT'’.,!?<|>&#*-_ 09\n\t\r\0\xa0\u3000e\u0301\u0338ªµǅ中\u2028😀´`~[]{}@", "<|endoftext|>", "a.\n", "é,! ", "x.y. ", "don't ", "straße! "]
    texts = TEXTS + ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)]
    monkeypatch.setattr(token_files, "WORDS", 300)
    for added in (False, True):
        own = token_files.WordEncoder(WORD_BPE, added=added)
        want = [len(x) // 4 for x in own.encode(texts)]
        assert [n for i in range(0, len(texts), 100) for n in own.counts(texts[i : i + 100])] == want and own.counts([]) == []


def test_words_of_a_text_are_no_objects_each():
    """While ids are handed out, what is kept of a text's words grows with the different ones; before, each was a string."""
    own, text = token_files.WordEncoder(WORD_BPE), "some words, often said. " * 50_000
    before, ids = sys.getallocatedblocks(), own.encode([text])
    first = next(ids)
    assert sys.getallocatedblocks() - before < 20_000
    assert first == next(own.encode(["some words, often said. "])) * 50_000


def test_words_are_parted_within_texts_and_over_lots(monkeypatch):
    """Signs, letters and gaps at the bounds of texts and of lots; texts without words between them."""
    t, own, rng = Tokenizer.from_file(WORD_BPE), token_files.WordEncoder(WORD_BPE), random.Random(11)
    t.encode_special_tokens = True
    signs = [*"abzéßÿ÷©Ã.,!'~@\x7f \n\t", "a.", ".a", "é!", "÷.", "ab, ", "x.y\n"]
    texts = ["", "a", ".", "", "\n", " ", "a.", ".", "a"] + ["".join(rng.choices(signs, k=rng.randint(0, 9))) for _ in range(4000)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for split, gather in ((1, 1), (7, 5), (1 << 20, 1 << 20)):
        monkeypatch.setattr(token_files, "SPLIT", split)
        monkeypatch.setattr(token_files, "GATHER", gather)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
        assert own.counts(texts) == [len(x) for x in want]


def test_an_encoder_is_loaded_without_a_copy_of_its_model():
    """In a process of its own: the memory it takes at most while it is loaded."""
    code = f"""if 1:
        import re
        from junctura.llm import token_files
        most = lambda: int(re.search("VmHWM:\\\\s+([0-9]+)", open("/proc/self/status").read())[1]) / 1024
        before = most()
        token_files.WordEncoder({WORD_BPE!r}, added=True)
        print(most() - before)"""
    grown = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 150


def test_lengths_are_counted_in_little_memory():
    """In a process of its own: what counting 8 million characters takes at most beside the batch; a worker keeps no encoder afterwards."""
    code = f"""if 1:
        import random, re
        import pyarrow as pa
        from junctura.llm import common, packing, token_files
        most = lambda: int(re.search("VmHWM:[^0-9]*([0-9]+)", open("/proc/self/status").read())[1]) / 1024
        rng = random.Random(4)
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(100_000)]
        texts = [" ".join(rng.choices(words, k=620)) for _ in range(2048)]
        batch = pa.RecordBatch.from_pydict(dict(doc_id=range(2048), source=["s"] * 2048, cluster=range(2048), text=texts))
        del texts, words
        common.give_back()
        open("/proc/self/clear_refs", "w").write("5")
        start = most()
        rows = sum(x.num_rows for x in packing._lengths({WORD_BPE!r})(iter([batch])))
        print(rows, most() - start, token_files.encoder_of.cache_info().currsize)"""
    rows, grown, encoders = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert rows == 2048 and not encoders and grown < 90


def test_token_files(spark, monkeypatch):
    rows = [(7, "b c"), (3, None), (5, ""), (None, "n"), (5, "a"), (9, TEXTS[5]), (11, "long text " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    files = token_files.write(docs, folder, WORD_BPE)
    t = Tokenizer.from_file(WORD_BPE)
    start, want = 0, []
    for i, x in sorted(((i, x or "") for i, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted([tuple(r) for r in token_files.digests(files).collect()], key=lambda r: r[1]) == want
    assert {r["doc_id"] for r in token_files.read_documents(files, [7, 9]).collect()} == {7, 9}
    monkeypatch.setattr(token_files, "FILE_BYTES", 400)
    monkeypatch.setattr(token_files, "RANGES", 3)  # a task now writes several files
    many = [(i, "x y " * (i % 50), 1, "f", None) for i in range(200)]
    files = token_files.write(spark.createDataFrame(many, "doc_id long, text string, n_docs int, file string, source string"), folder + "m", WORD_BPE).cache()
    found = files.orderBy("start").collect()
    assert len(found) > 20 and {r["part"] for r in found} == {0, 1, 2} and all(a["last_doc"] < b["first_doc"] for a, b in zip(found, found[1:]))
    got = sorted(map(tuple, token_files.digests(files).collect()))
    assert [r[0] for r in got] == list(range(200)) and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert {r["doc_id"] for r in token_files.read_documents(files, [3, 150, 999]).collect()} == {3, 150}
    empty = token_files.write(docs.limit(0), folder + "x", WORD_BPE)
    assert token_files.digests(empty).count() == 0


def test_damage_is_found():
    out = io.BytesIO()
    token_files.write_file(out, iter([(1, b"\1\0\0\0" * 50), (2, b"\2\0\0\0")]))
    import pyarrow as pa

    data = bytearray(out.getvalue())
    assert token_files.TokenFile(pa.BufferReader(bytes(data))).read(1) == b"\2\0\0\0"
    data[8] ^= 255
    with pytest.raises(Exception):
        token_files.TokenFile(pa.BufferReader(bytes(data))).read(0)


def test_packing_is_best_fit_and_keeps_conflicts_apart(spark):
    rng = random.Random(3)
    n = 300
    lengths, sources, clusters = [rng.randint(1, 100) for _ in range(n)], [rng.choice([-1, 0, 0, 1, 2]) for _ in range(n)], [rng.choice([-1, -1, 0, 1]) for _ in range(n)]
    bins, at, left = packing.pack_group(lengths, sources, clusters, 100)
    state = []
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        fit = [(r, b) for b, (r, s, c) in enumerate(state) if r >= lengths[i] and sources[i] not in s - {-1} and clusters[i] not in c - {-1}]
        if not fit:
            state.append([100, set(), set()])
        b = min(fit)[1] if fit else len(state) - 1
        assert bins[i] == b
        state[b] = [state[b][0] - lengths[i], state[b][1] | {sources[i]}, state[b][2] | {clusters[i]}]
    assert left == [s[0] for s in state]
    items = spark.createDataFrame([(1, "a", 5, 250), (2, "a", 5, 40), (3, None, None, 50), (4, "b", 5, None), (None, "c", 1, 0), (2, "a", 5, 40)], "doc_id long, source string, cluster long, n_tokens long")
    got = packing.pack(items, 100).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["n_tokens"]) for r in got) == [(0, 0, 0), (1, 0, 100), (1, 1, 100), (1, 2, 50), (2, 0, 40), (2, 0, 40), (3, 0, 50), (4, 0, 0)]
    assert packing.pack(items.limit(0), 100).count() == 0


def test_added_tokens_get_their_ids_as_in_the_library_itself(spark):
    t, own, rng = Tokenizer.from_file(WORD_BPE), token_files.encoder_of(WORD_BPE), random.Random(9)
    signs = [*"abΣςé\u0301 \n.<|>'", "don't ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "</w>"]
    texts = TEXTS + ["end here <|endoftext|> next page"] + ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    docs = spark.createDataFrame([(i, "s", x) for i, x in enumerate(texts[:12])], "doc_id long, source string, text string")
    files = token_files.write(docs, "file://" + tempfile.mkdtemp(prefix="spark-"), WORD_BPE)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read(files).collect()}
    assert got == {i: x + [1] for i, x in enumerate(want[:12])}
    assert {r["doc_id"]: r["n_tokens"] for r in packing.measured(docs, WORD_BPE).collect()} == {i: len(x) + 1 if texts[i] else 0 for i, x in enumerate(want[:12])}


def test_texts_reach_the_tokenizer_in_small_batches(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'s' AS source", "'a b' AS text").coalesce(1)
    sizes = packing.measured(docs, WORD_BPE).select("doc_id", "source", "n_tokens")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), tempfile.mkdtemp(prefix="spark-")

    def watched(batches):
        for b in batches:
            open(f"{seen}/{b.num_rows}", "w").close()
            yield b

    watched_sizes = sizes.mapInArrow(watched, sizes.schema).selectExpr("*", "1L AS cluster")
    assert packing.pack(watched_sizes).count() == 5000 and spark.conf.get(key) == before
    assert max(map(int, os.listdir(seen))) <= packing.BATCH_ROWS


def test_packing_query_against_the_library(spark):
    """Lengths as the library counts them; no sequence over its capacity, none with two documents of one source or text."""
    data, t = "/root/testdata/sf0.001", Tokenizer.from_file(WORD_BPE)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {d: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 if r["text"] else 0 for d, r in docs.items()}
    got, bins, total = QUERIES["op10_packing"](spark, data).collect(), {}, {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        if r["bin"] >= 0:
            bins.setdefault((r["pack_group"], r["bin"]), []).append(r)
    assert total == want
    for rows in bins.values():
        of = [docs[r["doc_id"]] for r in rows]
        assert sum(r["n_tokens"] for r in rows) == packing.CAPACITY - rows[0]["residual"] and {r["residual"] for r in rows} == {rows[0]["residual"]}
        assert len({x["text"] for x in of}) == len(of) == len({x["source"] for x in of}) and sorted(r["place"] for r in rows) == list(range(len(rows)))
    rows = [(1, None, None), (2, "a", ""), (None, "b", "one two"), (None, "b", "one two"), (5, "c", "word " * 9000)]
    few = packing.measured(spark.createDataFrame(rows, "doc_id long, source string, text string"), WORD_BPE)
    assert sorted(r["n_tokens"] for r in few.collect()) == [0, 0, 3, 3, 9001] and packing.pack(few).where("doc_id = 5").count() == 5
