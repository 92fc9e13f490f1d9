import hashlib

import corpus_pipeline
from junctura.llm import toxicity
from junctura.llm.common import table

from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_suffix_dedup import brute as suffix_brute

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    stages = dict(corpus_pipeline.STAGES)
    tagger = toxicity.fit(docs, table(spark, DATA, "labels"))
    mild = {r["doc_id"]: r["text"] for r in docs.collect() if tagger.scores([r["text"] or ""])[0] < 0.5}
    clean = stages["toxicity"](spark, docs, DATA).cache()
    assert clean.columns == docs.columns and {r["doc_id"]: r["text"] for r in clean.collect()} == mild
    want = {r[0] for r in near_brute(list(mild.items())) if r[3]}
    single = stages["near_dedup"](spark, clean, DATA).cache()
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == docs.columns and kept == {d: mild[d] for d in want}
    cut = stages["suffix_dedup"](spark, single, DATA).cache()
    want_cut = {r[0]: (r[2], r[4]) for r in suffix_brute(list(kept.items()))}
    assert cut.columns == docs.columns
    compared = 0
    for r in cut.collect():
        removed, sha = want_cut[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
        if not removed:
            assert r["text"] == (kept[r["doc_id"]] or "")
        elif "\ufffd" not in r["text"]:  # what is left is whole characters, which the hash of the remaining bytes holds for
            assert hashlib.sha256(r["text"].encode()).hexdigest() == sha
            compared += 1
    assert compared >= 5
    packed = stages["packing"](spark, cut, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "packing"]


def test_stages_on_odd_tables(spark):
    """Null and empty texts, repeated rows, an empty table, and columns whose names the operators use."""
    docs = table(spark, DATA, "documents")
    odd = docs.where("doc_id < 3").selectExpr("doc_id", "text", "lang", "source", "n_chars")
    odd = odd.union(spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "web", 0), (902, "one two", "en", "web", 7)], odd.schema))
    odd = odd.union(odd.where("doc_id = 902")).selectExpr("*", "1 AS row", "'x' AS score", "2 AS component_id", "3 AS kept")
    for rows in (odd, odd.limit(0)):
        here = rows
        for name, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, here, DATA).cache()
            assert out.columns == here.columns, name
            found = {r["doc_id"] for r in out.collect()}
            assert found <= {r["doc_id"] for r in here.collect()} and (name == "toxicity" or {900, 901} <= found or not here.count()), name
            here = out
        packed = corpus_pipeline.STAGES[3][1](spark, here, DATA)
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in here.collect()}
