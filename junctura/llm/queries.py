"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm import ann_search, bpe, html_text, merkle, near_dedup, packing, prefix_trie, sharding, suffix_dedup, token_files, topk_search, toxicity, url_filter
from junctura.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False, spans=False)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs, BYTE_BPE, public_tokenizers.PATTERN).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("row.page_id", "row.url", "text", "n_chars")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).drop("source")


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(table(spark, sf_dir, "embeddings"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components_of(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(table(spark, sf_dir, "documents"), WORD_BPE))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.verify(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.listed_rules(spark, url_filter.RULES)).select("row.page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_byte_bpe, op3_token_files, op4_toxicity, op5_html_text, op6_sharding, op7_ann_search, op8_topk_search, op9_near_dedup, op10_packing, op11_prefix_trie, op12_merkle_manifest, op13_url_filter)}



def _crc32(number: str) -> str:
    """SQL for the unsigned crc32 of a number's decimal digits."""
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {byte}))"


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen(CAST({x} AS VARCHAR)), ':', {x}) END"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _tree(name: str, leaves: str) -> str:
    """SQL for the levels of trees over leaves (g, idx, n, hash): at each level every node's parent and the siblings to both sides."""
    return f"""{name} AS (
            SELECT g, 0 AS level, idx, n, hash FROM {leaves}
            UNION ALL
            SELECT g, level + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, level, idx // 3
        ),
        {name}_steps AS (
            SELECT a.g, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
            FROM {name} a JOIN {name} b ON a.g = b.g AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
        )"""


ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT c, {_crc32("c")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
        parts AS (
            SELECT k.c, 0 AS own, t.i, t.role, t.text FROM convs k JOIN t ON t.c = k.c - k.c % 20 AND t.i < k.h
            UNION ALL SELECT k.c, 1, t.i, t.role, t.text FROM convs k JOIN t ON t.c = k.c AND t.i >= k.h
        ),
        r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, role, text FROM parts),
        ids AS (SELECT *, dense_rank() OVER (ORDER BY role, text) AS id FROM r),
        lists AS (SELECT c, list(id ORDER BY d) AS ids FROM ids GROUP BY c),
        paths AS (
            SELECT c, CAST(0 AS BIGINT) AS d, [] AS path, '' AS text, coalesce(len(ids), 0) AS most FROM convs LEFT JOIN lists USING (c)
            UNION ALL SELECT c, ids.d, list_slice(lists.ids, 1, ids.d), ids.text, len(lists.ids) FROM ids JOIN lists USING (c)
        ),
        nodes AS (
            SELECT d, path, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * max(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS saved,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (most = d), '')) AS ends
            FROM paths GROUP BY d, path
        ),
        kin AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND list_slice(k.path, 1, n.d) = n.path) AS children FROM nodes n),
        below AS (SELECT a.path, a.d, sum(b.saved) AS saved, count(CASE WHEN b.children = 0 THEN 1 END) AS leaves FROM kin a JOIN kin b ON b.d >= a.d AND list_slice(b.path, 1, a.d) = a.path GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.children AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
        FROM kin n JOIN below b ON b.d = n.d AND b.path = n.path LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = list_slice(n.path, 1, n.d - 1)
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE docs AS (
            SELECT *, {_leaf("text")} AS leaf, {_leaf("altered")} AS other FROM (SELECT *, CASE WHEN {_crc32("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS altered FROM documents)
        ),
        leaves AS (
            SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, leaf AS hash, leaf, other FROM docs
        ),
        {_tree("nodes", "leaves")},
        subroots AS (SELECT 0 AS g, nodes.g AS idx, count(*) OVER () AS n, hash FROM nodes WHERE n = 1),
        {_tree("tops", "subroots")},
        high AS (SELECT s.idx AS g, s.hash AS subroot, list(struct_pack(l := t.l, r := t.r) ORDER BY t.level) FILTER (t.level IS NOT NULL) AS steps FROM subroots s LEFT JOIN tops_steps t ON t.idx = s.idx // CAST(3 ** t.level AS BIGINT) GROUP BY ALL),
        low AS (SELECT x.doc_id, x.g, x.leaf, x.other, list(struct_pack(l := s.l, r := s.r) ORDER BY s.level) FILTER (s.level IS NOT NULL) AS steps FROM leaves x LEFT JOIN nodes_steps s ON s.g = x.g AND s.idx = x.idx // CAST(3 ** s.level AS BIGINT) GROUP BY ALL),
        full_ AS (SELECT doc_id, leaf, other, subroot, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps, (SELECT hash FROM tops WHERE n = 1) AS root FROM low JOIN high USING (g)),
        folded AS (SELECT *, list_reduce(list_concat([struct_pack(l := other, r := '')], steps), lambda h, s: struct_pack(l := sha256(concat(s.l, h.l, s.r)), r := ''))['l'] AS folded_root FROM full_)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: concat(s.l, s.r)), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
    """,
    "op13_url_filter": r"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM p),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(h, b, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        met AS (SELECT page_id, max_by(concat(h, b), length(h) + length(b)) AS rule, max_by(action, length(h) + length(b)) AS action FROM parts JOIN rules ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, b) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN met USING (page_id)
    """,
    "op8_topk_search": """
        WITH v AS (
            SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY embedding) AS copy, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, q.copy, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, copy ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
