"""A Merkle manifest of a table: leaves by source, subroots, one root, and proofs that are looked up by coordinate.

A node is named by its group (a source, or the tree of the subroots), level and index. Of a leaf at index i in a group of n the
siblings at level k are the others of the run of ARITY that i div ARITY^k stands in, as far as the level reaches; a leaf
lists these coordinates, joins the table of nodes, puts what it finds in order and folds it.

Levels are made and looked up by bands of BAND: a block of ARITY^BAND nodes is one row, and what stands above a block is looked up
once for the block, not for each leaf of it. So a coordinate is asked for by at most ARITY^BAND leaves, however large its source is.

Null doc_id, source, lang, n_chars or text: the field is `-`; a null source is a source of its own, the first, and null ids come first
in it. Rows with equal source and doc_id stand in the order of their leaves, so repeated rows each have a place. An empty text is
`0:`. Texts of any length are hashed as they are read and not carried further. An empty table has no manifest rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, BAND = 3, 4
BLOCK = ARITY**BAND
_STEP = "array<struct<left:string,right:string>>"


def digest(x: Column) -> Column:
    return F.sha2(x.cast("string"), 256)


def leaf(values: list[Column]) -> Column:
    """The hash of fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and altered, the leaf with `tampered` as text (the leaf itself if none is given), gid (number of the source), idx and size."""
    own = leaf([docs[c] for c in FIELDS])
    changed = ~tampered.eqNullSafe(docs["text"]) if tampered is not None else F.lit(False)
    other = F.when(changed, leaf([*[docs[c] for c in FIELDS[:-1]], tampered if tampered is not None else docs["text"]]))
    hashed = checkpoint(docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), own.alias("leaf"), other.alias("altered")))
    placed = checkpoint(ranked(hashed, ["source"], ["doc_id", "leaf"]).withColumn("altered", F.coalesce("altered", "leaf")))
    names = ranked(placed.where("idx = 0").select("source"), [], ["source"]).select(F.col("source").alias("_source"), F.col("idx").alias("gid"), F.col("size").alias("sources"))
    # a source meets its number block by block, so that no task has all rows of one
    numbers = placed.where("idx = 0").select("source", "size").join(names, F.col("source").eqNullSafe(F.col("_source")))
    numbers = numbers.select("_source", "gid", "sources", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {BLOCK}"))).alias("_block"))
    met = placed["source"].eqNullSafe(numbers["_source"]) & (F.expr(f"idx div {BLOCK}") == numbers["_block"])
    return placed.join(numbers, met).drop("_source", "_block")


def _levels(n: Column) -> Column:
    """How many levels of a band that begins with n nodes have siblings in them."""
    return sum(((n > ARITY**k).cast("int") for k in range(1, BAND)), (n > 1).cast("int"))


def _above(n: Column, k: int) -> Column:
    """The number of nodes k levels above n nodes."""
    return F.floor((n + (ARITY**k - 1)) / ARITY**k) if k else n


def _joined(level: Column) -> Column:
    """The nodes above a level: one for each run of ARITY."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * ARITY + 1, ARITY), "")))


def _blocks(rows: DataFrame) -> DataFrame:
    """gid, block, n, and the nodes of each level of the block: a0 to a<BAND>; where a level is a single node it is the last."""
    x = rows.groupBy("gid", F.expr(f"idx div {BLOCK}").alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("a"))
    x = x.select("gid", "block", "n", F.transform("a", lambda s: s["hash"]).alias("a0"))
    for k in range(BAND):
        here = F.col(f"a{k}")
        x = x.withColumn(f"a{k + 1}", F.when(_above(F.col("n"), k) > 1, _joined(here)).otherwise(here))
    return x


def nodes(blocks: DataFrame) -> DataFrame:
    """gid, level, idx and hash of the nodes of a band that may be siblings."""

    def level(k: int) -> Column:
        named = F.transform(f"a{k}", lambda h, i: F.struct(F.lit(k).alias("level"), (F.col("block") * ARITY ** (BAND - k) + i).alias("idx"), h.alias("hash")))
        return F.when(_above(F.col("n"), k) > 1, named).otherwise(F.slice(named, 1, 0))

    return blocks.select("gid", F.inline(F.concat(*map(level, range(BAND)))))


def tree(rows: DataFrame, most: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The bands of the trees over rows (gid, idx, n, hash), each as its lowest nodes and its materialised blocks, and
    gid, band (the last one of the group) and hash of each root. most: the largest n."""
    bands, roots = [], None
    while True:
        blocks = checkpoint(_blocks(rows))
        bands.append((rows, blocks))
        ended = blocks.where(F.col("n") <= BLOCK).select("gid", F.lit(len(bands) - 1).alias("band"), F.col(f"a{BAND}")[0].alias("hash"))
        roots = ended if roots is None else roots.union(ended)
        if most <= BLOCK:
            return bands, roots
        most = -(-most // BLOCK)
        rows = blocks.where(F.col("n") > BLOCK).select("gid", F.col("block").alias("idx"), _above(F.col("n"), BAND).alias("n"), F.col(f"a{BAND}")[0].alias("hash"))


def _steps(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """gid, idx, n and steps: for each level of the band the siblings to the left and to the right, concatenated."""

    def siblings(k: int) -> Column:
        at, n = F.floor(F.col("idx") / ARITY**k), _above(F.col("n"), k)
        first = at - at % ARITY
        others = F.filter(F.sequence(first, F.least(first + ARITY - 1, n - 1)), lambda s: s != at)
        return F.transform(F.when(n > 1, others).otherwise(F.slice(others, 1, 0)), lambda s: F.struct(F.lit(k).alias("level"), s.alias("sibling")))

    asked = rows.select("gid", "idx", "n", F.inline_outer(F.concat(*map(siblings, range(BAND)))))
    met = asked.join(nodes(blocks).withColumnRenamed("idx", "sibling"), ["gid", "level", "sibling"], "left")
    found = met.groupBy("gid", "idx", "n").agg(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("level", "sibling", "hash"))).alias("f"))
    here = F.sort_array("f")
    side = lambda k, left: F.array_join(F.transform(F.filter(here, lambda s: (s["level"] == k) & ((s["sibling"] < F.floor(F.col("idx") / F.pow(F.lit(ARITY), k))) == left)), lambda s: s["hash"]), "")
    each = F.transform(F.sequence(F.lit(0), F.lit(BAND - 1)), lambda k: F.struct(side(k, F.lit(True)).alias("left"), side(k, F.lit(False)).alias("right")))
    return found.select("gid", "idx", "n", F.slice(each, F.lit(1), _levels(F.col("n"))).alias("steps"))


def paths(bands: list[tuple[DataFrame, DataFrame]], heads: DataFrame) -> DataFrame:
    """gid, idx, path (steps from the node up to the root of all) and the other columns of heads, which has for each group gid, band and the path above it."""
    rest = [c for c in heads.columns if c not in ("gid", "band", "path")]
    over = None
    for b in reversed(range(len(bands))):
        ended = heads.where(F.col("band") == b).select("gid", F.lit(0).cast("long").alias("block"), F.col("path").alias("tail"), *rest)
        over = ended if over is None else ended.union(over.select("gid", F.col("idx").alias("block"), F.col("path").alias("tail"), *rest))
        own = _steps(*bands[b]).withColumn("block", F.expr(f"idx div {BLOCK}"))
        over = checkpoint(own.join(over, ["gid", "block"]).select("gid", "idx", F.concat("steps", "tail").alias("path"), *rest))
    return over


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, altered, gid, idx, path, subroot and root of each row."""
    placed = leaves(docs, tampered)
    rows = placed.select("gid", "idx", F.col("size").alias("n"), F.col("leaf").alias("hash"))
    most, sources = placed.agg(F.max("size"), F.max("sources")).first()
    bands, roots = tree(rows, most or 1)
    roots = checkpoint(roots)
    tops = roots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.lit(sources or 1).cast("long").alias("n"), "hash")
    above, root = tree(tops, sources or 1)
    ends = root.select("gid", "band", F.array().cast(_STEP).alias("path"), F.col("hash").alias("root"))
    heads = roots.join(paths(above, ends).select(F.col("idx").alias("gid"), "path", "root"), "gid").select("gid", "band", "path", F.col("hash").alias("subroot"), "root")
    found = paths(bands, heads)
    return placed.select("doc_id", "source", "leaf", "altered", "gid", "idx").join(found, ["gid", "idx"])


def verify(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the altered leaf and the path of the original) and verified."""
    m = manifest(docs, tampered)
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    x = m.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("altered"), F.col("path")).alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))
