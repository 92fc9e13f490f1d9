"""URL rules by a Bloom filter cascade.

A rule is a host and the beginning of a path, such as `example.net/en/`. What rules could name a url are its candidates: ends
of its host at label bounds with beginnings of its path. All candidates of the table are the universe. The first level of a cascade
encodes the listed ones among them; each further level encodes what the level before lets through wrongly, listed and other
keys in turn, until none is left. So the answer is exact for every key of the universe, and a url is judged inside its row.

A list whose cascade would be larger than LIMIT bytes is split by the hash of its keys; the parts are asked one after another, with
the rows written in between, so a task holds one part at a time.

Null urls, and those without `://`, have an empty host and path, no candidates and no rule. Hosts keep user and port. A url that no list names
is judged by the default. If two rules fit, the longer one counts (host and path together, then the host); a key on both
lists is blocked. Urls of any length have as many candidates as the rules have shapes (labels of a host, characters of a path). Repeated urls are
judged each; an empty table gives no rows. Columns of the input are kept in `row`, so no name clashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint

LIMIT = 32 << 20  # bytes of a cascade that is broadcast
LEVELS = 64  # a cascade halves at each level; more tell of keys with equal hashes
_BLOCK = 1024  # words of a filter that reach the driver in one row
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: block net/, allow example.net/en/, block example.com/de/, allow org/fr/
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host(url: Column) -> Column:
    """What stands after the first `://`, up to `/`, `?`, `#` or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What stands after the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def _places(h1: np.ndarray, h2: np.ndarray, level: int, probes: int, bits: int) -> np.ndarray:
    """The bits of each key, one row for each probe."""
    with np.errstate(over="ignore"):
        a = _mixed(h1.view(np.uint64) + np.uint64(level))
        step = _mixed(h2.view(np.uint64) ^ np.uint64(level << 32)) | np.uint64(1)
        return (_mixed(a[None, :] + np.arange(probes, dtype=np.uint64)[:, None] * step[None, :]) >> np.uint64(1)) % np.uint64(bits)


@dataclass
class Level:
    number: int
    probes: int
    bits: int
    words: np.ndarray

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = _places(h1, h2, self.number, self.probes, self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


@dataclass
class Cascade:
    levels: list[Level]
    part: int = 0
    parts: int = 1

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """For each key of the universe whether it is listed in this part of the list: the level that first lacks it tells."""
        answer, open_ = np.zeros(len(h1), bool), np.flatnonzero(h1 % self.parts == self.part)
        for level in self.levels:
            has = level.holds(h1[open_], h2[open_])
            answer[open_[~has]] = level.number % 2 == 0
            open_ = open_[has]
        answer[open_] = len(self.levels) % 2 == 1
        return answer

    def size(self) -> int:
        return sum(level.words.nbytes for level in self.levels)


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def hashed(keys: DataFrame) -> DataFrame:
    """key with two independent hashes."""
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _level(keys: DataFrame, number: int, probes: int, bits: int) -> Level:
    """A filter over keys: bits are set in the tasks and joined by word; blocks of words reach the driver, as many as LIMIT allows."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(_longs(batch, "h1"), _longs(batch, "h2"), number, probes, bits).ravel()
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    words = keys.select("h1", "h2").mapInArrow(set_bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    blocks = words.groupBy(F.expr(f"word div {_BLOCK}").alias("block")).agg(F.collect_list("word").alias("word"), F.collect_list("bit").alias("bit"))
    out = np.zeros(-(-bits // 64), np.uint64)
    for row in blocks.toLocalIterator():
        out[np.array(row["word"])] = np.array(row["bit"], np.int64).view(np.uint64)
    return Level(number, probes, bits, out)


def _let_through(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(_longs(batch, "h1"), _longs(batch, "h2"))))

    return checkpoint(keys.mapInArrow(keep, "h1 long, h2 long"))


def cascade(listed: DataFrame, others: DataFrame, part: int = 0, parts: int = 1) -> Cascade:
    """The cascade that tells listed from others, two sets of distinct keys (h1, h2) without a common one; of both only this part of the keys."""
    listed, others = (k.where(F.pmod("h1", F.lit(parts)) == part) for k in (listed, others))
    n, rest = listed.count(), others.count()
    levels: list[Level] = []
    if not n:
        return Cascade(levels, part, parts)
    wrong = min(0.5, n * math.sqrt(0.5) / max(rest, 1))  # of the first level; the others let half through
    inside, outside = listed, others
    while n:
        if len(levels) == LEVELS:
            raise ValueError("a listed and another key have the same hashes")
        probes = max(1, round(-math.log2(wrong)))
        level = _level(inside, len(levels) + 1, probes, max(64, math.ceil(n * probes / math.log(2))))
        levels.append(level)
        inside, outside = _let_through(outside, level), inside
        n, wrong = inside.count(), 0.5
    return Cascade(levels, part, parts)


def expected_bytes(listed: int, others: int) -> int:
    """About how many bytes a cascade has."""
    return math.ceil(listed * (max(1.0, math.log2(max(others, 1) / max(listed, 1)) + 0.5) / math.log(2) + 4) / 8)


def candidates(host_: Column, path_: Column, shapes: list[tuple[int, int]]) -> Column:
    """array<string>: the keys that rules of these shapes (labels, characters of the path) could have, the longest first."""
    labels, n = F.size(F.split(host_, r"\.")), F.char_length(path_)
    found = []
    for k, m in shapes:
        end = F.substring_index(host_, ".", -k)
        key = F.concat(end, F.left(path_, F.lit(m)))
        found.append(F.when((labels >= k) & (n >= m), F.struct(F.char_length(key).alias("n"), F.char_length(end).alias("h"), key.alias("key"))))
    kept = F.sort_array(F.filter(F.array(*found), lambda x: x.isNotNull()), asc=False)
    return F.transform(kept, lambda x: x["key"])


def _first_listed(part: Cascade, spark: SparkSession) -> Callable[[Column, Column], Column]:
    shared = spark.sparkContext.broadcast(part)

    @F.pandas_udf("int")
    def first(h1, h2):
        """The place of the first listed candidate, null if there is none."""
        sizes = np.array([len(x) for x in h1], np.int64)
        row, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        flat = lambda s: np.concatenate([np.asarray(x, np.int64) for x in s]) if len(row) else np.zeros(0, np.int64)
        hit = np.flatnonzero(shared.value.listed(flat(h1), flat(h2)))
        rows, at = np.unique(row[hit], return_index=True)
        out = np.full(len(sizes), -1, np.int64)
        out[rows] = hit[at] - starts[rows]
        return pd.Series(out, index=h1.index).astype("Int32").mask(out < 0)

    return first


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """row (all columns of pages), host, path, rule (host and path of the one that counts; else null) and verdict (allow or block) of each url.

    rules: host, path and action (allow or block).
    """
    spark = pages.sparkSession
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").distinct()
    # the shapes of rules are few: labels of a host by lengths of a path
    shapes = [tuple(r) for r in rules.select(F.size(F.split("host", r"\.")).alias("k"), F.char_length("path").alias("m")).distinct().collect()]
    x = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), host(pages[url]).alias("host"), path(pages[url]).alias("path"))
    if not shapes:
        return x.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidates(F.col("host"), F.col("path"), shapes)
    universe = checkpoint(hashed(x.select(F.explode(keys).alias("key")).distinct()))
    x = x.withColumn("keys", keys)
    x = x.withColumns({"h1": F.transform("keys", lambda k: F.xxhash64(k)), "h2": F.transform("keys", lambda k: F.xxhash64(F.lit(1), k))})
    for action in ("block", "allow"):
        mine = rules.where(F.col("action") == action).select(F.concat("host", "path").alias("key")).distinct()
        listed, others = universe.join(mine, "key", "left_semi").drop("key"), universe.join(mine, "key", "left_anti").drop("key")
        parts = max(1, -(-expected_bytes(mine.count(), universe.count()) // LIMIT))
        x = x.withColumn(action, F.lit(None).cast("int"))
        for part in range(parts):
            found = _first_listed(cascade(listed, others, part, parts), spark)
            x = x.withColumn(action, F.least(F.col(action), found("h1", "h2")))
            if parts > 1:
                x = checkpoint(x)
    best = F.least("block", "allow")
    verdict = F.when(best.isNull(), default).when(F.col("block") == best, "block").otherwise("allow")
    return x.select("row", "host", "path", F.get("keys", best).alias("rule"), verdict.alias("verdict"))


def listed_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")
