"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in an order drawn by hash, cut into blocks
of ``block_words``. Its target says how many words the mix takes: whole passes over its
blocks, then a part of one, each in its own permutation, the last block cut to the word.

All blocks drawn, of all sources, go to shards of equal size. The tree starts with all
shards and the number of blocks each source gives; a node hands its left half of shards as
many blocks of each source as a draw without replacement would, the rest goes right. So
quotas add up exactly at every node, and a leaf says which run of a source's draws its
shard gets. Runs are disjoint; within a shard, blocks are permuted once more. Nodes draw from
their own seed, so any part of the tree can be worked out anywhere, and again.

No step sees all documents of a source: offsets in a stream come from sums over buckets of
bounded size, and documents meet their draws by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded, staged
from ledgerlens.operators.ordering import dense_numbers

WEIGHTS = (5, 2, 1)
#: No target is more than so many times the size of its source.
MOST = 3
BLOCK_WORDS = 512
SHARD_BLOCKS = 4_096
SEED = 42

#: Rows of a bucket, and buckets of a group of them, over which offsets are added up.
BUCKET_ROWS = 8_192
GROUP_BUCKETS = 1_024
#: Sources up to which their table is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 100_000
#: Draws that a task numbers at a time.
DRAWS_AT_ONCE = 100_000
#: Numpy draws hypergeometric numbers below this many items.
_NUMPY_ITEMS = 10**9

_MASK = (1 << 64) - 1


# --- targets -----------------------------------------------------------------


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (with source_size and weight) and their target: shares of all words by
    weight, none above ``most`` times its source; what is cut off is shared by weight among
    the others, until none is above. Every round is one aggregate over the sources."""
    wide = "decimal(38,0)"
    cap, weight = (F.col("source_size") * most).cast("decimal(28,0)"), F.col("weight").cast("decimal(9,0)")
    total, weights = sources.agg(F.sum(F.col("source_size").cast(wide)), F.sum(F.col("weight").cast(wide))).first()
    words, shared, above = int(total or 0), int(weights or 0), -1
    over = F.lit(False)
    while shared:
        over = cap * F.lit(shared).cast("decimal(10,0)") < weight * F.lit(words).cast("decimal(28,0)")
        kept, left, n = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, weight)), F.count_if(over)).first()
        if n == above:
            break
        words, shared, above = int(total) - int(kept or 0), int(left or 0), n
    share = F.lit(float(words)) * F.col("weight") / F.lit(float(shared or 1))
    return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(share) if shared else cap.cast("double"))


def _with_draws(sources: DataFrame, most: int, block_words: int) -> DataFrame:
    """How a source's target is drawn: ``passes`` over all its blocks (``full`` whole ones and a
    ``tail`` of words), then ``part`` whole blocks and ``rest`` words of one more."""
    size, words = F.col("source_size"), F.lit(block_words).cast("long")
    whole = lambda a, b: F.floor(a / b).cast("long")
    return (
        sources.withColumn("take", F.least(F.round("target").cast("long"), size * most))
        .withColumn("passes", F.when(size > 0, F.expr("take div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("take") - F.col("passes") * size)
        .withColumns({"full": whole(size - size % words, words), "tail": size % words, "part": whole(F.col("left") - F.col("left") % words, words), "rest": F.col("left") % words})
        .withColumn("per_pass", F.col("full") + (F.col("tail") > 0).cast("long"))
        .withColumn("draws", F.col("passes") * F.col("per_pass") + F.col("part") + (F.col("rest") > 0).cast("long"))
        .drop("left")
    )


# --- the tree ----------------------------------------------------------------


def hypergeometric(random: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items, out of good and bad ones, are good; exact for any numbers.

    With more items than numpy allows, each is first taken with the same probability; too
    many or too few were taken then by d, about the root of ``drawn``, and d of the taken (or
    of the others) are drawn in the same way to be put back (or added).
    """
    if not good or not drawn:
        return 0
    if not bad or drawn == good + bad:
        return min(good, drawn)
    if good + bad < _NUMPY_ITEMS:
        return int(random.hypergeometric(good, bad, drawn))
    share = drawn / (good + bad)
    taken, others = int(random.binomial(good, share)), int(random.binomial(bad, share))
    excess = taken + others - drawn
    if excess > 0:
        return taken - hypergeometric(random, taken, others, excess)
    return taken + hypergeometric(random, good - taken, bad - others, -excess)


def split(random: np.random.Generator, counts: list[int], drawn: int) -> list[int]:
    """``drawn`` items out of ``counts`` without replacement, by source."""
    left, out = sum(counts), []
    for count in counts:
        found = hypergeometric(random, count, left - count, drawn)
        out.append(found)
        left, drawn = left - count, drawn - found
    return out


@dataclass(frozen=True)
class Tree:
    """Splits ``draws`` blocks over ``shards`` shards, whose sizes differ by one at most."""

    draws: int
    shards: int
    seed: int

    def before(self, shard: int) -> int:
        """Blocks in all shards before this one."""
        return self.draws * shard // self.shards

    def nodes(self, low: int, high: int, counts: list[int], firsts: list[int], width: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """(low, high, counts, first draws) of the nodes of ``width`` shards at most below one."""
        if high - low <= width:
            yield low, high, counts, firsts
            return
        middle = (low + high) // 2
        random = np.random.default_rng([self.seed, low, high])
        left = split(random, counts, self.before(middle) - self.before(low))
        yield from self.nodes(low, middle, left, firsts, width)
        right = [a - b for a, b in zip(counts, left, strict=True)]
        yield from self.nodes(middle, high, right, [a + b for a, b in zip(firsts, left, strict=True)], width)


_NODES = "low long, high long, ix long, draws long, first long"


def quotas(sources: DataFrame, tree: Tree) -> DataFrame:
    """(low, high, ix, draws, first) with one shard from low to high: how many draws of source ``ix`` it
    gets, from which on. Two steps of about the root of all shards each, so no task holds more
    than that times the number of sources."""

    def below(width: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("ix")
            low, high, ixs = int(group["low"].iloc[0]), int(group["high"].iloc[0]), group["ix"].tolist()
            rows = [
                (a, b, ix, n, first)
                for a, b, counts, firsts in tree.nodes(low, high, group["draws"].tolist(), group["first"].tolist(), width)
                for ix, n, first in zip(ixs, counts, firsts, strict=True)
                if n
            ]
            return pd.DataFrame(rows, columns=["low", "high", "ix", "draws", "first"])

        return run

    root = sources.where("draws > 0").select(
        F.lit(0).cast("long").alias("low"), F.lit(tree.shards).cast("long").alias("high"), "ix", "draws", F.lit(0).cast("long").alias("first")
    )
    upper = root.groupBy("low", "high").applyInPandas(below(max(1, isqrt(tree.shards))), _NODES)
    return upper.groupBy("low", "high").applyInPandas(below(1), _NODES)


# --- permutations and draws --------------------------------------------------


def permuted(at: np.ndarray, size: int, *key: int) -> np.ndarray:
    """Where the numbers ``at`` below ``size`` go in a permutation that ``key`` names: a Feistel
    network on the next even number of bits, walked on while it leaves the range."""
    if size <= 1:
        return at.astype(np.int64)
    half = np.uint64(((int(size) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << int(half)) - 1)
    keys = np.random.SeedSequence([k & _MASK for k in key]).generate_state(4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & low)
        return (left << half) | right

    out = once(at.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


DRAWS = "shard long, slot long, ix long, pass long, block long, block_words long"


def draws(quota: DataFrame, sources: DataFrame, tree: Tree, block_words: int) -> DataFrame:
    """``DRAWS``: every block drawn, with its place in a shard and the words it gives."""
    held = quota.withColumn("at", F.sum("draws").over(Window.partitionBy("low").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)))
    known = bounded(sources.select("ix", "passes", "full", "tail", "part", "rest", "per_pass"), BROADCAST_SOURCES)
    held = held.join(known, "ix").select(
        F.col("low").alias("shard"), "ix", "first", "draws", F.coalesce("at", F.lit(0)).cast("long").alias("at"),
        "passes", "full", "tail", "part", "rest", "per_pass",
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q in frame.itertuples():
                places = tree.before(q.shard + 1) - tree.before(q.shard)
                for low in range(0, q.draws, DRAWS_AT_ONCE):
                    drawn = np.arange(low, min(low + DRAWS_AT_ONCE, q.draws), dtype=np.int64)
                    passed, at = np.divmod(q.first + drawn, q.per_pass)
                    block = at.copy()
                    for one in np.unique(passed):
                        # The tail, shorter than the rest, comes last in every pass.
                        mine = (passed == one) & (at < q.full)
                        block[mine] = permuted(at[mine], q.full, tree.seed, q.ix, int(one))
                    words = np.where(at == q.full, q.tail, block_words)
                    words[(passed == q.passes) & (at == q.part)] = q.rest
                    slot = permuted(q.at + drawn, places, tree.seed, -1, q.shard)
                    yield pd.DataFrame({"shard": q.shard, "slot": slot, "ix": q.ix, "pass": passed, "block": block, "block_words": words})

    return held.mapInPandas(run, DRAWS)


# --- documents ---------------------------------------------------------------


def _offsets(rows: DataFrame) -> DataFrame:
    """``rows`` (ix, bucket, hash, ..., words) with ``begin``: the words of the source before them.
    Sums run within buckets, over the buckets of a group, and over groups."""
    before = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0)).cast("long")
    cluster = F.floor(F.col("bucket") / GROUP_BUCKETS).cast("long")
    buckets = staged(rows.groupBy("ix", "bucket").agg(F.sum("words").alias("words")).withColumn("cluster", cluster), "buckets")
    clusters = buckets.groupBy("ix", "cluster").agg(F.sum("words").alias("words"))
    clusters = clusters.select("ix", "cluster", prior("words", before(["ix"], "cluster")).alias("cluster_begin"))
    buckets = buckets.withColumn("in_cluster", prior("words", before(["ix", "cluster"], "bucket"))).join(clusters, ["ix", "cluster"])
    starts = buckets.select("ix", "bucket", (F.col("in_cluster") + F.col("cluster_begin")).alias("bucket_begin"))
    inner = prior("words", before(["ix", "bucket"], "hash", "doc_id", "identity", "size"))
    return rows.withColumn("in_bucket", inner).join(starts, ["ix", "bucket"]).withColumn("begin", F.col("in_bucket") + F.col("bucket_begin"))


@dataclass(frozen=True)
class Mix:
    """``sources``: ix, source, source_size, weight, target, ...; ``documents``: one row per row
    mixed, with ix, doc_id, identity, size and begin, its first word in the source's stream;
    ``pieces``: what the mix holds, in order of shard, slot and offset: n_words words of a
    document from first_word on."""

    sources: DataFrame
    documents: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """doc_id, size, source, source_size, target and words taken, repeats counted, of every row."""
        words = self.pieces.groupBy("ix", "begin").agg(F.sum("n_words").alias("words"))
        known = bounded(self.sources.select("ix", "source", "source_size", "target"), BROADCAST_SOURCES)
        # Rows without words share a begin with the next row; nothing is taken of them.
        none = self.documents.where("size = 0").withColumn("words", F.lit(0).cast("long"))
        counted = self.documents.where("size > 0").join(words, ["ix", "begin"], "left").unionByName(none)
        taken = F.coalesce("words", F.lit(0)).cast("long").alias("taken")
        return counted.join(known, "ix").select("doc_id", "size", "source", "source_size", "target", taken)

    def texts(self, docs: DataFrame, identity: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
        """shard, slot, text: the blocks themselves, words joined by one space. A block has at
        most ``block_words`` pieces."""
        words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
        # Rows that agree in key and identity have one text.
        held = docs.select(F.col(key).cast("long").alias("_id"), identity.alias("_identity"), F.col(text).alias("_text")).groupBy("_id", "_identity")
        held = held.agg(F.first("_text").alias(text))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("identity") == F.col("_identity"))
        part = F.array_join(F.slice(words, F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")), " ")
        cut = self.pieces.join(held, same).select("shard", "slot", "offset", part.alias("part"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda p: p["part"])
        return cut.groupBy("shard", "slot").agg(F.array_join(ordered, " ").alias("text"))


def mix(
    docs: DataFrame, n_words: Column, source: Column, identity: Column, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> Mix:
    """Mix all rows of ``docs``.

    ``weights`` go to the sources in order of code points, null last, over and over.
    ``identity`` tells rows of one key apart (a hash of the text): rows that agree in key,
    source, size and identity are laid out together, so one key, or one row repeated, may hold a
    third of all rows. A row of no words (null or empty text) takes part with nothing; a null
    key is kept. An empty table, or one without words, gives an empty mix. The result
    depends on the rows and the seed alone, not on how they are stored.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), source.cast("string").alias("source"), identity.cast("long").alias("identity"),
        F.greatest(F.coalesce(n_words.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
    )
    rows = staged(rows.groupBy("doc_id", "source", "identity", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    numbered = dense_numbers(sums, [F.col("source").asc_nulls_last()], "place").withColumn("ix", F.col("place") - 1).drop("place")
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ix") % len(weights) + 1).cast("int"))
    numbered = staged(numbered.withColumn("weight", given), "sources")
    sources = staged(_with_draws(with_targets(numbered, most), most, block_words), "targets")

    known = bounded(sources.select(F.col("source").alias("_source"), "ix", "rows"), BROADCAST_SOURCES)
    hashed = F.xxhash64(F.lit(seed), "doc_id", "identity")
    laid = (
        rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("hash", hashed)
        .withColumn("bucket", F.pmod("hash", F.ceil(F.col("rows") / BUCKET_ROWS)))
        .select("ix", "bucket", "hash", "doc_id", "identity", "size", "copies", (F.col("size") * F.col("copies")).alias("words"))
    )
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    documents = _offsets(laid).select("ix", "doc_id", "identity", "size", "begin", copy.alias("copy"))
    documents = staged(documents.select("ix", "doc_id", "identity", "size", (F.col("begin") + F.col("copy") * F.col("size")).alias("begin")), "layout")

    total = sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    tree = Tree(total, max(1, -(-total // shard_blocks)), seed)
    drawn = draws(quotas(sources, tree), sources, tree, block_words)
    end = F.col("begin") + F.col("size")
    number = lambda c: F.floor((c - c % block_words) / block_words).cast("long")
    parts = documents.where("size > 0").select("*", F.explode(F.sequence(number(F.col("begin")), number(end - 1))).alias("block"))
    start, stop = F.greatest(F.col("begin"), F.col("block") * block_words), F.least(end, (F.col("block") + 1) * block_words)
    parts = parts.select(
        "ix", "block", "doc_id", "identity", "begin", (start - F.col("block") * block_words).alias("offset"),
        (start - F.col("begin")).alias("first_word"), (stop - start).alias("words"),
    )
    pieces = (
        parts.join(drawn, ["ix", "block"])
        .withColumn("n_words", F.least(F.col("words"), F.col("block_words") - F.col("offset")))
        .where("n_words > 0")
        .select("shard", "slot", "offset", "ix", "pass", "doc_id", "identity", "begin", "first_word", "n_words")
    )
    return Mix(sources, documents, pieces)
