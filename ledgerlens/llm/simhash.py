"""Near duplicates by SimHash fingerprints, found with vantage-point trees.

Distinct fingerprints are partitioned by their distance to vantage points. Two that differ
in at most 3 of 64 bits differ in at most 1 bit of one 32-bit half, so there is a tree for each
half and the triangle bound has a radius of 1 (in general ``distance // 2``): a fingerprint is
stored in one leaf and also asked for in every leaf whose boundary is that near. Leaves are
shards that are solved independently and exactly on all 64 bits. Each gives links that
span its classes rather than all pairs, and the classes are joined by contracting the graph
of links, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import batches, bounded, staged, whole
from ledgerlens.session import checkpointed

SHINGLE, DISTANCE, SEED = 3, 3, 42

#: Bound of the sample the trees are built from; fingerprints a shard should hold.
SAMPLE, SHARD = 20_000, 4_096
#: Keys and digests to drop up to which they are broadcast to the texts; about 150 MB.
BROADCAST_KEYS = 1_000_000
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))

_CHUNK = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text, unsigned.

    Words are runs without ASCII white space, A-Z in lower case. A bit is set if it is set in
    more than half of the shingles' hashes, repeats included. Fewer words than a shingle are
    one shingle; no words give 0.
    """
    found = whole(text).encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, len(found) - shingle + 1
    totals = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _CHUNK):
        stop = min(n, start + _CHUNK)
        hashes = np.array([digest(join(found[i : i + shingle]), seed) for i in range(start, stop)], dtype="<u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in range(64) if 2 * totals[bit] > n)


def fingerprints(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Fingerprints of a text column as signed longs."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return hashed(text)


def hexadecimal(fingerprint: Column) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


@dataclass(frozen=True)
class Node:
    """Inside are fingerprints at most ``reach`` from the vantage point on the masked bits. A
    leaf has a number only."""

    leaf: int = -1
    vantage: int = 0
    reach: int = 0
    inside: Node | None = None
    outside: Node | None = None


def _apart(fingerprints: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fingerprints ^ vantage) & mask).astype(np.int16)


def build(sample: np.ndarray, mask: np.uint64, leaf_size: float, seed: int = 5) -> Node:
    """A tree whose leaves hold at most ``leaf_size`` of the sample, or fingerprints all
    equally far from every vantage point tried."""
    random, numbers = np.random.default_rng(seed), iter(range(1 << 30))

    def split(points: np.ndarray) -> Node:
        if len(points) > max(1.0, leaf_size):
            best = None
            for vantage in points[random.integers(0, len(points), 12)]:
                away = _apart(points, vantage, mask)
                # The split that leaves the fewest next to the boundary, then the most even.
                for reach in np.unique(np.quantile(away, (0.35, 0.5, 0.65)).astype(int)):
                    k = int((away <= reach).sum())
                    if 0 < k < len(points):
                        near = int(((away >= reach) & (away <= reach + 1)).sum())
                        cost = near + 0.5 * abs(len(points) - 2 * k)
                        if best is None or cost < best[0]:
                            best = cost, int(vantage), int(reach), away <= reach
            if best:
                _, vantage, reach, inside = best
                return Node(-1, vantage, reach, split(points[inside]), split(points[~inside]))
        return Node(next(numbers))

    return split(np.sort(sample))


def leaves(tree: Node, fingerprints: np.ndarray, mask: np.uint64, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf that is a home or within ``radius`` of one: its number, the positions of the
    fingerprints that reach it, and whether it is their home."""
    todo = [(tree, np.arange(len(fingerprints)), np.ones(len(fingerprints), dtype=bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node.leaf >= 0:
            yield node.leaf, at, home
            continue
        away = _apart(fingerprints[at], np.uint64(node.vantage), mask)
        inside = away <= node.reach
        near = away <= node.reach + radius
        todo.append((node.inside, at[near], (home & inside)[near]))
        far = away > node.reach - radius
        todo.append((node.outside, at[far], (home & ~inside)[far]))


def _routes(trees: list[Node], radius: int):
    """Rows (tree, leaf, fingerprint, home). A guest goes only to leaves numbered below its
    home, since the other fingerprint of a pair makes the way back."""

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 20_000):
            points = frame["fingerprint"].to_numpy(dtype=np.int64).view(np.uint64)
            for number, (tree, mask) in enumerate(zip(trees, HALVES, strict=True)):
                found = list(leaves(tree, points, mask, radius))
                own = np.zeros(len(points), dtype=np.int64)
                for leaf, at, home in found:
                    own[at[home]] = leaf
                kept = [(leaf, at[home | (leaf < own[at])], home[home | (leaf < own[at])]) for leaf, at, home in found]
                if kept:
                    yield pd.DataFrame(
                        {
                            "tree": number,
                            "leaf": np.concatenate([np.full(len(at), leaf, dtype=np.int64) for leaf, at, _ in kept]),
                            "fingerprint": points[np.concatenate([at for _, at, _ in kept])].view(np.int64),
                            "home": np.concatenate([home for _, _, home in kept]),
                        }
                    )

    return routed


class Classes:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], dtype=np.int64)


def shard_links(stored: np.ndarray, asking: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the classes of all pairs of an asking and a stored fingerprint at most
    ``distance`` bits apart: each fingerprint that has a class with its first member."""
    points = np.unique(np.concatenate([stored, asking]))
    left, right = np.searchsorted(points, asking), np.searchsorted(points, stored)
    classes = Classes(len(points))
    step = max(1, 2_000_000 // max(1, len(stored)))
    for start in range(0, len(asking), step):
        near = np.bitwise_count(asking[start : start + step, None] ^ stored[None, :]) <= distance
        a, b = np.nonzero(near)
        a, b = left[start : start + step][a], right[b]
        labels = classes.roots()
        u, v = labels[a], labels[b]
        for pair in np.unique(np.stack([u, v], axis=1)[u != v], axis=0).tolist():
            classes.join(*pair)
    labels = classes.roots()
    member = labels != np.arange(len(points))
    return points[member], points[labels[member]]


def _shard(distance: int):
    def linked(shard: pd.DataFrame) -> pd.DataFrame:
        points = shard["fingerprint"].to_numpy(dtype=np.int64).view(np.uint64)
        stored = shard["stored"].to_numpy(dtype=bool)
        asks = shard["asks"].to_numpy(dtype=bool)
        a, b = shard_links(points[stored], points[asks], distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return linked


def links(distinct: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links a, b that span the classes of distinct fingerprints (column fingerprint).

    A leaf that holds more than two shards' worth, such as one of many fingerprints with the
    same half, is cut into blocks by hash, and so are those who ask there; every block of
    these meets every block of the stored ones, so that no task holds more than two blocks.
    """
    n = distinct.count()
    rows = distinct.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(sample).collect()
    points = np.array([r["fingerprint"] for r in rows], dtype=np.int64).view(np.uint64)
    trees = [build(points, mask, shard * len(points) / max(1, n)) for mask in HALVES]
    routed = distinct.select("fingerprint").mapInPandas(_routes(trees, distance // 2), "tree int, leaf long, fingerprint long, home boolean")
    routed = staged(routed, "routes")
    # A leaf without a home has no one to find.
    size = routed.groupBy("tree", "leaf").agg(
        F.ceil(F.count_if("home") / F.lit(2 * shard)).cast("int").alias("blocks"), F.ceil(F.count("*") / F.lit(4 * shard)).cast("int").alias("sides")
    ).where("blocks > 0")
    number = F.xxhash64("fingerprint")
    own, side = F.pmod(number, F.col("blocks")).cast("int"), F.pmod(F.xxhash64(number), F.col("sides")).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda block, side, stored, asks: F.struct(block.alias("block"), side.alias("side"), stored.alias("stored"), asks.alias("asks"))
    # Those who ask do so once in each block of the stored ones; these stand in each other side's.
    asking = F.transform(up_to("blocks"), lambda n: at(n, side, F.col("home") & (n == own), F.lit(True)))
    storing = F.transform(F.filter(up_to("sides"), lambda n: n != side), lambda n: at(own, n, F.lit(True), F.lit(False)))
    places = F.concat(asking, F.when(F.col("home"), storing).otherwise(F.slice(storing, 1, 0)))
    placed = routed.join(size, ["tree", "leaf"]).select("tree", "leaf", "fingerprint", F.explode(places).alias("at"))
    asked = placed.select("tree", "leaf", "at.block", "at.side", "fingerprint", "at.stored", "at.asks")
    return asked.groupBy("tree", "leaf", "block", "side").applyInPandas(_shard(distance), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component for the nodes of undirected edges a, b; ``component`` is one of the
    nodes of the class.

    Each round maps a node to its neighbour (or itself) with the smallest hash and drops the
    edges that became loops, so that a constant share of nodes goes in a round. What a
    round gives is checkpointed.
    """
    left = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    labels = checkpointed(
        left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node"))
    )
    round_number = 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("x", "y")
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(round_number)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        smallest = both.groupBy("x").agg(F.min(F.least(ranked("x"), ranked("y")))["n"].alias("to"))
        smallest = checkpointed(smallest)
        labels = checkpointed(
            labels.join(smallest, F.col("component") == F.col("x"), "left").select("node", F.coalesce("to", "component").alias("component"))
        )
        first, second = smallest.toDF("xa", "ta"), smallest.toDF("xb", "tb")
        left = checkpointed(
            left.join(first, F.col("a") == F.col("xa")).join(second, F.col("b") == F.col("xb"))
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct()
        )
        round_number += 1
    return labels


def classify(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (signed long), component_id, the smallest
    key whose fingerprint can be reached.

    Texts without words, null ones too, have fingerprint 0 and link with one another. Rows
    with a null key have a component like others and give it no key; a component without any
    key has a null one. ``distance`` below 4 is exact with the two trees.
    """
    prints = docs.select(F.col(key).alias("doc_id"), fingerprints(F.col(text), shingle, seed).alias("fingerprint"))
    return _labelled(prints, distance).select("doc_id", "fingerprint", "component_id")


def _labelled(prints: DataFrame, distance: int) -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with the component, one of its fingerprints and so
    never null, and component_id."""
    rows = staged(prints, "fingerprints")
    first = staged(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    classes = components(links(first.select("fingerprint"), distance))
    known = first.join(classes, first["fingerprint"] == classes["node"], "left").select(
        first["fingerprint"].alias("print"), "least", F.coalesce("component", first["fingerprint"]).alias("component")
    )
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(known.join(ids, "component").select("print", "component", "component_id"), "classes")
    return rows.join(named, rows["fingerprint"] == named["print"])


def _digest(text: str) -> Column:
    """Tells texts apart, also null from empty."""
    return F.coalesce(F.md5(F.col(text)), F.lit(""))


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED,
) -> DataFrame:
    """``docs`` with one row of each component, all columns as they are: the one with the
    smallest key, any key before null, and of several texts under that key the one with the
    smallest digest. Rows that share a key, also the null key, but no component all stay.

    The rows to drop, not those to keep, are joined to the texts.
    """
    prints = docs.select(F.col(key).alias("doc_id"), _digest(text).alias("digest"), fingerprints(F.col(text), shingle, seed).alias("fingerprint"))
    # Equal texts have one component, so a key and digest have one.
    rows = staged(_labelled(prints, distance).groupBy("doc_id", "digest").agg(F.min("component").alias("component"), F.count("*").alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = rows.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    chosen = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    keys = staged(chosen.select(F.col("doc_id").alias("k"), F.col("digest").alias("d"), "n", F.col("first_digest").isNotNull().alias("kept")), "keys")
    left = docs.join(bounded(keys.where("NOT kept").select("k", "d").toDF("gone_id", "gone_digest"), BROADCAST_KEYS), _is(key, text, "gone"), "left_anti")
    return _one_of_each(left, keys.where("kept AND n > 1").select("k", "d"), key, text)


def _is(key: str, text: str, name: str) -> Column:
    return F.col(key).eqNullSafe(F.col(f"{name}_id")) & (_digest(text) == F.col(f"{name}_digest"))


def _one_of_each(docs: DataFrame, again: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one row of each key and text that are there ``again``."""
    if again.isEmpty():
        return docs
    names = docs.columns
    again = bounded(again.toDF("again_id", "again_digest"), BROADCAST_KEYS)
    repeated, single = (docs.join(again, _is(key, text, "again"), how) for how in ("left_semi", "left_anti"))
    chosen = repeated.groupBy(F.col(key).alias("again_id"), _digest(text).alias("again_digest")).agg(
        F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("row")
    )
    return single.unionByName(chosen.select(*[F.col("row")[n].alias(n) for n in names]))
