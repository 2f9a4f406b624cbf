"""Best-fit packing under conflicts.

Documents become parts of at most ``capacity`` tokens; parts go into bins of that capacity,
longest first, each into the compatible bin it leaves the least room in. Two parts of one
source or one cluster of duplicates conflict: a bin carries a bitmap of its sources and one
of its clusters. Bins are ordered by what is left; from the tightest that would fit, the
search goes on to the next ones until one is compatible, or a new bin is opened.

Parts are dealt by a hash of what they are, and of which copy among equal rows, to groups of about
``group_rows``, which are packed independently: no task holds more than a group, whatever
the source or cluster, and bins depend on the rows alone, not on how they are stored.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged

CAPACITY = 2_048
GROUP_ROWS = 8_000

PACKED = "bin_id string, doc_id long, part int, first_token long, n_tokens long, bin_tokens long, bin_parts int"


class Bins:
    """Open bins in order of residual room, then age."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (room, bin), sorted
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self._last: tuple[tuple[int, int, int], tuple[int, int]] | None = None

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin for a part; -1 as source or cluster conflicts with nothing."""
        src = 1 << source if source >= 0 else 0
        clu = 1 << cluster if cluster >= 0 else 0
        at = (size, -1)
        # For a part equal to the last one, the bins passed over then still conflict, and so
        # does the last one's own, unless nothing conflicts with it.
        if (src or clu) and self._last and self._last[0] == (size, source, cluster):
            at = max(at, self._last[1])
        i = bisect.bisect_left(self.order, at)
        while i < len(self.order):
            room, number = self.order[i]
            if not (self.sources[number] & src or self.clusters[number] & clu):
                del self.order[i]
                break
            i += 1
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self._last = ((size, source, cluster), (room, number))
        self.sources[number] |= src
        self.clusters[number] |= clu
        if room > size:
            bisect.insort(self.order, (room - size, number))
        return number


def _codes(values: pd.Series) -> list[int]:
    """Small whole numbers for the values, -1 for null."""
    return pd.factorize(values)[0].tolist()


def pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins of one group: n_tokens descending, ties by cluster, source, key and part."""
    if not len(group):
        return pd.DataFrame({c.split()[0]: [] for c in PACKED.split(", ")})
    parts = group.sort_values(["n_tokens", "cluster", "source", "doc_id", "part"], ascending=[False, True, True, True, True], kind="stable")
    bins, numbers = Bins(capacity), []
    for size, source, cluster in zip(parts["n_tokens"].tolist(), _codes(parts["source"]), _codes(parts["cluster"]), strict=True):
        numbers.append(bins.place(size, source, cluster))
    parts = parts.assign(number=numbers)
    by_bin = parts.groupby("number")["n_tokens"]
    name = f"{int(group['grp'].iloc[0])}-"
    return pd.DataFrame(
        {
            "bin_id": pd.Series([f"{name}{n}" for n in numbers], index=parts.index, dtype=object), "doc_id": parts["doc_id"], "part": parts["part"],
            "first_token": parts["first_token"], "n_tokens": parts["n_tokens"],
            "bin_tokens": by_bin.transform("sum"), "bin_parts": by_bin.transform("size"),
        }
    )


def pack(
    docs: DataFrame, n_tokens: Column, source: Column, cluster: Column, key: str = "doc_id",
    capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per part with its bin: ``PACKED``.

    A document of no tokens (also null) is one part of none, which takes part in conflicts
    like any other. Longer ones than ``capacity`` become full parts and a rest. Null source
    or cluster conflicts with nothing; repeated rows are packed once each, also a third of
    all rows with one key; a null key stays null.
    """
    sized = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.greatest(F.coalesce(n_tokens.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        source.cast("string").alias("source"), cluster.cast("string").alias("cluster"),
    )
    # Stored, so that texts are read once. Equal rows are one with the number of its copies.
    sized = staged(sized.groupBy("doc_id", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    sized = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    parts = sized.select(
        "doc_id", "source", "cluster", "size", "copy",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / capacity)).cast("long"))).alias("at"),
    )
    groups = max(1, -(-parts.count() // group_rows))
    dealt = parts.select(
        F.pmod(F.xxhash64("doc_id", "size", "source", "cluster", "copy", "at"), F.lit(groups)).alias("grp"), "doc_id", F.col("at").cast("int").alias("part"),
        (F.col("at") * capacity).alias("first_token"),
        F.least(F.col("size") - F.col("at") * capacity, F.lit(capacity)).alias("n_tokens"), "source", "cluster",
    )

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        return pack_group(group, capacity)

    return dealt.groupBy("grp").applyInPandas(packed, PACKED)


def bins_of(packed: DataFrame) -> DataFrame:
    """One row per bin: its documents in order, tokens and parts."""
    return packed.groupBy("bin_id").agg(
        F.max("bin_tokens").alias("n_tokens"), F.max("bin_parts").alias("n_parts"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("k"), "part", "doc_id"))), lambda x: x["doc_id"]
        ).alias("doc_ids"),
    )
