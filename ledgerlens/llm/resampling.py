"""Importance resampling towards a target text, over hashed n-grams.

Every run of one to three words is a feature; its bucket is the CRC32 of its bytes. Bucket
shares of the corpus and of the target give each bucket a gain, a document's weight is the
sum of its features' gains, and documents are drawn by weight plus a Gumbel key.

A CRC is linear: it is the XOR of what each byte adds, which depends on the byte and its
distance from the end only, and of a constant for the length. ``TABLE`` holds the former
for all distances below ``REACH``. So the CRCs of all features of a block of text
are one lookup per byte and one ``bitwise_xor.reduceat`` over the features' spans. A longer
span is cut into blocks of ``REACH`` bytes; neighbouring blocks are folded, the left one
moved by as many zero bytes as the right one has, until one is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged
from ledgerlens.operators.ordering import dense_numbers

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42

#: Distances from the end that the table covers, a power of two.
REACH = 128
#: Words whose features are hashed at a time, and bytes cut into words at a time; they
#: bound memory, not results. A document is never split between two windows.
WORDS_AT_ONCE = 16_384
WINDOW = 4 << 20

_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    """What a byte becomes in a CRC register of eight shifts."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _move(states: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Registers after one zero byte."""
    return table[states & 0xFF] ^ (states >> np.uint32(8))


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Contribution by (distance from end, byte), flat, and the constant by length up to
    ``REACH``, which is the CRC of as many zero bytes."""
    one = _byte_table()
    by_distance = [one]
    for _ in range(REACH - 1):
        by_distance.append(_move(by_distance[-1], one))
    register, constants = np.array([0xFFFFFFFF], dtype=np.uint32), []
    for _ in range(REACH + 1):
        constants.append(register[0] ^ np.uint32(0xFFFFFFFF))
        register = _move(register, one)
    return np.concatenate(by_distance), np.array(constants, dtype=np.uint32)


@lru_cache(maxsize=None)
def _mover(level: int) -> np.ndarray:
    """Four tables, one for each byte of a register, that move it by ``REACH << level`` zero bytes."""
    if level == 0:
        one = _byte_table()
        states = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
        for _ in range(REACH):
            states = _move(states, one)
        return states
    half = _mover(level - 1)
    return _moved(half, half)


def _moved(states: np.ndarray, mover: np.ndarray) -> np.ndarray:
    out = mover[states & 0xFF]
    for i in range(1, 4):
        out = out ^ mover[256 * i + ((states >> np.uint32(8 * i)) & 0xFF)]
    return out


def _long_constant(length: int) -> int:
    """CRC of ``length`` zero bytes."""
    blocks, rest = divmod(length, REACH)
    register, level = np.array([0xFFFFFFFF], dtype=np.uint32), 0
    while blocks:
        if blocks & 1:
            register = _moved(register, _mover(level))
        blocks, level = blocks >> 1, level + 1
    for _ in range(rest):
        register = _move(register, _byte_table())
    return int(register[0]) ^ 0xFFFFFFFF


def _long_crc(span: np.ndarray) -> int:
    """CRC of a span longer than ``REACH``, block by block. Zero bytes in front add nothing,
    so the blocks are made a power of two."""
    table, _ = _tables()
    blocks = 1 << (-(-len(span) // REACH) - 1).bit_length()
    spread = np.zeros(blocks * REACH, dtype=np.int64)
    spread[len(spread) - len(span) :] = span
    # Padding must add nothing at all; byte 0 adds 0 at every distance.
    distances = np.tile(np.arange(REACH - 1, -1, -1), blocks)
    states = np.bitwise_xor.reduceat(table[distances * 256 + spread], np.arange(0, len(spread), REACH))
    level = 0
    while len(states) > 1:
        states = _moved(states[0::2], _mover(level)) ^ states[1::2]
        level += 1
    return int(states[0]) ^ _long_constant(len(span))


def span_crcs(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC32 of the spans of a byte array; spans may overlap and must not be empty."""
    table, constants = _tables()
    out = np.empty(len(starts), dtype=np.uint32)
    short = lengths <= REACH
    if not short.all():
        for i in np.flatnonzero(~short):
            out[i] = _long_crc(text[starts[i] : starts[i] + lengths[i]])
        starts, lengths = starts[short], lengths[short]
    if len(starts):
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1], dtype=np.int64)
        first = ends - lengths
        distance = np.repeat(ends - 1, lengths) - at
        byte = text[at + np.repeat(starts - first, lengths)]
        crcs = np.bitwise_xor.reduceat(table[(distance << 8) + byte], first) ^ constants[lengths]
        out[short] = crcs
    return out


def _lowered() -> np.ndarray:
    """Bytes of words, A-Z in lower case; 0 for what separates words. Bytes from 128 on
    belong to characters beyond ASCII, all of which are word characters."""
    kept = np.zeros(256, dtype=np.uint8)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        kept[low:high] = np.arange(low, high)
    kept[0x41:0x5B] = np.arange(0x61, 0x7B)
    return kept


_LOWERED = _lowered()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that lie at ``offsets`` in ``data``: bytes of all words, each followed
    by one space; start and length of each word in them; number of words of each text."""
    kept = _LOWERED[data]
    inside = np.concatenate([[False], kept != 0, [False]])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(kept))]
    begins[borders] |= kept[borders] != 0  # texts lie side by side, words end with them
    ends[borders - 1] |= kept[borders - 1] != 0
    at = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) - at + 1
    starts = np.cumsum(lengths + 1) - lengths - 1
    spaced = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
    spaced[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = kept[kept != 0]
    counts = np.diff(np.searchsorted(at, offsets))
    return spaced, starts, lengths, counts


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per some words of the texts, one after the other: bucket of each feature and the number
    of the text it is in."""
    spaced, starts, lengths, counts = words_of(data, offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    for low in range(0, len(starts), WORDS_AT_ONCE):
        high = min(low + WORDS_AT_ONCE, len(starts))
        for n in range(1, longest + 1):
            first = np.arange(low, min(high, len(starts) - n + 1))
            last = first + n - 1
            same = owner[first] == owner[last]
            first, last = first[same], last[same]
            if len(first):
                crcs = span_crcs(spaced, starts[first], starts[last] + lengths[last] - starts[first])
                yield crcs % np.uint32(buckets), owner[first]


def _windows(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``WINDOW`` bytes: first and last row, bytes, offsets. A
    null text is an empty one."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + WINDOW, "right")) - 1)
        yield low, high, everything[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of all rows. Each task adds up its own rows and hands on at
    most one row per bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in _windows(batch.column(0)):
                for found, _ in feature_buckets(data, offsets, buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    partial = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def counted(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The counts by bucket on the driver: as many numbers as there are buckets."""
    out = np.zeros(buckets, dtype=np.int64)
    for row in bucket_counts(texts, text, buckets, longest).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole gain of each bucket, in thousandths of the log ratio of its smoothed shares."""
    size, wanted = float(corpus.sum()), float(target.sum())
    ratio = (target + 1.0) * (size + len(corpus)) / ((corpus + 1.0) * (wanted + len(corpus)))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], dtype=np.int64)


SCORED = "n_words long, n_features long, weight long"


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row; ``gain`` has one number per bucket and goes
    along with the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, features, weight = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for low, high, data, offsets in _windows(batch.column(1)):
                for found, owner in feature_buckets(data, offsets, buckets, longest):
                    # Owners come in order: add up each one's stretch.
                    edges = np.flatnonzero(np.diff(owner, prepend=-1))
                    at = low + owner[edges]
                    weight[at] += np.add.reduceat(gain[found], edges)
                    features[at] += np.diff(edges, append=len(owner))
                words[low:high] = _word_counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], schema=schema)

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, {SCORED}")


def _word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text."""
    inside = _LOWERED[data] != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(inside))]
    begins[borders] |= inside[borders]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Whole thousandths of a Gumbel key from a hash of seed and key; a null key counts as empty."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.substring(F.sha2(named.cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
    seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``.

    Of the rows with ``min_words`` words or more, ``percent`` of a hundred (rounded down) with
    the highest scores get ranks 1, 2, 3...; ties go to the smaller key, null first. Other
    rows have a null rank. Null and empty texts have no features and weight 0; repeated rows
    are drawn each for itself. An empty corpus gives an empty table; an empty target leaves
    the gains to the corpus alone.

    Texts are read twice, for the counts and for the weights, and never shuffled; what is
    sorted is four numbers a row.
    """
    gain = gains(counted(docs, text, buckets, longest), counted(target, text, buckets, longest))
    scored = weighed(docs, gain, key, text, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = staged(scored, "scores").withColumn("eligible", F.col("n_words") >= min_words)
    drawn = scored.where("eligible").count() * percent // 100
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").desc(), F.col("n_words").asc()]
    place = F.when(F.col("place") <= drawn, F.col("place"))
    return dense_numbers(scored, order, "place").select("doc_id", "n_words", "n_features", "weight", "score", place.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose key has a rank, all columns as they are. Rows that share a
    key, the null key too, stay together if one of them was drawn."""
    chosen = resampled(docs, target, key, text, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, F.col(key).cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
