"""Importance resampling against zlib and a plain version of the whole query."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import resampling
from ledgerlens.llm.queries import op12_importance_resampling
from tests.llm.conftest import TINY


@pytest.mark.parametrize("reach_times", [(1, 0), (0, 1), (1, -1), (2, 0), (2, 1), (3, 5), (8, 0), (9, 77), (64, 1)])
def test_long_spans_equal_zlib(reach_times):
    blocks, rest = reach_times
    size = blocks * resampling.REACH + rest
    data = np.random.default_rng(size).integers(0, 256, size + 9, dtype=np.uint8)
    starts, lengths = np.array([0, 4, 9]), np.array([size, size, size])
    want = [zlib.crc32(data[s : s + size].tobytes()) for s in starts]
    assert resampling.span_crcs(data, starts, lengths).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.data())
def test_spans_equal_zlib(data, draw):
    spans = draw.draw(st.lists(st.tuples(st.integers(0, len(data) - 1), st.integers(1, 300)), min_size=1, max_size=20))
    spans = [(s, min(n, len(data) - s)) for s, n in spans]
    got = resampling.span_crcs(np.frombuffer(data, dtype=np.uint8), np.array([s for s, _ in spans]), np.array([n for _, n in spans]))
    assert got.tolist() == [zlib.crc32(data[s : s + n]) for s, n in spans]


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_query(docs, items, percent=5, least=20):
    def buckets(text):
        w = brute_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    source, target = Counter(), Counter()
    for _, text in docs:
        source.update(buckets(text))
    for text in items:
        target.update(buckets(text))
    all_s, all_t = source.total(), target.total()
    rows = []
    for key, text in docs:
        found = buckets(text)
        weight = sum(math.floor(1000 * math.log((target[b] + 1) * (all_s + 10_000) / ((source[b] + 1) * (all_t + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute_words(text)) >= least])
    eligible = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(eligible[: percent * len(eligible) // 100]):
        row[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_query_equals_brute_force(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in tiny("documents").collect()]
    got = [tuple(r) for r in op12_importance_resampling(spark, TINY).collect()]
    assert sorted(got, key=repr) == brute_query(docs, [r["text"] for r in tiny("benchmark").collect()])
    assert sum(r[4] is not None for r in got) >= 5


@pytest.mark.parametrize("words,window", [(resampling.WORDS_AT_ONCE, resampling.WINDOW), (7, 64)])
def test_odd_rows(spark, documents, monkeypatch, words, window):
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", words)
    monkeypatch.setattr(resampling, "WINDOW", window)
    random = np.random.default_rng(1)
    say = lambda k: " ".join(random.choice(["The", "of", "Über", "x9", "é", "a" * 300], k))
    texts = [(i, f"{say(30)}.\n{say(i)}") for i in range(60)] + [(100, None), (101, ""), (102, "--"), (None, say(40)), (None, None), (7, "end"), (103, "one"), (104, "two more")]
    texts += [(105, "z" * 5_000), (106, f"a {'y' * 900} b"), (107, "same words " * 30), (107, "same words " * 30), (108, "日本語 ABC\x00def\x7fghi")]
    items = spark.createDataFrame([(1, say(25)), (1, say(25)), (None, "the of"), (2, None)], "item_id long, text string")
    docs = documents(texts, "weight", "rank", "score")
    target = [r["text"] for r in items.collect()]
    got = resampling.resampled(docs, items, percent=20).drop("n_words").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_query(texts, target, 20)
    left = resampling.drawn(docs, items, percent=20)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in brute_query(texts, target, 20) if r[4]}
    assert resampling.resampled(docs.limit(0), items).count() == 0
    bare = resampling.resampled(docs, items.limit(0), percent=20).drop("n_words").collect()
    assert sorted((tuple(r) for r in bare), key=repr) == brute_query(texts, [], 20)
