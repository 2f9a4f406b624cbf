"""The source mix against exact fractions, and the splitting tree against its distribution."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import mixing
from ledgerlens.llm.queries import mixed, op11_source_mix
from tests.llm.conftest import DOCS, TINY


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Exact targets by source: {source: size}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, words = {}, list(order), Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        share = {s: words * weight[s] / total for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**out, **share}
        for s in above:
            out[s] = Fraction(most * sizes[s])
            words -= out[s]
        free = [s for s in free if s not in above]
    return out


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(docs, got):
    """``got`` (doc_id, size, source_size, target, taken) for ``docs`` (doc_id, text, source)."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size_of(text)
    target = brute_targets(sizes)
    want = Counter((k, size_of(t), sizes[s]) for k, t, s in docs)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == want
    source = {(k, size_of(t), sizes[s]): s for k, t, s in docs}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"], r["source_size"]]
        assert abs(r["target"] - float(target[s])) <= 1e-6 * max(1, float(target[s]))
        passes = 0 if not sizes[s] else int(target[s] // sizes[s])
        assert min(passes, 3) * r["size"] <= r["taken"] <= min(passes + 1, 3) * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= Fraction(1, 2)


def test_query_meets_exact_targets(spark, tiny):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in tiny("documents").collect()]
    got = op11_source_mix(spark, TINY).collect()
    check_mix(docs, got)
    assert sorted(got) == sorted(op11_source_mix(spark, TINY).collect())


def odd_documents(spark):
    say = lambda i, n: " ".join(f"w{i}-{j}" for j in range(n))
    rows = [(i, say(i, i % 37), f"s{i % 5}") for i in range(150)] + [(1000 + i, say(i, 9), "hot") for i in range(250)]
    rows += [(None, say(0, 12), None), (None, say(0, 12), None), (None, say(1, 12), None), (7, "same row here", "s1"), (7, "same row here", "s1"), (8, None, "s1"), (9, " \t\n", ""), (10, None, "empty")]
    rows += [(11, say(3, 6_000), "é"), (12, "a\x0bb\x1cc d", "é"), (13, "x", "tiny")] + [(None, None, "s2")] * 30
    df = spark.createDataFrame([(k, t, "en", s, 0) for k, t, s in rows], DOCS)
    return rows, df.withColumns({n: F.lit("x") for n in ("ix", "size", "begin", "words", "shard", "target")})


@pytest.mark.parametrize("block,shard,rows,cluster", [(512, 4096, 8192, 1024), (8, 16, 16, 2), (1, 50, 8192, 1024), (64, 1, 4, 3)])
def test_odd_rows(spark, monkeypatch, block, shard, rows, cluster):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", cluster)
    monkeypatch.setattr(mixing, "DRAWS_AT_ONCE", 100)
    docs, df = odd_documents(spark)
    mix = mixed(df, block_words=block, shard_blocks=shard)
    check_mix(docs, mix.taken().collect())
    pieces = mix.pieces.collect()
    blocks = defaultdict(set)
    for p in pieces:
        blocks[p["shard"], p["slot"]].add((p["ix"], p["pass"], (p["begin"] + p["first_word"]) // block))
    assert all(len(b) == 1 for b in blocks.values())  # one block in a place
    assert len({b for v in blocks.values() for b in v}) == len(blocks)  # no block twice in a pass
    filled = Counter(s for s, _ in blocks)
    assert max(filled.values()) - min(filled.values()) <= 1 and max(filled.values()) <= shard
    assert all({slot for s, slot in blocks if s == one} == set(range(n)) for one, n in filled.items())
    runs = defaultdict(list)
    for p in pieces:
        runs[p["ix"], p["pass"]].append((p["begin"] + p["first_word"], p["n_words"]))
    for run in runs.values():
        run.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(run, run[1:]))
    again = mixed(df.repartition(7).orderBy(F.rand(1)), block_words=block, shard_blocks=shard).pieces.collect()
    assert sorted(again) == sorted(pieces)


def test_texts_hold_the_words(spark):
    docs, df = odd_documents(spark)
    mix = mixed(df, block_words=16, shard_blocks=20)
    texts = mix.texts(df, F.xxhash64("text")).collect()
    assert all(1 <= len(r["text"].split(" ")) <= 16 for r in texts)
    want = Counter()
    by_text = {(k, size_of(t)): t for k, t, _ in docs if size_of(t)}
    for p in mix.pieces.join(mix.documents.select("ix", "begin", "size").where("size > 0"), ["ix", "begin"]).collect():
        if p["doc_id"] is not None:
            words = re.findall(r"[^\x20\x09-\x0D]+", by_text[p["doc_id"], p["size"]])
            want.update(words[p["first_word"] : p["first_word"] + p["n_words"]])
    found = Counter(w for r in texts for w in r["text"].split(" "))
    assert all(found[w] >= n for w, n in want.items()) and found.total() == sum(p["n_words"] for p in mix.pieces.collect())


def test_empty_tables(spark):
    _, df = odd_documents(spark)
    none = mixed(df.limit(0))
    assert none.taken().count() == none.pieces.count() == 0
    bare = mixed(df.where("text IS NULL")).taken().collect()
    assert bare and all(r["taken"] == 0 and r["target"] == 0 for r in bare)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=8), st.integers(1, 30), st.integers(0, 99))
def test_tree_adds_up(counts, shards, seed):
    tree = mixing.Tree(sum(counts), shards, seed)
    leaves = list(tree.nodes(0, shards, counts, [0] * len(counts), 1))
    assert [leaf[0] for leaf in leaves] == list(range(shards))
    assert [sum(leaf[2]) for leaf in leaves] == [tree.before(i + 1) - tree.before(i) for i in range(shards)]
    at = [0] * len(counts)
    for _, _, quota, firsts in leaves:
        assert firsts == at
        at = [a + n for a, n in zip(at, quota, strict=True)]
    assert at == counts
    upper = [leaf for node in tree.nodes(0, shards, counts, [0] * len(counts), 5) for leaf in tree.nodes(*node, 1)]
    assert upper == leaves


def test_large_draws_are_hypergeometric(monkeypatch):
    monkeypatch.setattr(mixing, "_NUMPY_ITEMS", 5)
    random, good, bad, drawn = np.random.default_rng(5), 30, 50, 24
    found = np.array([mixing.hypergeometric(random, good, bad, drawn) for _ in range(20_000)])
    share = good / (good + bad)
    variance = drawn * share * (1 - share) * (good + bad - drawn) / (good + bad - 1)
    assert abs(found.mean() - drawn * share) < 0.06 and abs(found.var() / variance - 1) < 0.05
    big = [mixing.hypergeometric(random, 10**14, 3 * 10**14, 10**13) for _ in range(50)]
    assert abs(np.mean(big) / (10**13 / 4) - 1) < 1e-5


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(size):
    out = mixing.permuted(np.arange(size), size, 42, 3, 0)
    assert sorted(out.tolist()) == list(range(size))
    if size > 100:
        assert (out != mixing.permuted(np.arange(size), size, 42, 3, 1)).any()
        assert abs(np.corrcoef(out, np.arange(size))[0, 1]) < 0.1
