"""Search, near duplicates, contamination, packing and URL rules against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, knn, packing, simhash, url_filter
from ledgerlens.llm.oracle import oracle_sql
from ledgerlens.llm.queries import op1_page_text, op5_simhash, op9_best_fit, op10_url_filter, queries
from tests.llm.conftest import TINY


def brute_top(rows, k):
    ready = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    scores = defaultdict(list)
    for q, qv in ready:
        if q % 20 == 0:
            scores[q] += [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in ready if i != q]
    return sorted((q, r + 1, i, -s) for q, found in scores.items() for r, (s, i) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("pivots,block,group", [(64, 8192, 4096), (5, 16, 2), (1, 1000, 1)])
def test_top_k_equals_brute_force(spark, pivots, block, group):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]  # one vector that many share
    rows += [(300, None), (320, [None] * 6), (340, [float("nan")] * 6), (360, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (380, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("score", F.lit("x"))
    got = knn.top_k(df, F.col("vec_id") % 20 == 0, 7, pivots=pivots, block=block, group=group)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 7)
    assert knn.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_count_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.integers(-3, 4, 4)]) for i in range(90)]
    rows += [rows[3]] * 25 + [rows[20]] * 3 + [(40, [1.0, 0.5, -2.0, 3.0]), rows[7], rows[7]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(connection.execute(oracle_sql()["op2_voronoi_top_k"]).fetchall())
    for block, group in ((8192, 4096), (8, 2)):
        got = knn.top_k(spark.read.parquet(str(tmp_path / "embeddings.parquet")), F.col("vec_id") % 20 == 0, pivots=6, block=block, group=group)
        assert sorted(tuple(r) for r in got.collect()) == want == brute_top(rows, 20)


def test_products_beyond_a_long_are_the_largest(spark):
    rows = [(0, [2.0**40, 2.0**40]), (1, [2.0**40, 1.0]), (2, [-(2.0**40), 0.0]), (3, [1.0, 1.0]), (4, [2.0**40, 5.0])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 2**53), (2, -(2**63))]


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (2, [2.0**24, 5.0])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 2**60 + 64 * 320), (1, 2**60 + 64 * 192)]


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i], changed = label[j], True
    return label


def test_simhash_query_equals_brute_force(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in tiny("documents").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    label = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op5_simhash(spark, TINY).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in texts}


def test_spark_hashes_alike(spark):
    text = "Zoë und\tder Bär"
    words = spark.range(1).select(F.xxhash64(F.lit("zoë und der"))).first()[0]
    assert words % 2**64 == xxhash.xxh64_intdigest("zoë und der".encode(), 42)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_trees_lose_no_pair(seed):
    random = np.random.default_rng(seed)
    centres = random.integers(0, 2**63, 12, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << random.integers(0, 64, 3, dtype=np.uint64)) for _ in range(300)])
    points = np.unique(np.concatenate([centres[random.integers(0, 12, 300)] ^ flips, random.integers(0, 2**63, 200, dtype=np.uint64)]))
    trees = [simhash.build(points[::2], mask, 20) for mask in simhash.HALVES]
    met = set()
    for tree, mask in zip(trees, simhash.HALVES):
        for _, at, home in simhash.leaves(tree, points, mask, 1):
            for i in at:
                met |= {(min(i, j), max(i, j)) for j in at[home]}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    assert {(i, j) for i, j in np.argwhere(near) if i < j} <= met


@pytest.mark.parametrize("shard", [4, 64, 4096])
def test_classes_equal_brute_force(spark, shard):
    random = np.random.default_rng(9)
    points = [int(x) for x in random.integers(-(2**62), 2**62, 40)]
    for _ in range(160):  # chains of near fingerprints, and many with the same half
        points.append(points[int(random.integers(0, len(points)))] ^ sum(1 << int(b) for b in random.integers(0, 32, 2)))
    points = sorted(set(points))
    df = spark.createDataFrame([(p,) for p in points], "fingerprint long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, shard=shard)).collect()}
    want = brute_components({p: p % 2**64 for p in points})
    groups = lambda label: {frozenset(p for p in points if label(p) == label(q)) for q in points}
    assert groups(lambda p: found.get(p, p)) == groups(lambda p: want[p])


def test_deduplicated_keeps_one_of_each(documents):
    text = " ".join(f"word{i}" for i in range(300))
    docs = documents([(5, text), (3, text), (3, text), (9, text + " more"), (7, "other text of its own kind"), (8, None), (10, ""), (None, "alone it stands here")], "component_id", "fingerprint")
    kept = sorted((str(r["doc_id"]) for r in simhash.deduplicated(docs).collect()))
    assert kept == ["3", "7", "8", "None"] and simhash.deduplicated(docs).columns == docs.columns
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_deduplicated_keeps_one_of_each_component_under_shared_keys(documents):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcdef")
    docs = documents([(None, a), (None, b), (None, b), (2, c), (5, c), (5, d), (5, d), (None, e), (7, e), (5, f), (8, None), (8, "")], "digest", "component")
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicated(docs).collect()]
    want = [(None, a), (None, b), (2, c), (5, d), (5, f), (7, e), (8, "")]
    assert sorted(((k, t or "") for k, t in kept), key=repr) == sorted(want, key=repr)


def brute_contamination(texts, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            for s in range(max(1, len(w) - n + 1)):
                windows[tuple(w[s : s + n])].add(str(i))
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(g) for g in windows}:
            for s in range(len(w) - size + 1):
                if own := windows.get(tuple(w[s : s + size])):
                    hit |= set(range(s, s + size))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows,terms", [(decontamination.BROADCAST_ROWS, decontamination.BROADCAST_TERMS), (0, 1_000), (0, 0)])
def test_contamination_equals_brute_force(spark, documents, monkeypatch, rows, terms):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontamination, "BROADCAST_TERMS", terms)
    random = np.random.default_rng(4)
    vocabulary = ["the", "of", "a", "Über", "x9", "é"]
    say = lambda k: " ".join(random.choice(vocabulary, k))
    items = [(i, say(int(random.integers(1, 30)))) for i in range(6)] + [(7, None), (8, "!!"), (9, "the the the"), (9, "the the the"), (10, "unseen")]
    texts = [(i, f"{say(40)}. {items[i % 6][1].upper() if i % 2 else ''} -- {say(int(random.integers(0, 200)))}") for i in range(30)]
    texts += [(40, None), (41, ""), (42, "the " * 500), (1, "the the the"), (None, items[0][1]), (43, items[1][1]), (43, items[1][1])]
    docs = documents(texts, "term", "digest", "items")
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["matched"]), r["contaminated"]) for r in decontamination.judged(docs, tests).collect()]
    want = brute_contamination(texts, items)
    assert sorted(got, key=repr) == want
    left = decontamination.decontaminated(docs, tests)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, *_, bad in want if not bad) and left.columns == docs.columns
    for none in (docs.limit(0), docs):
        assert decontamination.judged(none, tests.limit(0)).where("contaminated").count() == 0


def test_items_without_an_id_contaminate(spark, documents, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    long = " ".join(f"w{i}" for i in range(20))
    docs = documents({1: f"x {long} y", 2: "clean text", 3: "one two three", 4: f"{long} one two three"})
    items = spark.createDataFrame([(None, long), (None, "one two three"), (5, "one two three")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], list(r["matched"]), r["contaminated"]) for r in decontamination.judged(docs, items).collect()}
    assert got == {1: (20, [None], True), 2: (0, [], False), 3: (3, ["5", None], True), 4: (23, ["5", None], True)}
    assert [r["doc_id"] for r in decontamination.decontaminated(docs, items).collect()] == [2]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        want = sorted(db.execute(oracle_sql()["op6_decontamination"]).fetchall())
    assert sorted(tuple(r) for r in queries()["op6_decontamination"](spark, str(tmp_path)).collect()) == want


def test_near_finds_the_rarest_terms_together(spark, documents):
    docs = documents({1: "rare one two gem", 2: "rare a b c d e f g h i gem", 3: "gem rare", 4: "one"})
    tests = spark.createDataFrame([(1, "the rare gem"), (2, None)], "item_id long, text string")
    counted = documents({5: "the the the the the rare gem"}).union(docs)
    assert {r["doc_id"] for r in decontamination.near(counted, tests, 3).collect()} == {1, 3, 5}


def brute_best_fit(sizes, capacity):
    bins, out = [], []
    for size, source, cluster in sizes:
        fits = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= size and b["room"] > 0 and source not in b["s"] and cluster not in b["c"]]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[n]["room"] -= size
        bins[n]["s"] |= {source} - {-1}
        bins[n]["c"] |= {cluster} - {-1}
        out.append(n)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10), st.integers(-1, 3), st.integers(-1, 4)), max_size=40))
def test_bins_equal_brute_force(parts):
    parts = sorted(parts, reverse=True)
    bins = packing.Bins(10)
    assert [bins.place(*p) for p in parts] == brute_best_fit(parts, 10)


def test_equal_parts_without_conflicts_share_a_bin():
    bins = packing.Bins(10)
    assert [bins.place(1, -1, -1) for _ in range(11)] == [0] * 10 + [1]


def test_packing_keeps_everything_and_every_rule(spark, tiny, documents):
    packed = op9_best_fit(spark, TINY).collect()
    docs = {r["doc_id"]: r for r in tiny("documents").collect()}
    size, bins = Counter(), defaultdict(list)
    for r in packed:
        size[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]].append(r)
    assert size == Counter({i: len(d["text"].split()) for i, d in docs.items()})
    for own in bins.values():
        assert sum(r["n_tokens"] for r in own) == own[0]["bin_tokens"] <= packing.CAPACITY and len(own) == own[0]["bin_parts"]
        assert len({docs[r["doc_id"]]["source"] for r in own}) == len(own) == len({docs[r["doc_id"]]["text"] for r in own})
    odd = documents([(1, None), (1, None), (None, ""), (2, "w " * 5000)], "grp", "part", "number")
    rows = packing.pack(odd, F.when(F.col("text").startswith("w"), 5000), F.lit(None), F.lit(None), group_rows=2).collect()
    assert len(rows) == 6 and sum(r["n_tokens"] for r in rows) == 5000
    assert packing.bins_of(packing.pack(odd.limit(0), F.lit(1), F.lit(None), F.lit(None))).count() == 0


def test_bins_depend_on_rows_alone(spark, documents):
    texts = [(i % 60, " ".join(["w"] * (1 + i * 7 % 50))) for i in range(240)] + [(None, "same row again")] * 90 + [(5, "w " * 900)]

    def packed(rows, partitions):
        df = documents(rows).repartition(partitions)
        found = packing.pack(df, F.size(F.split("text", " ")), F.lit(None), F.xxhash64("text"), capacity=64, group_rows=50).collect()
        return Counter(tuple(r) for r in found)

    once = packed(texts, 2)
    assert packed(texts[::-1], 7) == once and sum(r[0] is not None for r in once) == len(once)
    assert sum(n for r, n in once.items() if r[1] is None) == 90


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None


def test_url_rules_and_verdicts(spark, tiny):
    urls = ["HTTP://Example.ORG/en/1x?a=1#b", "https://www.example.org/es/", "https://a.com/de/x", "https://a.com/fr/x", "ftp://xorg/", "://org", "nothing", "", None, "http://É.com\n/de/", "a://b://c/d", "http://example.org/en/2"]
    urls += [r["url"] for r in tiny("pages").collect()]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    verdicts = {r.name: r.verdict for r in url_filter.RULES}
    for row in url_filter.filter_urls(df).collect():
        host, path, rule = brute_rule(urls[row["page_id"]])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] in ("allow", "block") and (rule is None or row["verdict"] == verdicts[rule])
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_trees_learn_held_out_verdicts(spark):
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = url_filter.rule_of(F.col("host"), F.col("path"), url_filter.RULES)
    labelled = pages.withColumn("blocked", (url_filter.verdict_of(rule, url_filter.RULES) == "block").cast("double")).where("blocked IS NOT NULL")
    model = url_filter.fit(labelled.where("page_id % 4 <> 0"), trees=8)
    held = url_filter.judge(labelled.where("page_id % 4 = 0").select("page_id", "url"), model, url_filter.RULES)
    joined = held.join(labelled.select("page_id", "blocked"), "page_id").select(((F.col("blocked_probability") >= 0.5).cast("double") == F.col("blocked")).cast("int").alias("right"))
    assert joined.agg(F.avg("right")).first()[0] >= 0.85


@pytest.mark.parametrize("parts", [url_filter.BROADCAST_PARTS, 0])
def test_url_statistics_are_of_all_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(url_filter, "BROADCAST_PARTS", parts)
    urls = [(f"http://a.com/x/{i}", float(i % 4 == 0)) for i in range(40)] + [(f"http://b.de/{i}", 1.0) for i in range(20)]
    urls += [("http://a.com/x/1", 0.0)] * 20 + [(f"http://c.net/y/{i}", None) for i in range(79)] + [(None, None)]
    df = spark.createDataFrame(urls, "url string, blocked double").withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    model = url_filter.fit(df, sample_urls=20, trees=2)
    found = {part: {r[0]: tuple(r)[1:] for r in known.collect()} for part, known in model.statistics.items()}
    n, rate = len(urls), lambda bad, labelled: (bad + 5) / (labelled + 10)
    assert found["suffix"] == {"a.com": (rate(10, 60), 60 / n), "b.de": (rate(20, 20), 20 / n), "c.net": (0.5, 79 / n), "": (0.5, 1 / n)}
    assert found["segment"] == {"x": (rate(10, 60), 60 / n), "y": (0.5, 79 / n), "": (rate(20, 20), 21 / n)}
    pages = df.select(F.monotonically_increasing_id().alias("page_id"), "url")
    assert url_filter.judge(pages, model, url_filter.RULES).count() == n


def test_entry_registers_everything(spark, tiny):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(queries()) | {"pipeline"} <= set(names) and set(oracle_sql()) <= set(names)
    assert {r["page_id"] for r in op1_page_text(spark, TINY).collect()} == {r["page_id"] for r in tiny("pages").collect()}
    assert op10_url_filter(spark, TINY).count() == tiny("pages").count()
    assert hashlib.sha256(b"").hexdigest() in {r["items_sha256"] for r in names["op6_decontamination"](spark, TINY).collect()}
