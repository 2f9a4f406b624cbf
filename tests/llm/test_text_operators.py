"""Personal data, token counts, quality, toxicity and page text against plain versions."""

from __future__ import annotations

import itertools
import math
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerlens.llm import line_quality, page_text, personal_data, token_counts, toxicity
from ledgerlens.llm.queries import op1_page_text, op4_line_quality, op7_personal_data, op8_toxicity

from tests.llm.conftest import TINY

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", r"\x20\-")),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                checksum = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or checksum % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def base(spans):
    return [s for s in spans if s[2] in BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a9.@+-( )1:/0é\n%İ", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(personal_data.find(text)) == brute_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "a@b.co", "a@b@c.d.e", "+1 (017) 555-7713", "1.2.3.4", "999.1.1.1", "01.002.3.4.5.6.7.8", "5", "-", " ", "x"]), max_size=8))
def test_base_spans_of_real_looking_text(parts):
    text = "".join(parts)
    assert base(personal_data.find(text)) == brute_spans(text)


def test_cues_add_spans_and_redaction_covers_all():
    text = "IBAN: DE44500105175407324931 and http://joe:secret@host/ a@b.co"
    kinds = [k for _, _, k in personal_data.find(text)]
    assert "account" in kinds and "url_login" in kinds and "email" in kinds
    clean = personal_data.redact(text, personal_data.find(text))
    assert "secret" not in clean and "5407324931" not in clean and "a@b.co" not in clean
    assert personal_data.find(None) == [] and personal_data.redact(None, []) == ""
    assert base(personal_data.find("9" * 200_000)) == [] and personal_data.find("@" * 50_000) == []


def test_personal_data_query(spark, documents, tiny):
    rows = op7_personal_data(spark, TINY).collect()
    texts = {r["doc_id"]: r["text"] for r in tiny("documents").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        found = brute_spans(texts[row["doc_id"]])
        assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == tuple(sum(k == x for *_, k in found) for x in BASE)
    odd = documents([(1, None), (1, ""), (None, "a@b.co"), (1, "a@b.co")], "found", "spans")
    assert sorted(len(r["found"]) for r in personal_data.find_spans(odd).collect()) == [0, 0, 1, 1]
    assert sorted(str(r["text"]) for r in personal_data.redacted(odd).collect()) == ["", "None", "[EMAIL]", "[EMAIL]"]


def brute_tokens(word: bytes, costs: dict[bytes, int]) -> int:
    best = {0: (0, 0)}
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + 20 * token_counts.SCALE, best[end - 1][1] + 1)]
        options += [(best[s][0] + costs[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in costs]
        best[end] = min(options)
    return best[len(word)][1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=8).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=30))
def test_trie_counts_equal_a_plain_table(words):
    costs = {bytes(p): 1000 + 37 * i % 1900 for i, p in enumerate(itertools.chain.from_iterable(itertools.product(b"ab", repeat=k) for k in (1, 2, 3)))}
    want = [brute_tokens(w, costs) for w in words]
    for trie in (token_counts.Trie(costs), token_counts.Trie(costs, max_words=3)):
        assert trie.solve(words) == [trie._alone(w) for w in words] == want
        texts = [w.decode() for w in words]
        for low in range(0, len(texts), 4):  # some known, some new, some moved up
            got = trie.counts(set(texts[low : low + 4]))
            assert [got[t] for t in texts[low : low + 4]] == want[low : low + 4]


def test_words_of_any_length_split_alike():
    costs = {b"ab": 900, b"abab": 1500, b"b" * 40: 2000, b"a": 1000, "\u6f22".encode(): 70}
    words = [b"ab" * 200, b"b" * 300, b"a" * 257 + b"c", b"a" * 256, "\u6f22".encode() * 120, b"", b"c"]
    assert token_counts.Trie(costs).solve(words) == [brute_tokens(w, costs) for w in words]
    assert token_counts.Trie({}).solve([b"xyz", b""]) == [3, 0]


def test_portions_do_not_change_counts():
    costs = {w.encode(): 500 + i for i, w in enumerate(["the", " the", "cat", " c", "at", "s", ",", " "])}
    pattern = regex.compile(token_counts.PATTERN)
    texts = ["the cats, the cat" * 9, None, "", "x" * 50 + " the", "  the\n\n", "it's the cat's"]
    plain = [sum(brute_tokens(w.encode(), costs) for w in pattern.findall(t or "")) for t in texts]
    for chars in (8, 60, 10**6):
        tokens, words = token_counts.count_texts(texts, token_counts.Trie(costs), pattern, chars)
        assert tokens.tolist() == plain and words.tolist() == [len(pattern.findall(t or "")) for t in texts]


def test_token_counts_of_documents(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    costs = token_counts.rank_costs(public.path("byte_bpe_50k.tiktoken"))
    texts = ["", None, "Hello  world, it's", "naïve 漢字 \n\n x", "a" * 3000]
    got = {r["doc_id"]: (r["n_tokens"], r["n_words"]) for r in token_counts.count_documents(documents(list(enumerate(texts)), "n_tokens"), costs).collect()}
    for i, text in enumerate(texts):
        words = regex.findall(token_counts.PATTERN, text or "")
        assert got[i] == (sum(brute_tokens(w.encode(), costs) for w in words), len(words))
    odd = documents([(None, "Hello"), (1, "Hello"), (1, "Hello"), (None, None)], "n_words")
    found = sorted((r["doc_id"] or 0, r["n_words"]) for r in token_counts.count_documents(odd, costs).collect())
    assert found == [(0, 0), (0, 1), (1, 1), (1, 1)] and token_counts.count_documents(odd.limit(0), costs).count() == 0


def brute_marginals(scores, pairs):
    total, good = 0.0, np.zeros(len(scores))
    for labels in itertools.product((0, 1), repeat=len(scores)):
        s = sum(y * x for y, x in zip(labels, scores)) + sum(pairs[a][b] for a, b in itertools.pairwise(labels))
        total += math.exp(s)
        good += math.exp(s) * np.array(labels)
    return good / total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=1, max_size=6), st.lists(st.floats(-2, 2), min_size=4, max_size=4))
def test_marginals_equal_enumeration(scores, flat):
    pairs = np.array(flat).reshape(2, 2)
    assert np.allclose(line_quality.marginals(np.array(scores), pairs), brute_marginals(scores, pairs))


def test_quality_learns_and_takes_odd_texts(spark, documents, tiny):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in op4_line_quality(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels]
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    model = line_quality.fit([])
    odd = documents([(1, None), (1, ""), (2, "\n\n"), (3, "x " * 50_000), (None, "a\nb")], "score", "label")
    scored = line_quality.score_documents(odd, model).collect()
    assert len(scored) == 5 and all(r["score"] == 0.5 for r in scored)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert line_quality.train(odd, empty).pairs.tolist() == [[0, 0], [0, 0]]


def test_grades_share_weights():
    rows = [({"scum", "the"}, 1), ({"the", "of"}, 0)] * 60 + [({"scum", "idiot"}, 3)] * 60
    model = toxicity.fit(rows, ["scum", "idiot"])
    assert model.severity("the of") < 0.5 < model.severity("the scum") < 2 < model.severity("scum idiot")
    assert list(model.thresholds) == sorted(model.thresholds) and set(model.weights) == {"scum", "idiot"}
    assert not toxicity.fit([], []).weights and not toxicity.fit([({"a"}, 2)], ["a"]).weights


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_slope_equals_differences(seed):
    random = np.random.default_rng(seed)
    n, features = 25, 6
    where, what = random.integers(0, n, 60), random.integers(0, features, 60)
    # Small enough that no probability comes near the bound below which it is cut.
    grade, at = random.integers(0, toxicity.GRADES, n), random.normal(scale=0.4, size=features + toxicity.GRADES - 1)
    value = lambda x: toxicity.slope(x[:features], x[features:], where, what, grade, 0.01)[0]
    found = toxicity.slope(at[:features], at[features:], where, what, grade, 0.01)[1]
    step = 1e-5 * np.eye(len(at))
    assert np.allclose(found, [(value(at + e) - value(at - e)) / 2e-5 for e in step], atol=1e-6)


def test_grades_are_thirds_of_what_others_say():
    assert toxicity.grades_of([]) == [] and toxicity.grades_of([5.0]) == [1]
    assert toxicity.grades_of([3.0, 1.0, 2.0, 9.0, 8.0, 7.0]) == [2, 1, 1, 3, 3, 2]
    assert toxicity.grades_of([2.0] * 9) == [1] * 9


def test_telling_tokens_equal_plain_counts(spark):
    random = np.random.default_rng(2)
    docs = [({w for w in "abcdefgh" if random.random() < (0.7 if toxic and w in "ab" else 0.3)}, toxic) for toxic in [1] * 60 + [0] * 140]
    rows = [(w, sum(w in d and t for d, t in docs), sum(w in d and not t for d, t in docs)) for w in "abcdefgh"]
    want = {}
    for w, n, m in rows:
        ratio = n * math.log(n * 200 / ((n + m) * 60)) + m * math.log(m * 200 / ((n + m) * 140))
        if n * 140 > m * 60 and 2 * ratio >= toxicity.LEAST_RATIO:
            want[w] = (math.log((n + 0.5) / 61) - math.log((m + 0.5) / 141))
    found = toxicity.telling(spark.createDataFrame(rows, "token string, inside long, outside long"), 60, 140, 10).collect()
    assert {r["token"]: pytest.approx(r["odds"]) for r in found} == want and set(want) <= set("ab")


def test_toxicity_finds_held_out_documents(spark, documents):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    unseen = {i: t for i, t in labels.items() if zlib.crc32(str(i).encode()) % 4 == 2}
    graded = {r["doc_id"]: r for r in op8_toxicity(spark, folder).collect()}
    toxic, clean = [[graded[i] for i, t in unseen.items() if t == kind] for kind in (1, 0)]
    assert len(toxic) > 50 and sum(r["toxic"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["toxic"] for r in clean) <= 0.01 * len(clean)
    assert {r["grade"] for r in toxic} >= {1, 2}, "severity differs among toxic documents"


def test_toxicity_of_odd_tables(spark, documents):
    none = toxicity.fit([], [])
    odd = documents([(1, None), (1, ""), (None, "x"), (2, "x"), (2, "x")], "severity", "graded", "label", "tokens", "fold")
    assert Counter(r["doc_id"] for r in toxicity.grade_documents(odd, none).collect()) == {1: 2, None: 1, 2: 2}
    assert toxicity.grade_documents(odd.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1), (4, 7)], "doc_id long, toxic int")
    for docs, given_labels in ((odd, labels), (odd.limit(0), labels), (odd, labels.limit(0))):
        assert not toxicity.train(docs, given_labels).weights


def test_toxicity_reads_long_documents_to_their_end(spark, documents):
    long = " ".join(f"filler{k}" for k in range(3_000))
    texts = {i: f"{long} scum" if i % 2 else long for i in range(120)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    model = toxicity.train(documents(texts), labels)
    assert model.severity("scum") > model.severity("filler1")


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header class="site">Top</header>
<nav><ul><li>Home</li></ul></nav><article><h1>A &amp; B</h1><p>One<br>two  three.</p><div class="ad">Buy</div>
<p><b>Four<p>Five</p><aside>Also</aside><section class="comments"><p>Nice!</p></section></article><footer>&copy; x</footer>"""


def test_blocks_follow_the_markup():
    assert page_text.candidates(PAGE) == (page_text.ARTICLE, ["A & B", "One two three.", "Four", "Five"])
    assert page_text.candidates(None)[1] == [] and page_text.candidates("<")[1] == ["<"]
    assert page_text.candidates("<p>a < b</p><!-- c")[1] == ["a < b"]
    nested = "<div class='article-body'><div>x</div>y</div><div>z</div>"
    assert page_text.candidates(nested)[1] == ["x", "y"]


def test_names_do_not_make_text_chrome():
    article = """<article><h2 id="related-work">Related work</h2><h2 id="social-security">Security</h2><p class="search">Find it</p>
    <div class="ad-hoc">Ad hoc</div><section id="sharing"><p>Sharing</p></section><p>See <a class="share">this word</a> and <span hidden>not</span> that.</p>
    <ul class="share"><li>Post</li></ul><div class="ad">Buy</div><div role="search">Go</div></article>"""
    assert page_text.candidates(article)[1] == ["Related work", "Security", "Find it", "Ad hoc", "Sharing", "See this word and that."]
    outside = '<div id="sidebar">s</div><div class="site-footer">f</div><div class="cookie-banner top">c</div><div id="comments"><p>x</p></div><p>text</p>'
    assert page_text.candidates(outside)[1] == ["text"]


def test_zones_lose_no_text():
    assert page_text.candidates("<main><p>Intro</p><article>Body</article><p>Closing</p></main>")[1] == ["Intro", "Body", "Closing"]
    story = "The main story is much longer than the teaser beside it."
    assert story in page_text.candidates(f"<div>{story}</div><article>Teaser</article>")[1]
    assert page_text.candidates(f"<ul><li>menu</li></ul><article>{story}</article>")[1] == [story]


@pytest.mark.parametrize("page", ["<svg>" * 200_000, "<title>x" * 140_000, "<article>" * 50_000 + "</section>" * 50_000, "<article></div>" * 70_000, "<select><svg>" * 70_000])
def test_parsing_is_linear(page):
    started = time.perf_counter()
    page_text.candidates(page)
    assert time.perf_counter() - started < 5


class Reference(HTMLParser):
    """The text of the article of a page, by another parser."""

    BLOCKS = frozenset("p h1 h2 h3 li ul div article nav footer section".split())

    def __init__(self):
        super().__init__()
        self.open, self.parts, self.found = [], [], []

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.found.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        elif tag in ("article", "script", "style") or (tag, dict(attrs).get("class")) == ("div", "ad"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        if self.open and self.open[-1] == tag:
            self.open.pop()

    def handle_data(self, data):
        if self.open == ["article"]:
            self.parts.append(data)


def test_pages_equal_another_parser(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op1_page_text(spark, folder).collect()}
    assert len(got) == len(pages) >= 250
    for page_id, page in pages.items():
        reference = Reference()
        reference.feed(page or "")
        reference.flush()
        assert got[page_id]["text"].split("\n") == reference.found and got[page_id]["n_chars"] == len(got[page_id]["text"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9).map(" ".join), max_size=3), max_size=6), st.sampled_from([0.3, 0.5, 1.0]))
def test_suffix_array_finds_what_pages_share(pages, share):
    k = page_text.MIN_TOKENS
    tokens = [[t for b in p for t in b.split(" ")] for p in pages]
    grams = [{tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in tokens]
    common = {g for own in grams for g in own if sum(g in o for o in grams) >= share * len(pages)}
    got = page_text.repeated(pages, share)
    assert len(set(got.tolist())) == len(common)
    for page, t in zip(pages, tokens):
        covered = {j for i in range(len(t) - k + 1) if tuple(t[i : i + k]) in common for j in range(i, i + k)}
        want, at = [], 0
        for block in page:
            words = block.split(" ")
            runs = "".join("x" if at + j in covered else "." for j in range(len(words)))
            at += len(words)
            if "." in runs:
                runs = re.sub(r"x+", lambda m: m[0] if len(m[0]) >= k else "." * len(m[0]), runs)
            want += [w for w, r in zip(words, runs) if r == "."]
        assert [x for b in page_text.unique_runs(page, got) for x in b.split(" ")] == want


def test_extract_cuts_what_a_host_repeats(spark):
    shared = "Share this page with all of your friends"
    rows = [(i, f"http://h.org/{i}", f"<p>{shared}</p><p>text number {i} says {i * 7} things {i * 3} of its own</p>", 1) for i in range(40)]
    rows += [(100, None, None, 1), (101, "http://z.org/", "", 1), (101, "http://z.org/", "", 1), (102, "http://h.org/x", f"<article><p>{shared}</p></article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    for block_chars in (1_000_000, 500):
        got = {r["page_id"]: r["text"] for r in page_text.extract(df, block_chars).collect()}
        assert got[3] == "text number 3 says 21 things 9 of its own"
        assert got[100] == "" and got[101] == "" and got[102] == shared
    assert page_text.extract(df.limit(0)).count() == 0


def test_copies_of_a_page_stay_whole(spark):
    story = " ".join(f"story{i}" for i in range(60))
    article = "<article><p>" + " ".join(f"news{i}" for i in range(40)) + "</p></article>"
    notice = "this notice stands on all pages of the host here"
    rows = [(i, "http://a.org/", f"<p>{story}</p>") for i in range(3)]  # copies
    rows += [(10 + i, "http://b.org/", f"<p>{story.replace('story30', f'new{i}')}</p>") for i in range(6)]  # near copies
    rows += [(100 + i, "http://c.org/", article) for i in range(57)] + [(160 + i, "http://c.org/", f"<article><p>own text {i}</p></article>") for i in range(3)]
    rows += [(200 + i, "http://d.org/", f"<p>{notice}</p><p>{' '.join(f'p{i}w{k}' for k in range(20))}</p>") for i in range(12)]
    rows += [(300 + i, "http://e.org/", f"<p>a{i} b{i} five words that were quoted c{i} d{i}</p>") for i in range(8)]
    rows += [(400 + i, "http://f.org/", "") for i in range(300)]
    large = " ".join(f"notice{i}" for i in range(60))
    rows += [(800 + i, "http://g.org/", f"<p>{large}</p><p>own{i} words{i} of{i} it{i}</p>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = {i: "\n".join(page_text.candidates(h)[1]) for i, _, h in rows}
    for block_chars in (1_000_000, 2_000):
        got = {r["page_id"]: r["text"] for r in page_text.extract(df, block_chars).collect()}
        assert got == {i: t.removeprefix(notice).removeprefix(large).strip() for i, t in plain.items()}
