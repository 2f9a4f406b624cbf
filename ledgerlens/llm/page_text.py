"""Main text of web pages with a suffix array per host.

A page becomes blocks of text with the zone they stand in: chrome (menus, footers, notices,
forms, comments), plain, main or article. The token streams of a host's pages are
concatenated and their suffixes sorted; neighbours that agree in at least ``MIN_TOKENS``
tokens and come from distinct pages are repeated substrings. Those that enough of the
host's pages share are boilerplate and are cut out; what is left in the best zone are the
unique runs.

Pages of a host with the same text count once, so copies do not make each other boilerplate.

A host's pages are dealt to blocks of bounded size. A substring that a share of all pages of a
host have is on at least that share of the pages of some block, so the suffix arrays of the
blocks find all candidates; these are then counted exactly over all blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded, lower_ascii, staged, whole

MIN_TOKENS = 6
#: Least share of a host's distinct pages, and least of these, for a repeated substring to be boilerplate:
#: outside of a page's marked article, and within it, where a passage that many articles
#: quote must stay.
SHARE, PAGES = 0.5, 8
ARTICLE_SHARE, ARTICLE_PAGES = 0.9, 50
#: Least share of a page's text that its marked zones must hold to be its text alone; a page
#: with less in them has its text elsewhere, beside teasers.
MARKED = 0.5
#: Characters of html in a block of pages, and what a page counts besides.
BLOCK_CHARS, PAGE_CHARS = 1_500_000, 200
#: Repeated texts up to which they are broadcast to the pages, about 150 MB.
BROADCAST_TEXTS = 1_000_000

CHROME, PLAIN, MAIN, ARTICLE = range(4)
_SLACK = 1e-6  # of sums of weights

# Element names by what they mean for the text.
SKIPPED = frozenset("script style noscript template svg iframe object textarea select button option head title math canvas audio video".split())
CHROME_TAGS = frozenset("nav footer aside form header dialog menu".split())
BREAKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr thead tbody caption section article blockquote pre figure figcaption "
    "hr main nav header footer aside form fieldset address details summary body html dialog menu".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements that a class, role or id can make chrome; headings, paragraphs and what stands in a
#: line are text, whatever they are called.
CONTAINERS = frozenset("div section ul ol dl table".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice gdpr "
    "popup modal newsletter subscribe subscription sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment "
    "comments reply replies disqus respond share sharing social related recommended widget toolbar pagination pager copyright "
    "masthead topbar search login signup complementary contentinfo hidden alert".split()
)
OUTER_WORDS = frozenset("header banner".split())
#: Words that say nothing on their own: ``site-footer`` is chrome, ``ad-hoc`` is not.
NEUTRAL_WORDS = frozenset("site page top bottom left right container wrapper wrap box block list area section bar inner outer global main primary secondary row".split())
ARTICLE_WORDS = re.compile(r"\b(?:article-?body|post-content|entry-content|article-content|story-body)\b", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?A-Za-z][^>]*(?:>|\Z)", re.S)
_MARKS = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[^A-Za-z0-9]+")


def _names_chrome(value: str, inner: bool) -> bool:
    """Whether one of the names in a class, role or id is made of chrome words."""
    for name in value.split():
        parts = {p for p in _PARTS.split(name) if p} - NEUTRAL_WORDS
        if parts and parts <= (CHROME_WORDS if inner else CHROME_WORDS | OUTER_WORDS):
            return True
    return False


def _is_chrome(tag: str, attributes: str, inner: bool) -> bool:
    """Whether an element is chrome; ``inner`` inside a marked article or main part, where an
    id alone does not count: it is the anchor of a heading."""
    if tag in CHROME_TAGS and not (tag == "header" and inner):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif tag in CONTAINERS and (name in ("class", "role") or (name == "id" and not inner)) and _names_chrome(value, inner):
            return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order, chrome and empty ones left out. Character
    references are decoded, white space is one space."""
    page = whole(page)
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    zones: list[tuple[str, int]] = []  # open main and article elements
    open_zones: Counter[str] = Counter()
    endless: set[str] = set()  # elements without an end from here on
    chrome, depth = "", 0  # the element that opened chrome, and how many of its name are open

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((zones[-1][1] if zones else PLAIN, text))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            if not chrome:
                parts.append(page[at:])
            break
        if not chrome and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SKIPPED and not closing and not m[3].endswith("/"):
            finish = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if finish is None:
                endless.add(tag)
            if finish:
                at = finish.end()
            elif tag in ("script", "style", "noscript", "template", "textarea", "iframe"):
                break  # nothing after it is text
            continue
        if chrome:
            if tag == chrome and tag not in VOID:
                depth += -1 if closing else 1
            # A paragraph or item that is not closed ends where the next block begins.
            if depth <= 0 or (chrome in ("p", "li") and not closing and tag in BREAKS and depth == 1 and tag != chrome):
                chrome, depth = "", 0
            if chrome:
                continue
            if closing:
                continue
        if tag in BREAKS:
            close()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if closing:
            if open_zones[tag]:
                close()
                last = None
                while last != tag:
                    last = zones.pop()[0]
                    open_zones[last] -= 1
            continue
        if tag not in VOID and _is_chrome(tag, m[3], bool(zones)):
            chrome, depth = tag, 1
        elif tag == "article" or (m[3] and tag in ("div", "section") and ARTICLE_WORDS.search(m[3])):
            close()
            zones.append((tag, ARTICLE))
            open_zones[tag] += 1
        elif tag == "main" or (zones and tag in ("div", "section") and zones[-1][0] == tag):
            # Same-named elements inside are counted, so that their ends do not end the zone.
            close()
            zones.append((tag, max(MAIN, zones[-1][1]) if zones else MAIN))
            open_zones[tag] += 1
    if not chrome:
        close()
    return out


def candidates(page: str | None) -> tuple[int, list[str]]:
    """The blocks that may be a page's text, and the best zone among them: those in marked articles
    and main parts, or all, if these hold less than ``MARKED`` of the text."""
    found = blocks(page)
    marked = [(z, text) for z, text in found if z > PLAIN]
    if not marked or sum(len(t) for _, t in marked) < MARKED * sum(len(t) for _, t in found):
        return PLAIN, [text for _, text in found]
    return max(z for z, _ in marked), [text for _, text in marked]


def _stream(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concatenated tokens of pages as small numbers, each page followed by a number of its
    own; 64-bit hashes of the tokens; the page of each position."""
    numbers: dict[str, int] = {}
    hashes: list[int] = []
    ids, owner = [], []
    for p, texts in enumerate(pages):
        for text in texts:
            for token in text.split(" "):
                n = numbers.get(token)
                if n is None:
                    n = numbers[token] = len(hashes)
                    hashes.append(xxhash.xxh64_intdigest(token, 1))
                ids.append(n)
                owner.append(p)
        ids.append(-1 - p)
        owner.append(p)
    ids = np.array(ids, dtype=np.int64)
    ends = ids < 0
    table = np.array([*hashes, 0], dtype=np.uint64)
    hashed = table[np.where(ends, len(hashes), ids)]
    hashed[ends] = ids[ends].view(np.uint64)
    ids[ends] = len(hashes) - 1 - ids[ends]
    return ids, hashed, np.array(owner, dtype=np.int64)


def suffix_ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix among all by its first ``length`` tokens; equal ones have equal
    ranks. Prefix doubling: ranks by 2k tokens come from pairs of ranks by k tokens."""
    n = len(ids)

    def both(first: np.ndarray, second: np.ndarray, by: int) -> np.ndarray:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - by)] = second[by:] + 1
        return np.unique(first * (n + 2) + after, return_inverse=True)[1].astype(np.int64)

    ranks, done = {1: np.unique(ids, return_inverse=True)[1].astype(np.int64)}, 1
    while 2 * done <= length:
        ranks[2 * done] = both(ranks[done], ranks[done], done)
        done *= 2
    out = ranks[done]
    for step in sorted(ranks, reverse=True)[1:]:
        if done + step <= length:
            out = both(out, ranks[step], done)
            done += step
    return out


def _grams(hashed: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` tokens from each position that has as many."""
    n = max(0, len(hashed) - length + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out = (out + hashed[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def repeated(pages: list[list[str]], share: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the substrings of ``MIN_TOKENS`` tokens that at least this share of the pages,
    or of their weights, have, by the suffix array of their concatenation."""
    weights = np.ones(len(pages)) if weights is None else weights
    ids, hashed, owner = _stream(pages)
    if len(ids) < MIN_TOKENS:
        return np.zeros(0, dtype=np.uint64)
    ranks = suffix_ranks(ids, MIN_TOKENS)
    order = np.argsort(ranks, kind="stable")  # the suffix array, as far as it matters
    sorted_ranks, pages_in_order = ranks[order], owner[order]
    # Within a rank positions ascend, so pages do: distinct ones are where a page begins.
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = sorted_ranks[1:] != sorted_ranks[:-1]
    fresh = begins.copy()
    fresh[1:] |= pages_in_order[1:] != pages_in_order[:-1]
    counts = np.add.reduceat(np.where(fresh, weights[pages_in_order], 0.0), np.flatnonzero(begins))
    at = order[np.flatnonzero(begins)]
    # No page's end may be inside.
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    ends = last[owner]
    at = at[(counts >= share * weights.sum() - _SLACK) & (at + MIN_TOKENS <= ends[at])]
    return _grams(hashed, MIN_TOKENS)[at]


def unique_runs(texts: list[str], boilerplate: np.ndarray) -> list[str]:
    """The blocks without the tokens that boilerplate substrings cover. Where a substring goes
    on into the next block, fewer than ``MIN_TOKENS`` covered tokens of a longer one stay."""
    if not len(boilerplate) or not texts:
        return texts
    ids, hashed, _ = _stream([texts])
    hit = np.isin(_grams(hashed, MIN_TOKENS), boilerplate)
    if not hit.any():
        return texts
    covered = np.zeros(len(ids), dtype=bool)
    for i in range(MIN_TOKENS):
        covered[i : i + len(hit)] |= hit
    out, at = [], 0
    for text in texts:
        tokens = text.split(" ")
        gone = covered[at : at + len(tokens)]
        at += len(tokens)
        if not gone.all():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            for start, stop in edges.reshape(-1, 2).tolist():
                if stop - start < MIN_TOKENS:
                    gone[start:stop] = False
        kept = [t for t, out_of in zip(tokens, gone, strict=True) if not out_of]
        if kept:
            out.append(" ".join(kept))
    return out


def _by_zone(frame: pd.DataFrame) -> Iterator[tuple[bool, list[int], list[list[str]]]]:
    """Positions and blocks of pages without and with a marked article."""
    marks = frame["article"].to_numpy(dtype=bool)
    for marked in (False, True):
        at = np.flatnonzero(marks == marked).tolist()
        bodies = [frame["body"].iloc[i] for i in at]
        yield marked, at, [body.split("\n") if body else [] for body in bodies]


def _share(marked: bool) -> float:
    return ARTICLE_SHARE if marked else SHARE


_FOUND = "host string, blocks int, marked boolean, gram long, n double, pages double"


def _rows(frame: pd.DataFrame, marked: bool, grams: np.ndarray, n, pages: float = 0.0) -> pd.DataFrame:
    key = {"host": frame["host"].iloc[0], "blocks": frame["blocks"].iloc[0], "marked": marked}
    return pd.DataFrame({**key, "gram": grams.view(np.int64), "n": n, "pages": pages}, index=range(len(grams)))


_KINDS = {"host": object, "blocks": "int64", "marked": bool, "gram": "int64", "n": "float64", "pages": "float64"}


def _table(parts: list[pd.DataFrame]) -> pd.DataFrame:
    parts = [p for p in parts if len(p)] or [pd.DataFrame({c: pd.Series([], dtype=k) for c, k in _KINDS.items()})]
    return pd.DataFrame({c: pd.Series(np.concatenate([p[c].to_numpy() for p in parts]), dtype=k) for c, k in _KINDS.items()})


def _candidates(frame: pd.DataFrame) -> pd.DataFrame:
    """Substrings that are frequent among the pages of one block."""
    out = []
    for marked, at, texts in _by_zone(frame):
        weights = frame["weight"].to_numpy(dtype=float)[at]
        # A host's only block with too few pages has none; one of several blocks may.
        if at and (frame["blocks"].iloc[0] > 1 or weights.sum() >= (ARTICLE_PAGES if marked else PAGES) - _SLACK):
            grams = np.unique(repeated(texts, _share(marked), weights))
            out.append(_rows(frame, marked, grams, 0))
    return _table(out)


def _counted(frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """The weight of the pages of one block that have each wanted substring, and of all its
    pages; every block of a host is asked for each, so the sums are those of the host."""
    out = []
    for marked, at, texts in _by_zone(frame) if len(frame) and len(wanted) else ():
        grams = np.unique(wanted.loc[wanted["marked"] == marked, "gram"].to_numpy(dtype=np.int64)).view(np.uint64)
        if at and len(grams):
            weights, total = frame["weight"].to_numpy(dtype=float)[at], np.zeros(len(grams))
            for page, weight in zip(texts, weights.tolist(), strict=True):
                total += weight * np.isin(grams, _grams(_stream([page])[1], MIN_TOKENS))
            out.append(_rows(frame, marked, grams, total, weights.sum()))
    return _table(out)


_TEXT = "page_id long, url string, text string"


def _extracted(frame: pd.DataFrame, boilerplate: pd.DataFrame) -> pd.DataFrame:
    texts = [""] * len(frame)
    for marked, at, found in _by_zone(frame):
        grams = boilerplate.loc[boilerplate["marked"] == marked, "gram"].to_numpy(dtype=np.int64).view(np.uint64)
        for i, page in zip(at, found, strict=True):
            texts[i] = "\n".join(unique_runs(page, grams))
    return pd.DataFrame({"page_id": frame["page_id"].astype(object), "url": frame["url"].astype(object), "text": pd.Series(texts, dtype=object, index=frame.index)})


def host_of(url: Column) -> Column:
    """Between :// and the next /, ? or #, A-Z in lower case; empty where there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def _parsed(page: Column) -> Column:
    """Struct of article, whether the page marks one, and body, its blocks by line."""

    @F.pandas_udf("article boolean, body string")
    def parsed(pages: pd.Series) -> pd.DataFrame:
        found = [candidates(p) for p in pages]
        return pd.DataFrame({"article": [zone > PLAIN for zone, _ in found], "body": pd.Series(["\n".join(texts) for _, texts in found], dtype=object)})

    return parsed(page)


def extract(pages: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text, a null url belongs to the host without a name;
    repeated rows stay repeated and count as one page; other columns are not read.
    """
    # The number of a row deals out repeated rows; a scan's is the same in every retry.
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"), F.monotonically_increasing_id().alias("row"))
    empty = pages.where(F.col("html").isNull() | (F.col("html") == "")).select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit("").alias("text"))
    own = own.where(F.col("html") != "")
    # Hosts of more than one block, stored: their size is known when the join is planned, and
    # the pages need not be shuffled for it where it is small.
    large = own.groupBy("host").agg(F.ceil(F.sum(F.length("html") + F.lit(PAGE_CHARS).cast("long")) / block_chars).cast("int").alias("n")).where("n > 1")
    large = staged(large.select(F.col("host").alias("large_host"), "n"), "large")
    own = own.withColumn("p", _parsed(F.col("html"))).select("page_id", "url", "host", "row", "p.article", "p.body", F.md5("p.body").alias("digest"))
    # Each of n copies weighs 1 / n, so a text counts once wherever its copies are dealt to.
    repeats = own.groupBy("host", "article", "digest").agg(F.count("*").alias("copies")).where("copies > 1")
    repeats = staged(repeats.toDF("of_host", "of_article", "of_digest", "copies"), "repeats")
    same = (F.col("host") == F.col("of_host")) & (F.col("article") == F.col("of_article")) & (F.col("digest") == F.col("of_digest"))
    own = own.join(bounded(repeats, BROADCAST_TEXTS), same, "left").withColumn("weight", F.lit(1.0) / F.coalesce("copies", F.lit(1)))
    sized = own.join(large, F.col("host") == F.col("large_host"), "left").withColumn("blocks", F.coalesce("n", F.lit(1)))
    at = ("host", "blocks", "block")
    blocked = sized.select(
        "page_id", "url", "article", "body", "weight", "host", "blocks", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block")
    ).groupBy(*at)

    def each_block(grams: DataFrame) -> DataFrame:
        """Substrings of a host, sent to each of its blocks."""
        return grams.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy(*at)

    # All three passes over the texts are one plan and read the same shuffled blocks.
    some = blocked.applyInPandas(_candidates, _FOUND).select("host", "blocks", "marked", "gram").distinct()
    counted = blocked.cogroup(each_block(some)).applyInPandas(_counted, _FOUND)
    summed = counted.groupBy("host", "blocks", "marked", "gram").agg(F.round(F.sum("n")).alias("n"), F.round(F.sum("pages")).alias("pages"))
    share = F.when(F.col("marked"), F.lit(ARTICLE_SHARE)).otherwise(SHARE)
    least = F.when(F.col("marked"), F.lit(ARTICLE_PAGES)).otherwise(PAGES)
    boilerplate = summed.where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))
    cut = blocked.cogroup(each_block(boilerplate.select("host", "blocks", "marked", "gram"))).applyInPandas(_extracted, _TEXT)
    return cut.unionByName(empty)
