"""Token counts under a unigram vocabulary, by dynamic programming shared in a trie.

A text is cut into pre-tokens; each is split into vocabulary pieces so that the sum of
their costs is least (of equal sums, the fewest pieces). The best split of a prefix does
not depend on what follows, so distinct pre-tokens are put in a trie and each node has the
best cost and count of its prefix: a prefix that many words share is solved once.
"""

from __future__ import annotations

import base64
import itertools
import math
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import whole

#: Solved pre-tokens a generation keeps, characters of text split at a time, and bytes from
#: which a pre-token is solved alone. They bound memory, not results.
MAX_WORDS = 400_000
CHARS = 4_000_000
LONG = 256

#: A sum of costs and the number of its pieces as one whole number, the pieces in the low bits.
_PIECES = 32

#: Pre-tokens: contractions, then letters, digits or signs with the space before them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Costs are whole numbers so that sums are exact: thousandths of the log of the rank.
SCALE = 1000


def rank_costs(path: str) -> dict[bytes, int]:
    """Costs of a vocabulary file with lines of a base64 piece and its rank: the n-th
    piece has a probability in proportion to 1 / (n + 1), as words by frequency have."""
    out = {}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            piece, rank = line.split()
            out[base64.b64decode(piece)] = round(SCALE * math.log(int(rank) + 2))
    return out


class Vocabulary:
    """The trie of the pieces: node 0 is the root; a step is keyed by node and byte."""

    def __init__(self, costs: dict[bytes, int]):
        steps: dict[int, int] = {}
        prices = [-1]
        for piece, cost in costs.items():
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in steps:
                    steps[key] = len(prices)
                    prices.append(-1)
                node = steps[key]
            if piece:
                prices[node] = cost << _PIECES | 1
        order = sorted(steps)
        self.keys = np.array(order, dtype=np.int64)
        self.nodes = np.array([steps[k] for k in order], dtype=np.int64)
        self.prices = np.array(prices, dtype=np.int64)
        self.first = np.full(256, -1, dtype=np.int64)
        root = self.keys < 256
        self.first[self.keys[root]] = self.nodes[root]
        self.steps = steps

    def step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where ``byte`` leads from ``nodes``, -1 where no piece goes on."""
        keys = nodes << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, self.nodes[at], -1) if len(self.keys) else np.full(len(keys), -1)


class Trie:
    """Token counts by pre-token for one vocabulary.

    New pre-tokens are put in a trie that is solved depth by depth, all nodes of a depth at
    once: a node knows where its prefix's pieces may have begun, as the nodes of the
    vocabulary they have come to, so only beginnings that some piece continues are looked at.
    Terminal counts are kept in two generations: when the younger one is full, it
    becomes the older one, whose words move up as they are met, so frequent words stay.

    A byte that no piece covers costs ``unknown`` and counts as one token.
    """

    def __init__(self, costs: dict[bytes, int], max_words: int = MAX_WORDS):
        self.vocabulary = Vocabulary(costs)
        self.unknown = SCALE * 20 << _PIECES | 1
        self.max_words = max_words
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def counts(self, words: set[str]) -> dict[str, int]:
        """Tokens by pre-token, for these and maybe more; valid until the next call."""
        if len(self.young) > self.max_words:
            self.old, self.young = self.young, {}
        new = []
        for word in words.difference(self.young):
            if (known := self.old.get(word)) is None:
                new.append(word)
            else:
                self.young[word] = known
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        self.young.update(zip(new, self.solve(data), strict=True))
        return self.young

    def solve(self, words: list[bytes]) -> list[int]:
        """Tokens of each word."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out = [0] * len(words)
        table = [i for i in order if len(words[i]) <= LONG]
        for i, n in zip(table, self._by_depth([words[i] for i in table]), strict=True):
            out[i] = n
        for i in order:
            if len(words[i]) > LONG:
                out[i] = self._alone(words[i])
        return out

    def _by_depth(self, words: list[bytes]) -> list[int]:
        """The same for sorted words, whose equal prefixes are neighbours."""
        vocabulary, unknown = self.vocabulary, self.unknown
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        at = np.cumsum(lengths) - lengths
        out = np.zeros(len(words), dtype=np.int64)
        active = np.arange(len(words))
        above = np.zeros(len(words), dtype=np.int64)  # each active word's node, one depth up
        values = np.zeros(min(1, len(words)), dtype=np.int64)
        begun: list[tuple[np.ndarray, np.ndarray]] = []  # by beginning: vocabulary nodes, values there
        depth = 0
        while True:
            more = lengths[active] > depth
            out[active[~more]] = values[above[~more]]
            active, above = active[more], above[more]
            if not len(active):
                return (out & ((1 << _PIECES) - 1)).tolist()
            byte = data[at[active] + depth]
            fresh = np.ones(len(active), dtype=bool)
            fresh[1:] = (above[1:] != above[:-1]) | (byte[1:] != byte[:-1])
            parent, step = above[fresh], byte[fresh]
            above = np.cumsum(fresh) - 1
            before = values[parent]
            values, going = before + unknown, []
            for nodes, value in [*((n[parent], v[parent]) for n, v in begun), (None, before)]:
                if nodes is None:
                    nodes = vocabulary.first[step]
                else:
                    alive = np.flatnonzero(nodes >= 0)
                    nodes[alive] = vocabulary.step(nodes[alive], step[alive])
                alive = np.flatnonzero(nodes >= 0)
                if len(alive):
                    price = vocabulary.prices[nodes[alive]]
                    ends = alive[price >= 0]
                    values[ends] = np.minimum(values[ends], value[ends] + price[price >= 0])
                    going.append((nodes, value))
            begun, depth = going, depth + 1

    def _alone(self, word: bytes) -> int:
        """The same for one long word, byte by byte, keeping only the beginnings that go on."""
        steps, prices = self.vocabulary.steps, self.vocabulary.prices
        value, begun = 0, []
        for byte in word:
            best, going = value + self.unknown, []
            for node, start in [*begun, (0, value)]:
                following = steps.get(node << 8 | byte)
                if following is not None:
                    price = int(prices[following])
                    if price >= 0:
                        best = min(best, start + price)
                    going.append((following, start))
            value, begun = best, going
        return value & ((1 << _PIECES) - 1)


def _portions(texts: Iterable[str | None], pattern: regex.Pattern, chars: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Pre-tokens of some texts at a time: their positions and words. Up to ``chars`` characters
    go together; the words of a longer text come in several portions."""
    where: list[int] = []
    found: list[list[str]] = []
    size = 0
    for i, text in enumerate(map(whole, texts)):
        if len(text) > chars:
            words = (m.group() for m in pattern.finditer(text))
            while part := list(itertools.islice(words, chars // 4)):
                yield [i], [part]
            continue
        where.append(i)
        found.append(pattern.findall(text))
        size += len(text)
        if size >= chars:
            yield where, found
            where, found, size = [], [], 0
    if where:
        yield where, found


def count_texts(texts: Sequence[str | None], trie: Trie, pattern: regex.Pattern, chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and pre-tokens of whole texts; null and empty have none."""
    tokens, words = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for where, found in _portions(texts, pattern, chars):
        counts = trie.counts(set().union(*found)).__getitem__
        for i, part in zip(where, found, strict=True):
            tokens[i] += sum(map(counts, part))
            words[i] += len(part)
    return tokens, words


def token_counts(text: Column, costs: dict[bytes, int], pattern: str = PATTERN) -> Column:
    """Struct n_tokens, n_words of a text column. ``costs`` goes to the executors once, as
    a broadcast of the vocabulary's size, which is fixed."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(costs)

    @F.pandas_udf("n_tokens long, n_words long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        tokens, words = count_texts(texts.tolist(), _task_trie(shared), regex.compile(pattern))
        return pd.DataFrame({"n_tokens": tokens, "n_words": words})

    return counted(text)


_TRIES: dict[int, tuple[Trie, dict[bytes, int]]] = {}


def _task_trie(shared) -> Trie:
    """The worker's trie for a vocabulary; it is kept between batches."""
    costs = shared.value
    if id(costs) not in _TRIES:
        _TRIES.clear()
        _TRIES[id(costs)] = (Trie(costs), costs)  # costs are held, so that their id stays in use
    return _TRIES[id(costs)][0]


def count_documents(docs: DataFrame, costs: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_words of every row of ``docs``, in one pass without a shuffle. Null and
    empty texts have no tokens; a null key stays null, repeated rows are counted each for
    itself, an empty table gives an empty one, and other columns do not matter."""
    counted = docs.select(F.col(key).alias("doc_id"), token_counts(F.col(text), costs).alias("counted"))
    return counted.select("doc_id", "counted.n_tokens", "counted.n_words")
