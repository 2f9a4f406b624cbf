"""Benchmark decontamination with a distributed positional inverted index.

Terms are the words of documents and benchmark items. A test phrase is a window of ``length``
consecutive item words. For each window the rarest of its terms in the documents is its
anchor; the index stores a posting (document, position) for every occurrence of an anchor
term. A posting less the anchor's offset in the window is a start; at each such start the
rest of the window is compared, so an occurrence is exact. ``near`` finds terms close to each
other instead of in a row.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import bounded, lower_ascii, staged

LENGTH = 13

#: Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Anchors or keys up to which a table is broadcast, about 20 MB; single terms, about 60 MB.
BROADCAST_ROWS, BROADCAST_TERMS = 100_000, 1_000_000


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(F.coalesce(lower_ascii(text), F.lit("")), BETWEEN), lambda w: w != "")


def windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Distinct windows: window (words), items (ids as sorted strings, a null id last). An item of
    fewer words is one window; one without words has none."""
    split = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    each = split.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), length).alias("window"))
    return each.groupBy("window").agg(_ids("item").alias("items"))


def _ids(item: str) -> Column:
    """Distinct ids in order, the null id, which ``collect_set`` skips, as one of them."""
    return F.array_sort(F.transform(F.collect_set(F.struct(F.col(item).alias("id"))), lambda x: x["id"]))


def _bounded(df: DataFrame) -> DataFrame:
    return bounded(df, BROADCAST_ROWS)


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences in all documents of each of ``terms`` (term); those without any count 0.

    Terms that can't be broadcast meet counts, not occurrences."""
    found = docs.select(F.explode(words(F.col(text))).alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        found = found.join(F.broadcast(terms), "term", "left_semi")
    counted = found.groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """``tests`` with the rarest term of each window that occurs in the documents and its
    offset (ties: the first term, then the first offset). Windows with a term that never occurs
    have no anchor, as they cannot occur."""
    placed = tests.select("window", "items", F.posexplode("window").alias("offset", "term"))
    ranked = placed.join(_bounded(counts), "term").groupBy("window").agg(
        F.min(F.struct("n", "term", "offset")).alias("rarest"), F.first("items").alias("items")
    )
    return ranked.where(F.col("rarest.n") > 0).select("window", "items", "rarest.term", "rarest.offset")


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text and a digest that tells apart rows that share a key."""
    return docs.select(F.col(key).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))


def postings(docs: DataFrame, anchored: DataFrame, length: int = LENGTH) -> DataFrame:
    """The index: doc_id, digest, term, start, window, span for each occurrence of an anchor,
    ``span`` being the document's words at the adjusted offset. Repeated rows count once."""
    split = docs.select("doc_id", "digest", words(F.col("text")).alias("w"))
    placed = split.select("doc_id", "digest", "w", F.posexplode("w").alias("position", "term"))
    begins = F.lit(0)  # of ``w`` in the document
    if anchored.count() > BROADCAST_ROWS:
        # The anchors are shuffled to, so a row takes the words around its position only. It
        # does so before any join that may itself shuffle, never with the whole text.
        begins = F.greatest(F.col("position") - (length - 1), F.lit(0))
        around = F.slice("w", begins + 1, 2 * length - 1).alias("w")
        terms = anchored.select("term").distinct()
        if terms.count() <= BROADCAST_TERMS:
            placed = placed.join(F.broadcast(terms), "term", "left_semi")
        met = placed.select("doc_id", "digest", around, "position", "term").join(anchored, "term")
    else:
        # Joined before anything is shuffled; what passes is a few words wide.
        met = placed.join(F.broadcast(anchored), "term")
    inside = met.withColumn("start", F.col("position") - F.col("offset")).where(F.col("start") >= 0)
    span = F.slice("w", F.col("start") - begins + 1, F.size("window"))
    return inside.select("doc_id", "digest", "term", "start", "window", "items", span.alias("span"))


def occurrences(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, digest, start, n, items for each exact occurrence of a window."""
    tests = staged(windows(items, length), "windows")
    terms = tests.select(F.explode("window").alias("term")).distinct()
    anchored = staged(anchors(tests, term_counts(docs, terms, text)), "anchors")
    index = postings(identified(docs, key, text), anchored, length)
    exact = index.where(F.col("span") == F.col("window"))
    return exact.select("doc_id", "digest", "start", F.size("window").alias("n"), "items").distinct()


def near(docs: DataFrame, items: DataFrame, distance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Proximity matches: doc_id, item_id of documents in which the two rarest terms of the item
    (ties: the first by term) stand at most ``distance`` words apart, in any order. An item of
    one distinct term matches where it stands."""
    own = items.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    counts = term_counts(docs, own.select("term").distinct(), text)
    ranked = own.join(counts, "term").groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, 2).alias("pair"))
    pairs = ranked.select("item_id", F.size("pair").alias("wanted"), F.explode("pair.term").alias("term"))
    split = docs.select(F.col(key).alias("doc_id"), F.posexplode(words(F.col(text))).alias("position", "term"))
    met = split.join(_bounded(pairs), "term")
    order = Window.partitionBy("doc_id", "item_id").orderBy("position")
    last = F.max(F.struct("position", "term")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    close = (F.col("last.term") != F.col("term")) & (F.col("position") - F.col("last.position") <= distance)
    return met.withColumn("last", last).where((F.col("wanted") == 1) | close).select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per distinct key and text: doc_id, digest, n_hit (words inside an occurrence),
    matched (item ids as sorted strings, a null id last). Documents without an occurrence are left out; null
    keys and texts are kept apart like others."""
    found = staged(occurrences(docs, items, key, text, length), "occurrences")
    order = Window.partitionBy("doc_id", "digest").orderBy("start", "n")
    end = F.col("start") + F.col("n")
    reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = found.withColumn("hit", F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0)))
    hits = fresh.groupBy("doc_id", "digest").agg(F.sum("hit").cast("long").alias("n_hit"))
    matched = found.select("doc_id", "digest", F.explode("items").alias("item")).groupBy("doc_id", "digest").agg(_ids("item").alias("matched"))
    return _same(hits, matched).select(hits["doc_id"], hits["digest"], "n_hit", "matched")


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right, left["doc_id"].eqNullSafe(right["doc_id"]) & (left["digest"] == right["digest"]), how)


def judged(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row of ``docs``: doc_id, n_words, n_hit, matched, contaminated (any hit, and hits
    in at least a twentieth of the words)."""
    hit = contamination(docs, items, key, text, length)
    sized = identified(docs, key, text).select("doc_id", "digest", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return _same(sized, hit, "left").select(
        sized["doc_id"], "n_words", n_hit.alias("n_hit"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they are."""
    hit = contamination(docs, items, key, text)
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    # Only documents that are hit can go; few, so Spark can send their keys to the texts.
    size = identified(docs, key, text).select("doc_id", "digest", F.size(words(F.col("text"))).alias("n_words")).distinct()
    bad = _same(size, hit).where(20 * F.col("n_hit") >= F.col("n_words")).select(
        size["doc_id"].alias("bad_id"), size["digest"].alias("bad_digest")
    )
    return docs.join(_bounded(staged(bad, "contaminated")), F.col(key).eqNullSafe(F.col("bad_id")) & (digest == F.col("bad_digest")), "left_anti")
