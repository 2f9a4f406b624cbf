"""URL verdicts: listed rules first, gradient-boosted trees on lexical features for the rest.

Everything is a column expression or a JVM model; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded, lower_ascii, staged

#: Bound of the labelled URLs the trees are fitted on.
SAMPLE_URLS = 4_000
#: Suffixes or segments up to which their statistics are broadcast, about 30 MB.
BROADCAST_PARTS = 200_000
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens",
    "parameters", "entropy", "host_entropy", "has_fragment", "secure", "suffix_length", "suffix_block_rate", "suffix_share", "segment_block_rate", "segment_share",
)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules the query applies.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z in lower case; else empty."""
    rest = _rest(url)
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest rule that fits, null for none; rules are few and become one
    expression. Of equally long ones the first by name counts."""
    fits = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        inside = (host == rule.host) | host.endswith("." + rule.host)
        fits = F.when(inside & path.startswith(rule.path), F.lit(rule.name)).otherwise(fits)
    return fits


def verdict_of(rule: Column, rules: tuple[Rule, ...]) -> Column:
    return F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)])[rule]


def _ratio(text: Column, pattern: str) -> Column:
    size = F.length(text)
    return (size - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(size, F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character: over runs of the sorted characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    size = F.greatest(F.size(chars), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def segment_of(path: Column) -> Column:
    """The first segment of a path that goes on after it; else empty."""
    return F.regexp_extract(path, r"(?s)\A/([^/]*)/", 1)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (columns url, host, path, ...) with the features but the statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
            "labels": F.size(F.split(host, r"\.")).cast("double"),
            "digit_ratio": _ratio(url, "[0-9]"),
            "host_digit_ratio": _ratio(host, "[0-9]"),
            "hyphens": (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double"),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
            "entropy": _entropy(url),
            "host_entropy": _entropy(host),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "secure": url.startswith("https://").cast("double"),
            "suffix": suffix_of(host),
            "segment": segment_of(path),
            "suffix_length": F.length(F.substring_index(host, ".", -1)).cast("double"),
        }
    )


@dataclass(frozen=True)
class Model:
    """The trees and the statistics of suffixes and first path segments of all URLs;
    ``trees`` is None where no URL was labelled or all had one verdict, which is then
    ``only``."""

    trees: GBTClassificationModel | None
    statistics: dict[str, DataFrame]
    only: str = "allow"


def _statistics(urls: DataFrame, part: str, value: Column) -> DataFrame:
    """Share of blocked ones among the labelled rows (smoothed towards one half) and of all
    rows, by suffix or segment."""
    counted = urls.groupBy(value.alias(f"known_{part}")).agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.sum("blocked").alias("bad"))
    counted = staged(counted, part)
    total = counted.agg(F.sum("n")).first()[0] or 1
    rate, share = (F.coalesce("bad", F.lit(0.0)) + 5.0) / (F.col("labelled") + 10.0), F.col("n") / F.lit(total)
    return bounded(counted.select(f"known_{part}", rate.alias(f"{part}_rate"), share.alias(f"{part}_part")), BROADCAST_PARTS)


def _with_statistics(lexed: DataFrame, statistics: dict[str, DataFrame]) -> DataFrame:
    # Broadcast up to a bound, so few suffixes shuffle no URL; those not seen have no share.
    for part, known in statistics.items():
        lexed = lexed.join(known, lexed[part] == known[f"known_{part}"], "left").withColumns(
            {f"{part}_block_rate": F.coalesce(f"{part}_rate", F.lit(0.5)), f"{part}_share": F.coalesce(f"{part}_part", F.lit(0.0))}
        )
    return lexed


def fit(labelled: DataFrame, sample_urls: int = SAMPLE_URLS, trees: int = 20, depth: int = 4) -> Model:
    """Fits the trees on at most ``sample_urls`` distinct labelled URLs, those with the
    smallest hashes; the statistics are of all rows. ``labelled``: url, host, path, blocked
    (0.0 or 1.0, null for a URL that only counts in the shares)."""
    sample = (
        labelled.select("url", "host", "path", "blocked").where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
        .groupBy("url", "host", "path").agg(F.max("blocked").alias("blocked"))
        .orderBy(F.xxhash64("url"), "url").limit(sample_urls)
    )
    sample = staged(sample, "urls")
    verdicts = {r["blocked"]: r["count"] for r in sample.groupBy("blocked").count().collect()}
    statistics = {part: _statistics(labelled, part, value) for part, value in (("suffix", suffix_of(F.col("host"))), ("segment", segment_of(F.col("path"))))}
    if len(verdicts) < 2:
        return Model(None, statistics, "block" if 1.0 in verdicts else "allow")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    ready = assembler.transform(_with_statistics(lexical(sample), statistics)).select("features", "blocked").coalesce(1)
    boosted = GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=trees, maxDepth=depth, seed=17, maxBins=32)
    return Model(boosted.fit(ready), statistics)


def judge(urls: DataFrame, model: Model, rules: tuple[Rule, ...], key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, blocked_probability for every row.

    Null URLs and those without :// have an empty host and path, fit no rule and are judged by
    the trees; repeated rows stay repeated; other columns are not read.
    """
    split = urls.select(F.col(key).alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if model.trees is None:
        scored = split.withColumn("p", F.lit(1.0 if model.only == "block" else 0.0))
    else:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        lexed = _with_statistics(lexical(split), model.statistics)
        scored = model.trees.transform(assembler.transform(lexed)).withColumn("p", vector_to_array("probability")[1])
    own = F.when(F.col("p") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), own).alias("verdict"), F.col("p").alias("blocked_probability"),
    )


def filter_urls(urls: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id") -> DataFrame:
    """Fits on the URLs the rules label, with statistics of all URLs, and judges all of ``urls``."""
    split = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    labelled = split.withColumn("blocked", (verdict_of(rule, rules) == "block").cast("double"))
    return judge(urls, fit(labelled), rules, key)
