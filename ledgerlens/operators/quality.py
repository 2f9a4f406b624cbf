"""Integrity, uniqueness and reconciliation checks.

Checks compare tables by stacking their keys or sums and grouping once, so one
shuffle of pre-combined rows answers a whole family of checks and no join can
fan out. ``key_counts`` is that grouping for keys; several reports can share it. Reports list every check, also those that found nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.amounts import number, total
from ledgerlens.schema import (
    ENTITIES,
    ENTITY_OF_TABLE,
    FOREIGN_KEYS,
    GRAINS,
    RELATIONSHIPS,
    SCHEMAS,
    ForeignKey,
    Terms,
)


class QualityError(AssertionError):
    """A quality report with failing checks."""


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- referential integrity ---------------------------------------------------


def fk_orphans(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Child rows whose key has no parent; a null key has none."""
    keys = parent.select(F.col(ENTITY_OF_TABLE[key.parent].key).alias(key.column)).distinct()
    return child.join(keys, key.column, "left_anti")


def unique_keys() -> list[tuple[str, tuple[str, ...]]]:
    """All column sets that must be unique: entity keys, then monthly grains."""
    return [(e.table, (e.key,)) for e in ENTITIES] + list(GRAINS.items())


def _references() -> dict[str, list[tuple[str, str]]]:
    """By table, the (child, column) that refer to its key: foreign keys, and source keys of
    relationships, most of which are the same columns."""
    table_of = {e.name: e.table for e in ENTITIES}
    found: dict[str, list[tuple[str, str]]] = {}
    for parent, child in [(k.parent, (k.child, k.column)) for k in FOREIGN_KEYS] + [(table_of[r.source], (r.binding, r.source_key)) for r in RELATIONSHIPS]:
        if child not in found.setdefault(parent, []):
            found[parent].append(child)
    return found


REFERENCES = _references()
_ROLES = max(map(len, REFERENCES.values()))


def key_columns() -> dict[str, list[str]]:
    """The columns of each table that integrity is about: its key, references, grain."""
    found = {e.table: [e.key] for e in ENTITIES}
    for children in REFERENCES.values():
        for child, column in children:
            found[child].append(column)
    for table, grain in GRAINS.items():
        found[table] += grain
    return {table: list(dict.fromkeys(names)) for table, names in found.items()}


def key_counts(dfs: dict[str, DataFrame], references: bool = True) -> DataFrame:
    """One row per key that is there or referred to: (table_name, key_columns, key, copies, refs,
    edges). ``refs`` counts the rows that refer to it and ``edges`` those of them that are edges,
    each in the order of ``REFERENCES``.

    Every table is read once: a row gives its own key, its grain and all it refers to, each
    with what it is, and all of them are grouped once. Copies, orphans, degrees and
    cardinalities are all read off this. Counts combine before the shuffle, so a hot key is a row a
    task. Without ``references`` only the keys themselves are read and counted.
    """
    unique = unique_keys()
    frames = []
    for table, df in dfs.items():
        own = F.col(ENTITY_OF_TABLE[table].key)
        facts = [
            (i, F.to_json(F.struct(*key)) if len(key) > 1 else F.col(key[0]), 0, F.lit(False)) for i, (name, key) in enumerate(unique) if name == table
        ]
        for parent, children in REFERENCES.items() if references else ():
            place = next(i for i, (name, _) in enumerate(unique) if name == parent)
            facts += [
                (place, F.col(column), role, F.col(column).isNotNull() & own.isNotNull())
                for role, (child, column) in enumerate(children, 1)
                if child == table
            ]
        rows = [
            F.struct(F.lit(i).alias("space"), key.alias("key"), F.lit(role).alias("role"), edge.alias("edge")) for i, key, role, edge in facts
        ]
        frames.append(df.select(F.explode(F.array(*rows)).alias("k")).select("k.*"))
    role, edge = F.col("role"), F.col("edge")
    roles = range(1, (_ROLES if references else 0) + 1)
    counted = _stack(frames).groupBy("space", "key").agg(
        F.count_if(role == 0).alias("copies"),
        *[F.count_if(role == r).alias(f"r{r}") for r in roles],
        *[F.count_if((role == r) & edge).alias(f"e{r}") for r in roles],
    )

    def named(texts: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, texts)), F.col("space") + 1)

    return counted.select(
        named([t for t, _ in unique]).alias("table_name"), named([",".join(k) for _, k in unique]).alias("key_columns"), "key", "copies",
        F.array(*[f"r{r}" for r in roles]).alias("refs"), F.array(*[f"e{r}" for r in roles]).alias("edges"),
    )


def fk_report(dfs: dict[str, DataFrame], counts: DataFrame | None = None) -> DataFrame:
    """(child, column, parent, orphans) of all foreign keys: rows that refer to a key which no row
    has, or to none. From ``counts``, the ``key_counts`` of the tables."""
    counts = key_counts(dfs) if counts is None else counts
    lost = F.col("key").isNull() | (F.col("copies") == 0)

    def orphans(k: ForeignKey) -> Column:
        there = (F.col("table_name") == k.parent) & ~F.col("key_columns").contains(",")
        return F.coalesce(F.sum(F.when(there, F.col("refs")[REFERENCES[k.parent].index((k.child, k.column))])), F.lit(0))

    sums = counts.filter(lost).agg(*[orphans(k).alias(f"c{i}") for i, k in enumerate(FOREIGN_KEYS)])
    rows = F.array(
        *[
            F.struct(F.lit(k.child).alias("child"), F.lit(k.column).alias("column"), F.lit(k.parent).alias("parent"), F.col(f"c{i}").alias("orphans"))
            for i, k in enumerate(FOREIGN_KEYS)
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


# --- uniqueness and cardinality ----------------------------------------------


def duplicate_keys(dfs: dict[str, DataFrame], counts: DataFrame | None = None) -> DataFrame:
    """Key values that occur more than once, with the number of rows."""
    counts = key_counts(dfs, references=False) if counts is None else counts
    return counts.filter("copies > 1").select("table_name", "key_columns", "key", "copies")


def key_report(dfs: dict[str, DataFrame], counts: DataFrame | None = None) -> DataFrame:
    """Rows, distinct keys and repeated keys of every key."""
    counts = key_counts(dfs, references=False) if counts is None else counts
    return (
        counts.filter("copies > 0")
        .groupBy("table_name", "key_columns")
        .agg(
            F.sum("copies").alias("row_count"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        )
    )


def entity_degree(dfs: dict[str, DataFrame], counts: DataFrame | None = None) -> DataFrame:
    """Edges of every entity instance per relationship it can be the source of, with zeros."""
    counts = key_counts(dfs) if counts is None else counts
    table_of = {e.name: e.table for e in ENTITIES}

    def edges(r) -> Column:
        source = table_of[r.source]
        degree = F.col("edges")[REFERENCES[source].index((r.binding, r.source_key))]
        return F.when(F.col("table_name") == source, F.struct(F.lit(r.name).alias("relationship"), degree.alias("degree")))

    listed = F.explode(F.array_compact(F.array(*map(edges, RELATIONSHIPS)))).alias("d")
    there = counts.filter((F.col("copies") > 0) & ~F.col("key_columns").contains(","))
    return there.select(F.col("key").alias("source_key"), listed).select("d.relationship", "source_key", "d.degree")


def relationship_cardinality(dfs: dict[str, DataFrame], counts: DataFrame | None = None) -> DataFrame:
    """Most targets of one source, sources without a target, and sources that have
    several targets where the model declares one."""
    single = [r.name for r in RELATIONSHIPS if r.single]
    several = F.col("relationship").isin(single) & (F.col("degree") > 1)
    return (
        entity_degree(dfs, counts)
        .groupBy("relationship")
        .agg(
            F.count(F.lit(1)).alias("sources"),
            F.sum("degree").alias("edges"),
            F.max("degree").alias("max_targets"),
            F.count_if(F.col("degree") == 0).alias("without_target"),
            F.count_if(several).alias("violations"),
        )
    )


# --- reconciliation ----------------------------------------------------------


def table_rows(dfs: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    return _stack(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in dfs.items()]
    )


def _reconcile(check: str, left: list[tuple[DataFrame, Column]], right: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Left total, right total and whether they are equal, in one grouping of all sides. Each
    side keeps a column of its own, so that doubles and carried decimals do not mix."""
    frames = [df.select(amount.alias(f"{side}{i}")) for side, given in (("l", left), ("r", right)) for i, (df, amount) in enumerate(given)]
    sums = _stack(frames).agg(*[total(f.columns[0]).alias(f.columns[0]) for f in frames])

    def side(name: str, given: list) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"{name}{i}") for i in range(len(given))]).alias(name)

    return sums.select(side("l", left), side("r", right)).select(
        F.lit(check).alias("check_name"),
        number(F.col("l")).alias("left_total"),
        number(F.col("r")).alias("right_total"),
        (F.col("l") == F.col("r")).alias("holds"),
    )


def reconcile_billed(dfs: dict[str, DataFrame]) -> DataFrame:
    """Invoice total against the billed revenue of the summary."""
    return _reconcile(
        "billed",
        [(dfs["invoices"], F.col("amount"))],
        [(dfs["customer_finance_summary"], F.col("billed_revenue_6m"))],
    )


def reconcile_outstanding(dfs: dict[str, DataFrame]) -> DataFrame:
    """Unpaid invoices against the receivables of the summary."""
    unpaid = dfs["invoices"].filter(rules.outstanding(F.col("status")))
    return _reconcile(
        "outstanding", [(unpaid, F.col("amount"))], [(dfs["customer_finance_summary"], F.col("ar_outstanding"))]
    )


def reconcile_cash(dfs: dict[str, DataFrame]) -> DataFrame:
    """Billed minus collected against outstanding."""
    unpaid = F.when(rules.outstanding(F.col("status")), F.col("amount"))
    billed, collected = (dfs["invoices"], F.col("amount")), (dfs["payments"], -F.col("amount"))
    return _reconcile("cash", [billed, collected], [(dfs["invoices"], unpaid)])


def reconcile_cash_by_customer(dfs: dict[str, DataFrame]) -> DataFrame:
    """The cash check per customer, which shows where a difference sits."""
    amount = F.col("amount")
    unpaid = F.when(rules.outstanding(F.col("status")), amount)
    billed = dfs["invoices"].select("customer_id", amount.alias("billed"), unpaid.alias("open"))
    paid = dfs["payments"].select("customer_id", amount.alias("paid"))
    sums = (
        _stack([billed, paid])
        .groupBy("customer_id")
        .agg(total("billed").alias("b"), total("paid").alias("p"), total("open").alias("o"))
    )
    return sums.select(
        "customer_id",
        number(F.col("b")).alias("billed"),
        number(F.col("p")).alias("collected"),
        number(F.col("o")).alias("outstanding"),
        number(F.col("b") - F.col("p") - F.col("o")).alias("difference"),
    )


#: The columns beside the keys that the quality report reads.
LEDGER = {
    "invoices": ["amount", "status"],
    "payments": ["amount"],
    "renewal_forecasts": ["renewal_probability", "renewal_arr"],
    "customer_finance_summary": ["billed_revenue_6m", "ar_outstanding"],
}


def _ledger_rows(dfs: dict[str, DataFrame], table: str, terms: Terms) -> DataFrame:
    """One row per row of a table: which table, and the amounts the report adds up."""
    unpaid = F.when(rules.outstanding(F.col("status")), F.col("amount"))
    risky = F.when(rules.at_risk(F.col("renewal_probability"), terms), F.col("renewal_arr"))
    amounts = {
        "invoices": [F.col("amount").alias("billed"), unpaid.alias("unpaid")],
        "payments": [F.col("amount").alias("collected")],
        "renewal_forecasts": [risky.alias("at_risk")],
        "customer_finance_summary": [
            F.col("billed_revenue_6m").alias("summary_billed"),
            F.col("ar_outstanding").alias("summary_unpaid"),
        ],
    }
    return dfs[table].select(F.lit(table).alias("table_name"), *amounts.get(table, []))


def quality_report(dfs: dict[str, DataFrame], terms: Terms) -> DataFrame:
    """Long form (metric, value, text, holds): the as-of date, rows of every table, the
    four totals, then each check with the size of its failure.

    Every table is read once for its rows and amounts, which one grouping by table adds
    up; foreign keys are one further grouping.
    """
    names = ("billed", "unpaid", "collected", "at_risk", "summary_billed", "summary_unpaid")
    per_table = (
        _stack([_ledger_rows(dfs, t, terms) for t in dfs])
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("n"), *[total(F.col(n)).alias(n) for n in names])
    )
    counts = [F.coalesce(F.sum(F.when(F.col("table_name") == t, F.col("n"))), F.lit(0)).alias(f"rows:{t}") for t in dfs]
    zero = F.lit(0).cast("decimal(30,2)")
    sums = per_table.agg(*counts, *[F.coalesce(F.sum(n), zero).alias(n) for n in names])

    def metric(name: str, value: Column, holds: Column | None = None, text: str | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("metric"),
            number(value).alias("value"),
            F.lit(text).cast("string").alias("text"),
            (F.lit(None).cast("boolean") if holds is None else holds).alias("holds"),
        )

    def check(name: str, difference: Column) -> Column:
        return metric(f"check:{name}", difference, difference == 0)

    c = F.col
    lines = [
        metric("as_of_date", F.lit(None), text=terms.as_of.isoformat()),
        *[metric(f"rows:{t}", c(f"rows:{t}")) for t in dfs],
        metric("billed_revenue_6m", c("billed")),
        metric("cash_collected_6m", c("collected")),
        metric("ar_outstanding", c("unpaid")),
        metric("at_risk_arr", c("at_risk")),
        check("billed", c("billed") - c("summary_billed")),
        check("outstanding", c("unpaid") - c("summary_unpaid")),
        check("cash", c("billed") - c("collected") - c("unpaid")),
    ]
    orphans = fk_report(dfs).select(
        F.concat_ws(":", F.lit("check:orphans"), "child", "column").alias("metric"),
        number(F.col("orphans")).alias("value"),
        F.lit(None).cast("string").alias("text"),
        (F.col("orphans") == 0).alias("holds"),
    )
    return sums.select(F.explode(F.array(*lines)).alias("line")).select("line.*").unionByName(orphans)


TOTALS = ("billed_revenue_6m", "cash_collected_6m", "ar_outstanding", "at_risk_arr")


def report_document(report: DataFrame) -> DataFrame:
    """A quality report as one nested row: as_of_date, table_rows by table, the four totals,
    and the checks by name. A report has one line per table, total and check, however large the tables."""
    metric = F.col("metric")

    def entries(prefix: str, value: Column) -> Column:
        line = F.when(metric.startswith(prefix), F.struct(F.substring_index(metric, prefix, -1).alias("name"), value.alias("value")))
        return F.map_from_entries(F.array_sort(F.collect_list(line)))

    return report.agg(
        F.max(F.when(metric == "as_of_date", F.col("text"))).alias("as_of_date"),
        entries("rows:", F.col("value").cast("bigint")).alias("table_rows"),
        *[F.max(F.when(metric == t, F.col("value"))).alias(t) for t in TOTALS],
        entries("check:", F.col("holds")).alias("checks"),
    )


def failed_checks(report: DataFrame) -> dict[str, float]:
    """The checks of a report that failed, with the size of the failure: at most one row per check is read."""
    return dict(report.filter(~F.col("holds")).select("metric", "value").collect())


def assert_quality(report: DataFrame, known: Mapping[str, float] | None = None) -> DataFrame:
    """Raise ``QualityError`` if any check of a report failed; else give the report back. A failure
    that is ``known``, by its check and size, is let pass; one that grew or shrank is not."""
    failed = sorted(failed_checks(report).items() - (known or {}).items())
    if failed:
        raise QualityError("; ".join(f"{metric}: {value}" for metric, value in failed))
    return report


def schema_differences(df: DataFrame, table: str) -> list[str]:
    """Where a DataFrame's columns, order or types differ from the registry; no job."""
    want = [(f.name, f.dataType.simpleString()) for f in SCHEMAS[table]]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    differences = [f"missing {n} {t}" for n, t in want if (n, t) not in have]
    differences += [f"unexpected {n} {t}" for n, t in have if (n, t) not in want]
    if not differences and want != have:
        differences.append("column order")
    return differences


# --- business consistency ----------------------------------------------------


def category_band_mismatch(forecasts: DataFrame, terms: Terms) -> DataFrame:
    """Forecasts whose category claims another band than their probability."""
    band = rules.renewal_band(F.col("renewal_probability"), terms)
    claimed = rules.band_of_category(F.col("forecast_category"))
    return (
        forecasts.withColumn("band", band)
        .filter(F.col("band") != claimed)
        .select("forecast_id", "subscription_id", "renewal_probability", "forecast_category", "band")
    )
