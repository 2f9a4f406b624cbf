"""The semantic model: entity instances, edges, traversal and business context."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.identifiers import DEFAULT_BASE, stable_id, stable_uuid
from ledgerlens.operators.ordering import dense_numbers
from ledgerlens.schema import ENTITIES, ENTITY, RELATIONSHIPS, SCHEMAS, Relationship


class UnknownRelationship(LookupError):
    """A traversal step the model does not define."""


def entity_instances(dfs: dict[str, DataFrame]) -> DataFrame:
    """(entity, key, display_name) over all entity tables."""
    frames = [
        dfs[e.table].select(
            F.lit(e.name).alias("entity"), F.col(e.key).alias("key"), F.col(e.display).alias("display_name")
        )
        for e in ENTITIES
        if e.table in dfs
    ]
    return reduce(DataFrame.unionByName, frames)


def with_stable_ids(instances: DataFrame) -> DataFrame:
    """Instances with the 63-bit id of ``entity:key``."""
    return instances.withColumn("id", stable_id(F.concat_ws(":", "entity", "key")))


def with_stable_uuids(instances: DataFrame, base: str = DEFAULT_BASE) -> DataFrame:
    return instances.withColumn("uuid", stable_uuid(F.concat_ws(":", "entity", "key"), base))


def edges_of(dfs: dict[str, DataFrame], r: Relationship) -> DataFrame:
    """One relationship as (relationship, source_key, target_key); rows with a null end are no edge."""
    return (
        dfs[r.binding]
        .filter(F.col(r.source_key).isNotNull() & F.col(r.target_key).isNotNull())
        .select(
            F.lit(r.name).alias("relationship"),
            F.col(r.source_key).alias("source_key"),
            F.col(r.target_key).alias("target_key"),
        )
    )


def relationship_edges(dfs: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [edges_of(dfs, r) for r in RELATIONSHIPS if r.binding in dfs])


def resolve(start: str, steps: Sequence[str]) -> list[tuple[Relationship, bool]]:
    """The relationships of a path, each with whether it is walked from source to target.

    A step names a relationship of the entity reached so far, which may be at either
    end. Raises before any job for a step the model lacks.
    """
    if start not in ENTITY:
        raise UnknownRelationship(f"no entity {start}")
    here, path = start, []
    for step in steps:
        forward = [r for r in RELATIONSHIPS if r.name == step and r.source == here]
        backward = [r for r in RELATIONSHIPS if r.name == step and r.target == here]
        if forward:
            path.append((forward[0], True))
            here = forward[0].target
        elif backward:
            path.append((backward[0], False))
            here = backward[0].source
        else:
            known = sorted({r.name for r in RELATIONSHIPS if here in (r.source, r.target)})
            raise UnknownRelationship(f"{here} has no relationship {step}; it has {', '.join(known)}")
    return path


def names_along(start: str, path: Sequence[tuple[Relationship, bool]]) -> list[tuple[str, str]]:
    """(name, entity) of every place on a path. An entity that is met again is numbered:
    ``Subscription``, ``Subscription2``."""
    met: dict[str, int] = {}
    out = []
    for entity in [start, *[r.target if forward else r.source for r, forward in path]]:
        met[entity] = met.get(entity, 0) + 1
        out.append((entity if met[entity] == 1 else f"{entity}{met[entity]}", entity))
    return out


def traverse(
    dfs: dict[str, DataFrame],
    start: str,
    steps: Sequence[str],
    properties: Mapping[str, Sequence[str]],
    where: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Walk ``steps`` from every instance of ``start``.

    ``properties`` names the columns wanted at each place of the path (``names_along``); they
    come out as ``Entity_column``. ``where`` filters places by their own columns. Every
    join reads the wanted columns and the keys it needs, nothing else. A step is one join, in
    which adaptive execution splits hot sources.

    What a filter leaves is passed along the path first: each place keeps only
    instances that are linked to what its neighbour kept, a semi-join of keys, from the filters
    to both ends. So no join meets rows that a filter further on would drop.
    """
    path, where = resolve(start, steps), dict(where or {})
    places = names_along(start, path)
    if unknown := set(where) - {name for name, _ in places}:
        raise ValueError(f"the path does not meet {', '.join(sorted(unknown))}")

    # The binding table of every relationship is the target's own table, so the target row
    # carries the key of its source and no third table is joined. Links: column here, column there.
    links = []
    for r, forward in path:
        here, there = ENTITY[r.source].key, r.source_key
        links.append((here, there) if forward else (there, here))

    frames = []
    for i, (name, entity) in enumerate(places):
        needed = list(properties.get(name, ()))
        needed += [links[i][0]] if i < len(links) else []
        needed += [links[i - 1][1]] if i else []
        table = dfs[ENTITY[entity].table]
        table = table.filter(where[name]) if name in where else table
        frames.append(table.select(*[F.col(c).alias(f"{name}_{c}") for c in dict.fromkeys(needed)]))

    def column(i: int, name: str) -> str:
        return f"{places[i][0]}_{name}"

    def reduced(i: int, j: int) -> DataFrame:
        """Place ``i``, of which only what is linked to place ``j`` beside it stays."""
        left, right = links[min(i, j)]
        mine, other = (column(i, right), column(j, left)) if j < i else (column(i, left), column(j, right))
        keys = frames[j].select(F.col(other).alias("_key"))
        return frames[i].join(keys, F.col(mine) == F.col("_key"), "left_semi")

    filtered = [i for i, (name, _) in enumerate(places) if name in where]
    if filtered:
        for i in range(filtered[0] + 1, len(places)):
            frames[i] = reduced(i, i - 1)
        for i in range(len(places) - 2, -1, -1):
            frames[i] = reduced(i, i + 1) if i < filtered[-1] else frames[i]

    frame = frames[0]
    for i, (left, right) in enumerate(links):
        reached = frames[i + 1].withColumn("_via", F.col(column(i + 1, right)))
        frame = frame.withColumn("_via", F.col(column(i, left))).join(reached, "_via").drop("_via")
    return frame.select(*[column(i, c) for i, (name, _) in enumerate(places) for c in properties.get(name, ())])


# Sections of a customer's context: table, its key and a number to add up.
CONTEXT_SECTIONS = {
    "subscription": ("subscriptions", "subscription_id", "arr"),
    "invoice": ("invoices", "invoice_id", "amount"),
    "case": ("support_cases", "case_id", "support_hours"),
    "usage": ("usage_monthly", "usage_id", "compute_hours"),
    "forecast": ("renewal_forecasts", "forecast_id", "renewal_arr"),
    "profile": ("customer_finance_summary", "profile_id", "ar_outstanding"),
}


def customer_context(
    dfs: dict[str, DataFrame],
    customers: Iterable[str] | DataFrame | None = None,
) -> DataFrame:
    """Everything connected to a customer: one row per record with customer_id, section, key,
    measure and the record as JSON.

    Named customers, a list or a table with their customer_id, are filtered in every table.
    Records stay rows, however many a customer has.
    """
    chosen = customers if customers is None or isinstance(customers, DataFrame) else list(customers)
    frames = []
    for section, (table, key, measure) in CONTEXT_SECTIONS.items():
        df = dfs[table]
        if isinstance(chosen, DataFrame):
            df = df.join(chosen.select("customer_id"), "customer_id", "left_semi")
        elif chosen is not None:
            df = df.filter(F.col("customer_id").isin(chosen))
        frames.append(
            df.select(
                "customer_id",
                F.lit(section).alias("section"),
                F.col(key).alias("key"),
                F.col(measure).alias("measure"),
                F.to_json(F.struct(*SCHEMAS[table].fieldNames())).alias("record"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


#: Records of a section that a page of a document holds.
PAGE_RECORDS = 1_000


def customer_documents(
    dfs: dict[str, DataFrame], customers: Iterable[str] | DataFrame, page_records: int = PAGE_RECORDS
) -> DataFrame:
    """(customer_id, page, sections) of the named customers: by section its records as (key,
    measure, record), in the order of their keys.

    A customer is one document of one page, unless a section has more than ``page_records``; then the
    following pages have the rest, so no row or task grows with a customer. Records are
    numbered by one sort of all of them, and grouped by page.
    """
    records = customer_context(dfs, customers).filter(F.col("customer_id").isNotNull())
    numbered = dense_numbers(records, [F.col(c).asc() for c in ("customer_id", "section", "key", "record")])
    firsts = numbered.groupBy("customer_id", "section").agg(F.min("sequence").alias("first"))
    paged = numbered.join(firsts, ["customer_id", "section"]).withColumn(
        "page", F.floor((F.col("sequence") - F.col("first")) / page_records)
    )
    held = F.array_sort(F.collect_list(F.struct("sequence", "key", "measure", "record")))
    sections = paged.groupBy("customer_id", "page", "section").agg(
        F.transform(held, lambda r: F.struct(r["key"].alias("key"), r["measure"].alias("measure"), r["record"].alias("record"))).alias("records")
    )
    entries = F.array_sort(F.collect_list(F.struct("section", "records")))
    return sections.groupBy("customer_id", "page").agg(F.map_from_entries(entries).alias("sections"))


def catalog(spark: SparkSession, base: str = DEFAULT_BASE) -> DataFrame:
    """The model itself: one row per entity property with type, flags, ids and the field
    list of its entity. Built from the registry; its size does not depend on data."""
    rows = [
        (e.name, e.table, f.name, f.dataType.simpleString(), f.name == e.key, f.name == e.display, i)
        for e in ENTITIES
        for i, f in enumerate(SCHEMAS[e.table])
    ]
    properties = spark.createDataFrame(
        rows,
        "entity string, table_name string, property string, type string, is_key boolean, "
        "is_display boolean, position int",
    )
    listed = F.array_sort(F.collect_list(F.struct("position", "property")))
    fields = properties.groupBy("entity").agg(F.concat_ws(", ", listed["property"]).alias("fields"))
    named = F.concat_ws(":", F.lit("property"), "entity", "property")
    return (
        properties.join(fields, "entity")
        .withColumn("entity_id", stable_id(F.concat_ws(":", F.lit("entity"), "entity")))
        .withColumn("property_id", stable_id(named))
        .withColumn("binding_uuid", stable_uuid(F.concat_ws(":", F.lit("binding"), "entity"), base))
    )


def model_relationships(spark: SparkSession) -> DataFrame:
    """The relationships of the model with their binding and id."""
    rows = [(r.source, r.name, r.target, r.binding, r.source_key, r.target_key, r.single) for r in RELATIONSHIPS]
    listed = spark.createDataFrame(
        rows,
        "source string, name string, target string, binding string, source_key string, "
        "target_key string, single boolean",
    )
    return listed.withColumn("id", stable_id(F.concat_ws(":", F.lit("relationship"), "source", "name", "target")))
