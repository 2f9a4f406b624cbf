import hashlib
import json
import uuid
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.functions.identifiers import DEFAULT_BASE, stable_id, stable_uuid
from ledgerlens.operators import semantic
from ledgerlens.plans.summary import with_summary
from ledgerlens.schema import ENTITIES, RELATIONSHIPS, SCHEMAS


@pytest.fixture(scope="module")
def complete(company):
    return with_summary(company)


def test_ids_equal_the_published_algorithms(spark):
    names = ["entity:Customer", "", "ünïcode", *(f"property:Customer:{i}" for i in range(200))]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", stable_id(F.col("n")), stable_uuid(F.col("n")))
    for name, number, text in found.collect():
        digest = hashlib.sha256(name.encode()).digest()
        assert number == (int.from_bytes(digest[:8], "big") & (2**63 - 1) or 1)
        assert text == str(uuid.uuid5(uuid.NAMESPACE_URL, DEFAULT_BASE + name))


def test_model_is_complete(spark):
    assert (len(ENTITIES), len(RELATIONSHIPS)) == (10, 9)
    catalog = semantic.catalog(spark).collect()
    assert len(catalog) == sum(len(s) for s in SCHEMAS.values()) == 87
    assert len({r.binding_uuid for r in catalog}) == 10
    assert len({r.property_id for r in catalog}) == 87
    assert sum(r.is_key for r in catalog) == 10
    customer = next(r for r in catalog if r.entity == "Customer")
    assert customer.fields == "customer_id, customer_name, industry, country, segment, account_owner"
    for r in RELATIONSHIPS:
        bound = SCHEMAS[r.binding].fieldNames()
        assert r.source_key in bound and r.target_key in bound
    assert semantic.model_relationships(spark).select("id").distinct().count() == 9


def test_every_binding_is_the_targets_table():
    tables = {e.name: e for e in ENTITIES}
    for r in RELATIONSHIPS:
        assert (r.binding, r.target_key) == (tables[r.target].table, tables[r.target].key)


def test_instances_and_edges(complete):
    instances = semantic.entity_instances(complete)
    assert instances.count() == sum(df.count() for df in complete.values())
    edges = semantic.relationship_edges(complete)
    assert rows(edges.filter("relationship = 'isSettledBy'"), "source_key", "target_key") == [("I1", "P-1"), ("I4", "P-4")]
    assert edges.filter("source_key IS NULL OR target_key IS NULL").count() == 0


def test_traversal_forward_and_back(complete):
    found = semantic.traverse(
        complete,
        "Customer",
        ["owns", "isLicensedBy"],
        {"Customer": ["customer_name"], "Subscription": ["subscription_id"], "Product": ["product_name"]},
    )
    assert found.columns == ["Customer_customer_name", "Subscription_subscription_id", "Product_product_name"]
    assert found.count() == 6
    from_product = semantic.traverse(complete, "Product", ["isLicensedBy"], {"Subscription": ["subscription_id"]})
    assert from_product.count() == 6


def test_unknown_steps_are_refused_before_any_job(complete):
    with pytest.raises(semantic.UnknownRelationship, match="no relationship pays"):
        semantic.traverse(complete, "Customer", ["pays"], {})
    with pytest.raises(semantic.UnknownRelationship):
        semantic.traverse(complete, "Customer", ["owns", "receives"], {})
    with pytest.raises(semantic.UnknownRelationship):
        semantic.traverse(complete, "Nobody", [], {})
    with pytest.raises(ValueError, match="does not meet Product"):
        semantic.traverse(complete, "Customer", ["owns"], {}, where={"Product": F.lit(True)})


def test_an_entity_met_again_has_a_name_of_its_own(complete):
    path = semantic.resolve("Product", ["isLicensedBy", "owns", "owns", "isLicensedBy"])
    assert [n for n, _ in semantic.names_along("Product", path)] == ["Product", "Subscription", "Customer", "Subscription2", "Product2"]
    found = semantic.traverse(
        complete,
        "Product",
        ["isLicensedBy", "owns", "owns"],
        {"Product": ["product_name"], "Subscription": ["subscription_id"], "Customer": ["customer_id"], "Subscription2": ["subscription_id", "arr"]},
    )
    subscriptions = complete["subscriptions"].collect()
    want = [("Product", a.subscription_id, a.customer_id, b.subscription_id, b.arr) for a in subscriptions for b in subscriptions if a.customer_id == b.customer_id]
    assert rows(found) == sorted(want, key=repr) and len(want) == 12


@pytest.mark.parametrize(
    "where,plainly",
    [
        ({"Customer": "segment = 'Big'"}, "Customer_segment = 'Big'"),
        ({"Subscription2": "status = 'Lapsed'"}, "Subscription2_status = 'Lapsed'"),
        ({"Subscription": "arr > 150", "Subscription2": "arr < 1500"}, "Subscription_arr > 150 AND Subscription2_arr < 1500"),
        ({"Product": "product_id = 'none'"}, "Product_product_id = 'none'"),
    ],
)
def test_filters_leave_what_a_plain_filter_leaves(complete, where, plainly):
    properties = {"Product": ["product_id"], "Customer": ["segment"], "Subscription": ["subscription_id", "arr"], "Subscription2": ["subscription_id", "status", "arr"]}
    steps = ["isLicensedBy", "owns", "owns"]
    plain = semantic.traverse(complete, "Product", steps, properties).filter(plainly)
    assert rows(semantic.traverse(complete, "Product", steps, properties, where)) == rows(plain)


def joined_rows(df):
    """Rows that leave each inner join of an executed plan."""
    df.collect()
    counts, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Join" in name and "Inner" in node.joinType().toString():
            counts.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return counts


def test_a_filtered_end_reaches_the_first_join(complete):
    steps, properties = ["receives", "isSettledBy"], {"Customer": ["customer_name"], "Payment": ["payment_id"]}
    every = semantic.traverse(complete, "Customer", steps, properties)
    one = semantic.traverse(complete, "Customer", steps, properties, where={"Payment": F.col("payment_id") == "P-4"})
    assert max(joined_rows(every)) == 4 and joined_rows(one) == [1, 1]


def test_documents_in_pages(complete):
    whole = semantic.customer_documents(complete, ["C1", "C2"]).collect()
    assert {(r.customer_id, r.page) for r in whole} == {("C1", 0), ("C2", 0)}
    document = next(r.sections for r in whole if r.customer_id == "C2")
    assert sorted(document) == ["case", "forecast", "invoice", "profile", "subscription", "usage"]
    assert [r.key for r in document["case"]] == ["K1", "K2", "K3"]
    assert json.loads(document["invoice"][0].record)["status"] == "Overdue" and document["invoice"][0].measure == 200.0
    named = complete["customers"].filter("segment = 'Big'").select("customer_id", "segment")
    paged = semantic.customer_documents(complete, named, page_records=2).collect()
    assert {(r.customer_id, r.page) for r in paged} == {("C1", 0), ("C2", 0), ("C2", 1)}
    second = next(r.sections for r in paged if r.page == 1)
    assert {n: [r.key for r in records] for n, records in second.items()} == {"case": ["K3"], "usage": ["S2-2026-08-01"]}
    assert semantic.customer_documents(complete, []).count() == 0


def test_context_of_one_customer(complete):
    found = semantic.customer_context(complete, ["C2"]).collect()
    sizes = Counter(r.section for r in found)
    assert sizes == {"subscription": 1, "invoice": 1, "case": 3, "usage": 3, "forecast": 1, "profile": 1}
    assert json.loads(next(r.record for r in found if r.section == "invoice"))["status"] == "Overdue"
