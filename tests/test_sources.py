import json
import os

import pytest
from pyspark.sql import functions as F
from conftest import TERMS, rows

from ledgerlens.operators import quality
from ledgerlens.plans.queries import QUERIES
from ledgerlens.plans.summary import load_checked, load_with_summary, with_summary
from ledgerlens.schema import columns
from ledgerlens.session import checkpointed, clear_staged, shared_folder, staging_path
from ledgerlens.sources import files, tables


@pytest.fixture(scope="module")
def complete(company):
    return with_summary(company)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


HEADER = "payment_id,invoice_id,customer_id,payment_date,amount,payment_method\n"


def test_blank_is_null_and_types_come_from_the_registry(spark, tmp_path):
    path = write(tmp_path / "p.csv", HEADER + 'P1,I1,C1,2026-03-22,40000.0,"AC,H"\nP2,I2,C2,,,\n')
    raw = files.read_csv(spark, path, "payments")
    good = files.accepted(raw, "payments")
    assert quality.schema_differences(good, "payments") == []
    first, second = sorted(good.collect())
    assert (str(first.payment_date), first.amount, first.payment_method) == ("2026-03-22", 40000.0, "AC,H")
    assert (second.payment_date, second.amount, second.payment_method) == (None, None, None)


def test_malformed_values_are_quarantined(spark, tmp_path):
    path = write(tmp_path / "p.csv", HEADER + "P1,I1,C1,2026-13-45,x,ACH\nP2,I1,C1,2026-01-31,1.5,ACH\nP3,I1,C1,2026-01-31,1e,\n")
    raw = files.read_csv(spark, path, "payments")
    assert rows(files.accepted(raw, "payments"), "payment_id") == [("P2",)]
    rejected = {r.payment_id: r for r in files.rejected(raw, "payments").collect()}
    assert rejected["P1"].bad_columns == ["payment_date", "amount"]
    assert (rejected["P1"].payment_date, rejected["P1"].amount) == ("2026-13-45", "x"), "text kept as it came"
    assert rejected["P3"].bad_columns == ["amount"]


def test_table_without_typed_columns(spark, tmp_path):
    path = write(tmp_path / "c.csv", "customer_id,customer_name,industry,country,segment,account_owner\nC1,N,I,L,S,O\n")
    assert files.accepted(files.read_csv(spark, path, "customers"), "customers").count() == 1
    assert files.rejected(files.read_csv(spark, path, "customers"), "customers").count() == 0


def test_dates_as_timestamps_on_request(spark, tmp_path):
    path = write(tmp_path / "p.csv", HEADER + "P1,I1,C1,2026-03-22,1,ACH\n")
    found = files.accepted(files.read_csv(spark, path, "payments"), "payments", timestamps=True)
    assert dict(found.dtypes)["payment_date"] == "timestamp"


def test_header_in_another_order_is_an_error(spark, tmp_path):
    path = write(tmp_path / "p.csv", "invoice_id,payment_id,customer_id,payment_date,amount,payment_method\nI1,P1,C1,,1,\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, path, "payments").collect()


def test_round_trip_keeps_all_rows(spark, complete, tmp_path):
    for table, df in complete.items():
        path = str(tmp_path / table)
        files.export_csv(df, table, path)
        assert rows(files.accepted(files.read_csv(spark, path, table), table)) == rows(df), table


def test_load_audit_and_check(spark, complete, tmp_path):
    root = str(tmp_path)
    audit = tables.write_tables(complete, root)
    assert dict(rows(audit))["invoices"] == 4
    again = tables.write_tables(complete, root)
    assert rows(again) == rows(audit), "a second load replaces the first"
    assert {r.complete for r in tables.check_load(again, root).collect()} == {True}
    tables.write_table(complete["invoices"].limit(1).drop("status"), tables.table_path(spark, root, "invoices"))
    broken = {r.table_name: r for r in tables.check_load(audit, root).collect()}["invoices"]
    assert (broken.expected_rows, broken.found_rows, broken.schema_ok, broken.complete) == (4, 1, False, False)


def test_check_sees_changed_content(spark, complete, tmp_path):
    root = str(tmp_path)
    audit = tables.write_tables(complete, root)
    other = complete["invoices"].withColumn("amount", F.col("amount") + F.when(F.col("invoice_id") == "I1", 1).otherwise(0))
    tables.write_table(other, tables.table_path(spark, root, "invoices"))
    found = {r.table_name: r for r in tables.check_load(audit, root).collect()}
    assert (found["invoices"].found_rows, found["invoices"].schema_ok, found["invoices"].content_ok) == (4, True, False)
    assert not found["invoices"].complete and found["payments"].complete


def test_partitioned_write_and_views(spark, complete, tmp_path):
    path = str(tmp_path / "invoices")
    tables.write_table(complete["invoices"], path, partition_by="status")
    assert {d for d in os.listdir(path) if "=" in d} == {"status=Open", "status=Overdue", "status=Paid"}
    tables.register_views(complete)
    assert spark.sql("SELECT count(*) FROM invoices WHERE status = 'Paid'").first()[0] == 2


def test_load_by_month_prunes_and_keeps_the_declared_shape(spark, company, complete, tmp_path):
    root = str(tmp_path)
    audit = load_with_summary(company, root, partition_by=tables.BY_MONTH)
    assert {r.complete for r in tables.check_load(audit, root).collect()} == {True}
    stored = tables.read_tables(spark, root)
    for table, df in complete.items():
        assert rows(stored[table]) == rows(df), table
    one = stored["usage_monthly"].filter("usage_month = date '2026-07-01'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_month" in plan
    assert one.count() == 3


def test_refused_load_leaves_the_tables(spark, company, tmp_path):
    root = str(tmp_path)
    good = {**company, "support_cases": company["support_cases"].fillna("S1", ["subscription_id"])}
    assert dict(rows(load_checked(good, root, TERMS)))["payments"] == good["payments"].count()
    lost = {**good, "payments": good["payments"].filter("payment_id <> 'P-4'"), "customers": good["customers"].withColumn("segment", F.lit("new"))}
    with pytest.raises(quality.QualityError, match="check:cash"):
        load_checked(lost, root, TERMS)
    for table in ("payments", "customers"):
        assert rows(tables.read_table(spark, root, table)) == rows(good[table])


def test_known_failures_do_not_hide_another(spark):
    def report(**checks):
        lines = [("as_of_date", None, None), *[(c, v, v == 0) for c, v in checks.items()]]
        return spark.createDataFrame(lines, "metric string, value double, holds boolean")

    known = quality.failed_checks(report(cash=0.0, orphans=4.0))
    assert known == {"orphans": 4.0}
    quality.assert_quality(report(cash=0.0, orphans=4.0), known)
    for other, message in (({"cash": 10.0, "orphans": 4.0}, "^cash: 10.0$"), ({"cash": 0.0, "orphans": 3.0}, "^orphans: 3.0$")):
        with pytest.raises(quality.QualityError, match=message):
            quality.assert_quality(report(**other), known)
    with pytest.raises(quality.QualityError, match="^orphans: 4.0$"):
        quality.assert_quality(report(cash=0.0, orphans=4.0))


class Given:
    """Finance tables as they are, in place of those derived from a star schema."""

    def __init__(self, spark, dfs):
        self.spark, self.dfs = spark, dfs

    def tables(self, *names):
        return dict(self.dfs)


@pytest.mark.parametrize("repeated", [[], ["customers", "payments"]])
def test_a_lossy_load_is_refused_also_where_checks_failed_before(spark, company, repeated):
    """Cases without a subscription and repeated rows fail checks by themselves."""
    given = {t: df.union(df) if t in repeated else df for t, df in company.items()}
    found = rows(QUERIES["load_refused"](Given(spark, given)), "table_name", "row_count", "refused")
    assert found == [(t, df.count(), True) for t, df in sorted(with_summary(given).items())]


@pytest.mark.parametrize("name", ["load_interrupted", "load_refused"])
def test_tables_are_derived_for_the_first_load_only(spark, company, name):
    derived, invoices = spark.sparkContext.accumulator(0), company["invoices"]

    def seen(batches):
        for batch in batches:
            derived.add(batch.num_rows)
            yield batch

    given = {**company, "invoices": invoices.mapInArrow(seen, invoices.schema)}
    found = rows(QUERIES[name](Given(spark, given)), "table_name", "row_count")
    assert dict(found)["invoices"] == 4 and derived.value == 4


def test_a_load_that_lost_nothing_is_not_refused(spark, company):
    whole = {**company, "payments": company["payments"].filter("payment_id = 'P-4'")}
    assert {r.refused for r in QUERIES["load_refused"](Given(spark, whole)).collect()} == {False}


def test_report_as_json(complete, tmp_path):
    path = str(tmp_path / "report")
    files.export_report(quality.quality_report(complete, TERMS), path)
    lines = [json.loads(x) for f in os.listdir(path) if f.endswith(".json") for x in open(os.path.join(path, f))]
    assert {"metric": "billed_revenue_6m", "value": 360.5} in lines


def test_report_as_one_document(complete, tmp_path):
    path = str(tmp_path / "document")
    files.export_document(quality.report_document(quality.quality_report(complete, TERMS)), path)
    (text,) = [x for f in os.listdir(path) if f.startswith("part") for x in open(os.path.join(path, f))]
    found = json.loads(text)
    assert found["as_of_date"] == TERMS.as_of.isoformat() and found["billed_revenue_6m"] == 360.5
    assert found["table_rows"]["invoices"] == 4 and len(found["table_rows"]) == 10
    assert found["checks"]["cash"] is True and found["checks"]["orphans:support_cases:subscription_id"] is False


def test_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert staging_path(spark, "x").startswith(named)
    assert checkpointed(spark.range(3)).count() == 3
    assert os.listdir(named), "checkpoints go there"


def test_old_staged_results_can_be_cleared(spark):
    import datetime as dt

    path = staging_path(spark, "kept")
    spark.range(3).write.parquet(path)
    name = path.rstrip("/").split("/")[-2]
    assert name not in clear_staged(spark, dt.timedelta(hours=1)) and spark.read.parquet(path).count() == 3
    folder = os.path.dirname(path)
    os.utime(folder, (1, 1))
    assert clear_staged(spark, dt.timedelta(days=3650)) == [name] and not os.path.exists(folder)


def test_damaged_lines_are_rejected(spark, tmp_path):
    names = ",".join(columns("products"))
    lines = [names, "P1,A,F,10.0", "P2,B", "P3,C,F,1,extra", '"P4","two', 'lines",F,1', "P5,E,F,NaN", "P6,G,F,Infinity", ",H,F,2"]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    raw = files.read_csv(spark, str(tmp_path / "p.csv"), "products")
    assert rows(files.accepted(raw, "products"), "product_id", "product_name") == [("P1", "A"), ("P4", "two\nlines")]
    wrong = {r[files.BROKEN] or r["product_id"]: r[files.BAD_COLUMNS] for r in files.rejected(raw, "products").collect()}
    assert len(wrong) == 5 and wrong["P5"] == ["list_price_arr"] and wrong["P2,B"] == [files.BROKEN]


def test_export_keeps_white_space(spark, make, tmp_path):
    table = make("products", {"product_id": "  P1 ", "product_name": "line1\nline2", "product_family": 'a "b", c'})
    files.export_csv(table, "products", str(tmp_path / "out"))
    back = files.accepted(files.read_csv(spark, str(tmp_path / "out"), "products"), "products").first()
    assert (back.product_id, back.product_name, back.product_family) == ("  P1 ", "line1\nline2", 'a "b", c')
