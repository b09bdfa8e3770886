"""Sources that really run: a database over JDBC, CSV files with broken lines, lookups that skip row groups."""

from __future__ import annotations

import hashlib
import hmac
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import balances, model, payouts
from tallyweave.plans import build
from tallyweave.plans.storage import shared_dir
from tallyweave.sources import landing, ledger

SF = "/root/testdata/sf0.001"
TABLES = {"bank": "BANKS", "account": "ACCOUNTS", "transaction": "MOVEMENTS"}
#: Names that columns have in the database.
PHYSICAL = {"transaction": {"transaction_id": "id", "transaction_amount": "amt"}}


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """The ledger's tables in a Derby database, which comes with Spark; transactions under other column names, numbered."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db"
    tables = ledger.read(spark, SF)
    tables["transaction"] = tables["transaction"].withColumn("nr", F.col("transaction_id").cast("long")).withColumnsRenamed(PHYSICAL["transaction"])
    for name, df in tables.items():
        # Spark writes nulls as CLOB, which Derby refuses in other columns
        text = ", ".join(f"{c} VARCHAR(200)" for c, t in df.dtypes if t == "string" and c not in ("transaction_reference_id", "utr_number"))
        df.write.format("jdbc").options(url=f"{url};create=true", dbtable=TABLES[name], createTableColumnTypes=text).save()
    return url.removeprefix("jdbc:")


def test_jdbc_reads_what_was_written(spark, database):
    read, want = landing.read_jdbc(spark, database, TABLES, physical=PHYSICAL), ledger.read(spark, SF)
    for name in TABLES:
        got = read[name].select(want[name].columns)
        assert got.exceptAll(want[name]).isEmpty() and want[name].exceptAll(got).isEmpty(), name
        assert dict(got.dtypes) == dict(want[name].dtypes)
    assert landing.validated(spark, read).isEmpty()


def test_jdbc_pushes_conditions_and_columns(spark, database):
    since = date(2001, 6, 1)
    rows = landing.read_jdbc(spark, database, TABLES, since=since, physical=PHYSICAL)["transaction"].select("transaction_id", "transaction_amount")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(transaction_date" in plan or ">= {ts" in plan or "*GreaterThanOrEqual" in plan, plan
    assert "description" not in plan
    want = ledger.read(spark, SF)["transaction"].filter(F.col("transaction_date") >= F.lit(datetime(2001, 6, 1)).cast("timestamp_ntz"))
    assert 0 < rows.count() == want.count()


def test_jdbc_in_parts(spark, database):
    parts = landing.read_jdbc(spark, f"{database}?partitionColumn=nr&lowerBound=0&upperBound=1500&numPartitions=3", TABLES, physical=PHYSICAL)
    sizes = parts["transaction"].groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and sum(r["count"] for r in sizes) == ledger.read(spark, SF)["transaction"].count()
    assert parts["account"].count() == ledger.read(spark, SF)["account"].count()


def test_land_counts_while_it_writes(spark, database, tmp_path):
    counts = landing.land(landing.read_jdbc(spark, database, TABLES, physical=PHYSICAL), f"file://{tmp_path}", limit=700)
    assert counts["transaction"] == 700 == spark.read.parquet(f"file://{tmp_path}/transaction.parquet").count()
    tables = ledger.read(spark, SF)
    assert landing.land(tables | {"bank": tables["bank"].limit(0)}, f"file://{tmp_path}/none")["bank"] == 0


def _files(folder, **changed):
    texts = {
        "vendor_list": 'vendor_id,vendor_name,category\nV1,"Acme, Ltd",Food\nV2,"The ""Old"" Mill",Rent\n',
        "chart_of_accounts": "account_id,account_name,account_type\nA1,Rent,Expense\n",
        "vendor_payouts": "payout_id,payout_date,vendor_id,amount,currency,status,description\nP1,2024-05-01,V1,10.50,INR,Completed,x\nP2,2024-05-02,V2,4.00,INR,Failed,\n",
        "transactions": "transaction_id,transaction_date,vendor_id,account_id,amount,transaction_type,payout_id,description\n"
        "T1,2024-05-01,V1,A1,10.50,Debit,P1,x\nT2,2024-05-03,V2,A1,7.25,Debit,,y\nT3,2024-05-04,V9,A1,1.00,Debit,,no vendor\n",
        "reconciliation_status": "transaction_id,reconciliation_status,reconciled_date,notes\nT1,Reconciled,2024-05-09,\nT2,Disputed,,why\nT3,Disputed,,\n",
    } | changed
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return f"file://{folder}"


def test_payout_files(spark, tmp_path):
    t = landing.read_payout_files(spark, _files(tmp_path))
    assert [tuple(r) for r in t["vendor_list"].orderBy("vendor_id").collect()] == [("V1", "Acme, Ltd", "Food", None), ("V2", 'The "Old" Mill', "Rent", None)]
    assert {tuple(r) for r in payouts.file_totals(t).collect()} == {("Completed", 1, Decimal("10.50")), ("Failed", 1, Decimal("4.00")), ("no payout", 2, Decimal("8.25"))}
    rows = payouts.audit_files(t, ["DISPUTED", "reconciled"]).collect()
    assert [(r.transaction_id, r.vendor_name, r.matches, r.match_total) for r in rows] == [("T2", 'The "Old" Mill', 2, Decimal("17.75")), ("T1", "Acme, Ltd", 2, Decimal("17.75"))]
    assert payouts.audit_files(t, ["pending"]).isEmpty()


def test_broken_lines_are_kept_and_told(spark, tmp_path):
    head = "payout_id,payout_date,vendor_id,amount,currency,status,description\n"
    good, bad, short = "P1,2024-05-01,V1,10.50,INR,Completed,x", "P2,someday,V1,1.00,INR,Completed,x", "P3,2024-05-01"
    rows = landing.read_payout_files(spark, _files(tmp_path, vendor_payouts=f"{head}{good}\n{bad}\n{short}\n"))["vendor_payouts"].orderBy("payout_id").collect()
    assert [r.corrupt for r in rows] == [None, bad, short]
    assert [r.payout_date for r in rows] == [date(2024, 5, 1), None, date(2024, 5, 1)] and rows[1].amount == Decimal("1.00")


def test_other_headers_are_refused(spark, tmp_path):
    t = landing.read_payout_files(spark, _files(tmp_path, chart_of_accounts="account_name,account_id,account_type\nRent,A1,Expense\n"))
    with pytest.raises(Exception, match="(?i)header"):
        t["chart_of_accounts"].collect()


def test_files_without_rows(spark, tmp_path):
    t = landing.read_payout_files(spark, _files(tmp_path, vendor_payouts="payout_id,payout_date,vendor_id,amount,currency,status,description\n"))
    assert t["vendor_payouts"].isEmpty()
    assert {tuple(r) for r in payouts.file_totals(t).collect()} == {("no payout", 2, Decimal("8.25"))}


def _blind(value, pepper="pepper"):
    return hmac.new(pepper.encode(), value.encode(), hashlib.sha256).hexdigest()


def _rows_scanned(df):
    """Rows that the file scans of a collected query handed on."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_lookups_skip_row_groups(spark, tmp_path):
    """Each file has its own references, in no order of their hashes: only the filters can tell which file has one."""
    rows = spark.range(0, 40_000, 1, 8).select(
        F.lit("1").alias("entity_id"), F.col("id").cast("string").alias("transaction_id"), F.sha2(F.col("id").cast("string"), 256).alias("transaction_reference_id"),
        F.concat(F.lit("UTR"), F.col("id")).alias("utr_number"), F.lit(1).cast("decimal(15,2)").alias("transaction_amount"), F.lit(date(2001, 1, 1)).alias("transaction_date"),
    )
    rows = rows.withColumn(model.BLIND, model.blind_index(F.col("utr_number"), "pepper"))
    build._write_fact(rows, f"file://{tmp_path}/fact")
    fact = spark.read.parquet(f"file://{tmp_path}/fact")
    one = balances.by_utr(fact, spark.createDataFrame([("utr77",), ("none",), (None,)], "utr string"), "pepper")
    assert [r.utr_blind_idx for r in one.collect()] == [_blind("UTR77")]
    assert _rows_scanned(one) <= 10_000
    digest = hashlib.sha256(b"39999").hexdigest()
    needles = spark.createDataFrame([(digest,)], "reference string")
    found = balances.by_reference(fact, needles)
    assert [(r.transaction_id, r.matches) for r in found.collect()] == [("39999", 1)]
    many = spark.range(balances.LITERAL_NEEDLES + 6).select(F.concat(F.lit("utr"), F.col("id")).alias("utr"))
    assert balances.by_utr(fact, many, "pepper").count() == balances.LITERAL_NEEDLES + 6
    assert balances.by_utr(fact, many.limit(0), "pepper").count() == 0


def test_lookup_reads_the_stored_index(spark):
    root = f"{shared_dir(spark)}/blind"
    tables = ledger.read(spark, SF)
    m = build.full(spark, tables, root, cluster=False, pepper="pepper")
    fact = build.read(spark, root)["fact"]
    assert {r[0]: r[1] for r in fact.select("utr_number", model.BLIND).distinct().collect() if r[0]} == {
        r[0]: _blind(r[0]) for r in tables["transaction"].select("utr_number").distinct().collect() if r[0]
    }
    assert fact.filter(f"utr_number is null and {model.BLIND} is not null").isEmpty()
    needles = spark.createDataFrame([("utr100001",), ("utr100004",)], "utr string")
    found = balances.by_utr(fact, needles, "pepper")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sha2(cast" not in plan.split("Scan parquet")[0].split("Join")[0] and f"EqualTo({model.BLIND}" in plan
    plain = balances.by_utr(fact.drop(model.BLIND), needles, "pepper")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) != []
    assert build.increment(spark, tables, root, cluster=False, pepper="pepper")["version"] == m["version"]
    again = build.increment(spark, tables, root, cluster=False, pepper="other")
    assert again["added"] is None and build.read(spark, root)["fact"].filter(F.col(model.BLIND) == _blind("UTR100001", "other")).count() == 1
    with pytest.raises(ValueError, match="pepper"):
        balances.by_utr(fact, needles, None)
