"""Increments write only what is new and give what a full build gives; streams through the batch log; guarded filters."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyweave import queries
from tallyweave.operators import adhoc, model, resolve, vocabulary
from tallyweave.plans import build
from tallyweave.plans.storage import state_of, stored
from tallyweave.sources import ledger
from tallyweave.streaming import ingest

SF = "/root/testdata/sf0.001"
TXN = "transaction_id string, account_id string, transaction_date string, transaction_type string, description string, transaction_amount double, transaction_reference_id string, utr_number string"


@pytest.fixture(scope="module")
def tables(spark):
    t = ledger.read(spark, SF)
    return t | {"transaction": stored(t["transaction"], "txn")}


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_increments_touch_only_their_months_and_compact(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "SEGMENTS", 2)
    root, t = f"file://{tmp_path}", tables["transaction"]
    cuts = [datetime(2001, 4, 1), datetime(2001, 5, 1), datetime(2001, 6, 1), datetime(2001, 7, 1), datetime(2001, 8, 15)]
    upto = lambda d: tables | {"transaction": t.filter(F.col("transaction_date") < F.lit(d))}
    build.full(spark, upto(cuts[0]), root, cluster=False)
    for i, cut in enumerate(cuts[1:]):
        m = build.increment(spark, upto(cut), root, cluster=False)
        written = {f for f in os.listdir(f"{tmp_path}/{m['version']}/rollup") if f.startswith("part=")}
        assert m["added"] > 0 and len(m["fact_segments"]) <= 4
        assert written <= {f"part=m{d:%Y-%m}" for d in cuts[i : i + 2]} and written
        assert set(m["rollup_parts"].values()) >= {m["version"]}
    got, want = build.read(spark, root), model.fact(build.extracted(t, tables["bank"]), build.read(spark, root)["alias"], tables["account"])
    assert m["row_count"] == t.count() == got["fact"].count() and same(got["fact"].select(want.columns), want)
    rollup = model.rollup(want)
    assert same(got["rollup"].select(rollup.columns), rollup)
    dim = model.dim_of_rollup(rollup, got["alias"])
    assert same(got["dim"].select(dim.columns), dim)
    assert build.increment(spark, upto(cuts[-1]), root, cluster=False)["added"] == 0


def spelled(spark, rows):
    made = spark.createDataFrame([(str(i), "1", day, "debit", f"UPI-{name}-XXXXXX{i:04}-HDFC0002125", 10.0, None, None) for i, (day, name) in enumerate(rows)], TXN)
    return made.withColumn("transaction_date", F.col("transaction_date").cast("timestamp_ntz")).withColumn("transaction_amount", F.col("transaction_amount").cast("decimal(15,2)"))


def test_new_spellings_join_stored_names(spark, tables, tmp_path):
    early = [("2001-01-05", n) for n in ["NAVYUG SELECTION"] * 5 + ["BIG BASKET STORE"] * 4 + ["SPOTIFY"] * 3 + ["SWIGGY"] * 6]
    late = [("2001-02-05", n) for n in ["NAVYUGG SELECTION", "SELECTION NAVYUG", "BIGG BASKET STORE", "SPOTIFFY", "SWIGGY", "QUITE NEW NAME", "QUITE NEWW NAME", "QUITE NEW NAME"]]
    account = spark.createDataFrame([("1", "7", "123456", 21, None, "HDFC")], "account_id string, entity_id string, account_number string, program_id int, available_balance decimal(15,2), bank_code string")
    bank = spark.createDataFrame([("HDFC", "HDFC BANK")], "bank_code string, bank_name string")
    t = lambda rows: {"transaction": stored(spelled(spark, rows), "spelled"), "account": account, "bank": bank}
    build.full(spark, t(early), f"file://{tmp_path}/a")
    assert build.increment(spark, t(early + late), f"file://{tmp_path}/a")["added"] == len(late)
    build.full(spark, t(early + late), f"file://{tmp_path}/b")
    one, two = (build.read(spark, f"file://{tmp_path}/{x}") for x in "ab")
    names = lambda w: {r.merchant_raw: r.merchant_norm for r in w["alias"].collect()}
    assert names(one) == names(two) and names(one)["NAVYUGG SELECTION"] == "NAVYUG SELECTION" and names(one)["QUITE NEWW NAME"] == "QUITE NEW NAME"
    kinds = {(r.merchant_norm, r.counterparty_kind) for r in one["alias"].collect()}
    assert len(kinds) == len({n for n, _ in kinds})


def test_names_aren_t_compared_with_each_other_again(spark):
    frame = lambda rows: spark.createDataFrame(rows, "name string, freq long")
    anchors = frame([("FOO BARR", 2), ("FOO BAR", 1), ("ZZZZ", 9)])  # both are there, so both stay
    got = {r.name: r.canonical for r in vocabulary.clusters(frame([("FOO BARS", 50), ("FOO BARSS", 1), ("AB", 3), ("ZZZZ", 1)]), anchors=anchors).collect()}
    assert got["FOO BARR"] == "FOO BARR" and got["FOO BAR"] == "FOO BAR" and got["FOO BARS"] in ("FOO BAR", "FOO BARR") and got["AB"] == "AB" and got["ZZZZ"] == "ZZZZ"


def test_warehouse_follows_its_files(spark, tmp_path):
    for name in queries.LEDGER_TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    before = queries.warehouse(spark, f"file://{tmp_path}")["fact"].count()
    assert queries.warehouse_root(spark, f"file://{tmp_path}") == queries.warehouse_root(spark, f"file://{tmp_path}")
    state = state_of(spark, [f"file://{tmp_path}/orders.parquet"])
    spark.read.parquet(f"{SF}/orders.parquet").limit(100).write.mode("overwrite").parquet(f"file://{tmp_path}/orders.parquet")
    assert state_of(spark, [f"file://{tmp_path}/orders.parquet"]) != state
    assert queries.warehouse(spark, f"file://{tmp_path}")["fact"].count() == 100 < before


def test_batches_count_once(spark, tmp_path):
    at, rows = f"file://{tmp_path}", lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    schema = rows(1).schema
    assert ingest.committed(spark, at, schema).count() == 0
    ingest.append_batch(rows(1, 2), 0, at, "q")
    rows(3, 4).write.parquet(f"{at}/data/q/1")  # written, but the log never got it
    assert sorted(r.id for r in ingest.committed(spark, at, schema).collect()) == [1, 2]
    for i, ids in ((0, (1, 2)), (1, (3, 4)), (1, (3, 4))):
        ingest.append_batch(rows(*ids), i, at, "q")
    ingest.append_batch(rows(5), 0, at, "other")
    assert sorted(r.id for r in ingest.committed(spark, at, schema).collect()) == [1, 2, 3, 4, 5]


def test_stream_reads_aliases_anew(spark, tables, tmp_path):
    at, t = f"file://{tmp_path}", tables["transaction"]
    half = t.filter(F.col("transaction_date") < F.lit(datetime(1998, 1, 1)))
    build.full(spark, tables | {"transaction": half}, f"{at}/w", cluster=False)
    half.write.parquet(f"{at}/in")
    drain = lambda: ingest.run_fact(ingest.source(spark, f"{at}/in"), f"{at}/w", at, f"{at}/cp").awaitTermination()
    drain()
    schema = build.read(spark, f"{at}/w")["fact"].schema
    unseen = lambda: ingest.committed(spark, f"{at}/unseen", "merchant_raw string, freq long").count()
    assert ingest.committed(spark, f"{at}/fact", schema).count() == half.count() and unseen() == 0
    build.increment(spark, tables, f"{at}/w", cluster=False)
    t.join(half, "transaction_id", "left_anti").select(t.columns).write.mode("append").parquet(f"{at}/in")
    drain()
    drain()
    assert same(ingest.committed(spark, f"{at}/fact", schema), build.read(spark, f"{at}/w")["fact"]) and unseen() == 0


def test_filters_are_resolved_before_they_run(spark, tmp_path):
    vocab = spark.createDataFrame([("3", "SWIGGY", "merchant", 9, 0.0), ("3", "O'NEIL FOODS", "merchant", 1, 0.0), ("3", "NAVYUG SELECTION", "merchant", 1, 0.0), ("3", "SELECTION HUB", "merchant", 1, 0.0), ("4", "ORACLE", "merchant", 1, 0.0)], "entity_id string, merchant_norm string, counterparty_kind string, txn_count int, total_credit double")
    spark.createDataFrame([("SWIGGY", "debit", 5), ("O'NEIL FOODS", "credit", 7)], "merchant_norm string, transaction_type string, n int").write.parquet(f"file://{tmp_path}/t")
    run = lambda text, *params: [tuple(r) for r in adhoc.run(spark, {"my_transactions": f"file://{tmp_path}/t"}, text, list(params), vocab, "3")[0].collect()]
    assert run("SELECT n FROM my_transactions WHERE merchant_norm = ? AND transaction_type = 'debit'", "Bundl Technologies") == [(5,)]
    assert run("SELECT n, '?' AS q /* ? */ FROM my_transactions WHERE merchant_norm = 'o''neil foods' AND n > ? -- ?", 3) == [(7, "?")]
    for value, status in (("Oracle", "NOT_FOUND"), ("selection", "AMBIGUOUS")):
        with pytest.raises(adhoc.Unresolved) as e:
            run("SELECT n FROM my_transactions WHERE merchant_norm = ?", value)
        assert (e.value.status, e.value.value) == (status, value)
    with pytest.raises(ValueError):
        run("SELECT n FROM my_transactions WHERE merchant_norm = ?")
    assert resolve.NOT_NAMES
