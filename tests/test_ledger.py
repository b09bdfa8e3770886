"""Clusters, resolution, builds, increments, streams, ad-hoc SQL and the contracts of the queries."""

from __future__ import annotations

import random
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyweave.functions import narration, similarity
from tallyweave.operators import adhoc, quality, resolve, spend, vocabulary
from tallyweave.plans import build
from tallyweave.plans.storage import stored
from tallyweave.sources import landing, ledger
from tallyweave.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return ledger.read(spark, SF)


@pytest.fixture(scope="module")
def built(spark, tables, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('warehouse')}"
    build.full(spark, tables, root)
    return build.read(spark, root) | {"root": root}


def greedy(counted):
    """One pass by falling frequency."""
    anchors, out = [], {}
    for name, _ in sorted(counted, key=lambda x: (-x[1], x[0])):
        scored = [(-similarity.token_set_ratio(a, name), i, a) for i, a in enumerate(anchors)] if len(name) >= 4 else []
        best = min(scored, default=None)
        if best and -best[0] >= 92:
            out[name] = best[2]
        else:
            anchors.append(name)
            out[name] = name
    return out


def test_clusters_equal_one_pass(spark):
    rng = random.Random(1)
    stems = ["SWIGGY", "SWIGY", "AMAZON", "AMAZON RETAIL", "ZOMATO MEDIA", "ZOMATTO MEDIA", "FOO BAR", "BAR FOO", "FOO", "UBER", "BIG BASKET", "BIGG BASKET STORE"]
    counted = [(s, rng.randint(1, 9)) for s in stems] + [(f"NAME {c}", 1) for c in "ABCD"]
    got = {r.name: r.canonical for r in vocabulary.clusters(spark.createDataFrame(counted, "name string, freq long")).collect()}
    assert got == greedy(counted)


def test_resolution(spark):
    dim = [("SWIGGY", 9), ("ZOMATO", 8), ("SPOTIFY", 3), ("AMAZON", 5), ("SELECTION ELECTRONICS", 2), ("NAVYUG SELECTION", 4), ("TATA CONSULTANCY SERVICES", 2)]
    vocab = spark.createDataFrame([("1", n, "merchant", c, 0.0) for n, c in dim], "entity_id string, merchant_norm string, counterparty_kind string, txn_count int, total_credit double")
    asked = {
        "swiggy": "SWIGGY", "Swiggy Ltd": "SWIGGY", "swiggy private limited": "SWIGGY", "BUNDL TECHNOLOGIES": "SWIGGY", "swigy": "SWIGGY", "Zomato Pvt Ltd": "ZOMATO", "ETERNAL": "ZOMATO",
        "Spotify Inc": "SPOTIFY", "Amazon Seller Services": "AMAZON", "TCS": "TATA CONSULTANCY SERVICES",
    }
    rest = {"Oracle": "NOT_FOUND", "Snowflake": "NOT_FOUND", "Wells Fargo": "NOT_FOUND", "selection": "AMBIGUOUS", "": "NONE", None: "NONE"}
    names = [*asked, *rest]
    mentions = spark.createDataFrame([(i, "1", n) for i, n in enumerate(names)], "mention_id int, entity_id string, name string")
    got = {names[r.mention_id]: r for r in resolve.resolved(mentions, vocab).collect()}
    assert {n: got[n].entity for n in asked} == asked
    assert {n: got[n].status for n in rest} == rest
    assert got["selection"].candidates == ["NAVYUG SELECTION", "SELECTION ELECTRONICS"]
    again = spark.createDataFrame([(n, e, "swigy") for n, e in enumerate(["1", "1", "2", None])], "mention_id int, entity_id string, name string")
    assert {r.mention_id: (r.status, r.entity) for r in resolve.resolved(again, vocab).collect()} == {0: ("MATCH", "SWIGGY"), 1: ("MATCH", "SWIGGY"), 2: ("NOT_FOUND", None), 3: ("NOT_FOUND", None)}


def test_names_are_normalised_once_per_string(spark, tables):
    """No join's filter brings the normalisation down to the transactions."""
    rows = narration.extracted(tables["transaction"], tables["bank"])
    out = vocabulary.aliases(vocabulary.vocabulary(rows), cluster=False)
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.merchant_raw for r in out.collect()} == {r.merchant_raw for r in rows.collect() if r.merchant_raw is not None}


def test_build_reconciles(spark, tables, built):
    found = {r["check"]: r.found for r in quality.report(tables["transaction"], built["fact"], built["rollup"], built["dim"], tables["bank"]).collect()}
    assert all(v == 0 for v in found.values()), found


def test_increment_is_idempotent_and_takes_late_rows(spark, tables, tmp_path):
    root = f"file://{tmp_path}"
    t = tables["transaction"]
    early = t.filter(F.col("transaction_date") < F.lit(datetime(2001, 7, 1)))
    late = early.filter((F.col("transaction_date") >= F.lit(datetime(2001, 6, 27))) & (F.col("transaction_id").cast("int") % 2 == 0))
    build.full(spark, tables | {"transaction": stored(early.join(late, "transaction_id", "left_anti"), "early")}, root, cluster=False)
    n = t.count()
    first = build.increment(spark, tables, root, cluster=False)
    assert first["row_count"] == n and first["added"] > 0
    twice = tables | {"transaction": t.unionByName(t)}
    assert build.increment(spark, twice, root, cluster=False)["added"] == 0
    aliases = build.read(spark, root)["alias"]
    assert aliases.count() == aliases.select("merchant_raw").distinct().count()


def test_stream_equals_batch(spark, tables, tmp_path):
    t = tables["transaction"]
    stored_ = f"file://{tmp_path}/in"
    t.write.parquet(stored_)
    t.limit(50).write.mode("append").parquet(stored_)
    for _ in range(2):
        ingest.run(ingest.deduplicated(ingest.source(spark, stored_)).drop("event_time"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == t.count()


def test_stream_totals_follow_late_rows(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "ts timestamp, kind string, value decimal(12,2)"
    first = spark.sql("SELECT * FROM VALUES (timestamp'2001-01-31 10:00:00', 'a', 1.25), (timestamp'2001-02-01 00:00:00', 'a', 2.00), (timestamp'2001-01-31 11:00:00', 'b', 4.00) AS t(ts, kind, value)")
    late = spark.sql("SELECT * FROM VALUES (timestamp'2001-01-31 23:59:59', 'a', 8.50), (timestamp'2001-02-02 00:00:00', 'b', 1.00) AS t(ts, kind, value)")
    for rows in (first, late):
        rows.selectExpr("ts", "kind", "cast(value AS decimal(12,2)) AS value").write.mode("append").parquet(f"{at}/in")
        stream = ingest.daily(spark.readStream.schema(schema).parquet(f"{at}/in"), "ts", "value", ["kind"])
        ingest.run_totals(stream, f"{at}/out", f"{at}/cp").awaitTermination()
    got = {(str(r.txn_month), r.kind): (r.txns, float(r.total)) for r in ingest.monthly(spark.read.parquet(f"{at}/out"), ["kind"]).collect()}
    assert got == {("2001-01-01", "a"): (2, 9.75), ("2001-02-01", "a"): (1, 2.0), ("2001-01-01", "b"): (1, 4.0), ("2001-02-01", "b"): (1, 1.0)}


def test_append_compares_recent_rows(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    rows = lambda *r: spark.createDataFrame(list(r), "id string, at string").selectExpr("id", "cast(at AS timestamp_ntz) AS at")
    batches = [rows(("a", "2001-01-01 00:00:00"), ("n", None)), rows(("b", "2001-03-01 00:00:00"), ("c", "2001-03-05 00:00:00")), rows(("n", None))]
    for batch in [*batches, *batches, rows(("b", "2001-03-02 00:00:00"), ("d", "2001-03-04 00:00:00"))]:
        ingest.append_new(batch, at, "id", "at")
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == ["a", "b", "c", "d", "n"]


def test_adhoc(spark, tables, built):
    views = adhoc.views(built["fact"], tables["account"], tables["bank"], "3")
    paths = {n: stored(df, n).inputFiles()[0].rsplit("/", 1)[0] for n, df in views.items()}
    rows, summary = adhoc.run(spark, paths, "SELECT * FROM my_transactions ORDER BY transaction_amount DESC -- all")
    assert rows.count() == min(200, views["my_transactions"].count()) and summary.first().capped == (views["my_transactions"].count() > 200)
    assert adhoc.headline(rows).first().column == "transaction_amount"
    built["fact"].createOrReplaceTempView("secret")
    for bad in ("SELECT * FROM secret", "DELETE FROM my_accounts", "SELECT 1; SELECT 2", "SELECT utr_number FROM my_transactions", "SELECT * FROM parquet.`/tmp`"):
        with pytest.raises(Exception):  # noqa: B017
            adhoc.run(spark, paths, bad)[0].collect()
    with pytest.raises(ValueError):
        adhoc.run(spark, paths, "SELECT * FROM my_accounts WHERE bank_name = ?")
    assert adhoc.run(spark, paths, "SELECT reflect('java.lang.System', 'currentTimeMillis') AS r")[0].first().r is None


def test_direction_is_mandatory(built):
    with pytest.raises(ValueError):
        spend.spend_facts(built["rollup"], "both")


def test_routes_agree_on_all_aligned_windows(spark, built):
    for start, end in [(date(2000, 1, 1), date(2000, 1, 31)), (date(1999, 4, 1), date(1999, 6, 30)), (date(1998, 1, 1), date(1998, 12, 31)), (None, None)]:
        one = spend.spend_facts(spend.routed(built["fact"], built["rollup"], start, end, True), "debit")
        two = spend.spend_facts(spend.routed(built["fact"], built["rollup"], start, end, False), "debit")
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
        scoped = spend.spend_facts(spend.routed(built["fact"], built["rollup"], start, end, True), "debit", entity="3")
        assert scoped.exceptAll(one.filter("entity_id = '3'")).isEmpty()


def test_landing(spark, tables, tmp_path):
    folder = f"file://{tmp_path}"
    counts = landing.land(tables, folder)
    assert counts["transaction"] == tables["transaction"].count()
    again = landing.read_files(spark, folder)
    assert landing.validated(spark, again).isEmpty()
    assert {r.problem for r in landing.validated(spark, {"bank": again["bank"].drop("bank_name")}).collect()} == {"missing table", "missing column"}
    with pytest.raises(ValueError):
        landing.land(tables | {"transaction": tables["transaction"].limit(0)}, folder)
    landing.export(again["bank"], f"{folder}/csv/bank.csv", "csv")
    assert spark.read.csv(f"{folder}/csv/bank.csv", header=True).count() == again["bank"].count()
    o = landing.jdbc_options("mysql://u:p@host:3306/db?fetchsize=100", "t")
    assert o["url"] == "jdbc:mysql://host:3306/db?sslMode=REQUIRED" and o["user"] == "u" and o["fetchsize"] == "100"
    assert "DISABLED" in landing.jdbc_options("mysql://h/db", "t", insecure=True)["url"]
    assert "verify-full" in landing.jdbc_options("postgres://h/db", "t", ca="/ca.pem")["url"]


SMALL = ["spend_facts", "top_counterparties", "period_calendar", "preceding_window", "merchant_dim", "vendor_spend", "payout_outliers", "thread_summary", "quality_report"]


@pytest.mark.parametrize("name", SMALL)
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in "customer orders part supplier lineitem conversations events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = c.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r)) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
