"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = [
    "narration_extract", "vocabulary", "txn_fact", "rollup_monthly", "merchant_dim", "counterparty_coverage", "spend_facts", "spend_by_merchant", "spend_last_30_days",
    "top_counterparties", "latest_transactions", "over_threshold", "compare_months", "balances", "primary_account", "resolve_exact", "quality_report", "vendor_spend", "payout_outliers",
]


def main() -> None:
    shared = tempfile.mkdtemp(prefix="spark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyweave.functions.narration import extracted
    from tallyweave.operators import balances, model, resolve, spend
    from tallyweave.plans import build
    from tallyweave.queries import LAST, QUERIES as ALL, warehouse
    from tallyweave.sources import ledger

    took: dict[str, float] = {}

    def timed(name: str, run: object) -> object:
        began = time.perf_counter()
        out = run()
        took[name] = round(time.perf_counter() - began, 3)
        return out

    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    drain(ALL["narration_extract"](spark, SF_DIR))  # code is compiled, files are cached
    timed("warehouse", lambda: warehouse(spark, SF_DIR))  # what the queries read
    for name in QUERIES:
        timed(name, lambda name=name: drain(ALL[name](spark, SF_DIR)))

    # the warehouse once, then questions on what it stored, as the reference answers them
    tables, root = ledger.read(spark, SF_DIR), f"file://{shared}/warehouse"
    rows = tables["transaction"].count()
    timed("full_build", lambda: build.full(spark, tables, root, cluster=False))
    timed("increment_without_news", lambda: build.increment(spark, tables, root, cluster=False))
    w = build.read(spark, root)
    routed = lambda win, aligned=True: spend.routed(w["fact"], w["rollup"], *win, aligned)
    questions = {
        "stored_spend_month": lambda: spend.spend_facts(routed(LAST), "debit"),
        "stored_spend_all_time": lambda: spend.spend_facts(routed((None, None)), "debit"),
        "stored_spend_unaligned": lambda: spend.spend_facts(routed(LAST, False), "debit"),
        "stored_top_counterparties": lambda: spend.top_counterparties(routed((None, None)), "debit"),
        "stored_one_entity_spend": lambda: spend.spend_facts(routed(LAST), "debit", entity="3"),
        "stored_list_50": lambda: spend.listing(w["fact"], limit=50),
        "stored_balances": lambda: balances.balances(tables["account"], tables["bank"]),
        "stored_people": lambda: resolve.people(resolve.vocabulary(w["dim"])),
        "stored_rollup_rebuild": lambda: model.rollup(w["fact"]),
        "stored_extraction": lambda: extracted(tables["transaction"], tables["bank"]).agg(F.count("merchant_raw")),
    }
    for name, question in questions.items():
        timed(name, lambda question=question: drain(question()))
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "transactions": rows, "build_rows_per_sec": round(rows / took["full_build"]), "spark": spark.version, "master": f"local[{CPUS}]", "shuffle_partitions": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
