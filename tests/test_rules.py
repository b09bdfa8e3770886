"""Rules on texts and rows: amounts, guards, persons, windows, vendors' questions, increments that leave files alone."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import periods, questions
from tallyweave.operators import conversations, model, payouts, quality, resolve, spend, trust, vocabulary
from tallyweave.plans import build
from tallyweave.plans.storage import stored
from tallyweave.sources import ledger

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab_dim(spark):
    rows = [("1", "SWIGGY", "merchant", 9, 90.0, 0.0), ("1", "SELECTION ELECTRONICS", "merchant", 2, 5.0, 0.0), ("1", "NAVYUG SELECTION", "merchant", 4, 7.0, 0.0), ("1", "ASHA ROY", "person", 3, 0.0, 70.0), ("1", "RAVI RAO", "person", 5, 0.0, 20.0)]
    return spark.createDataFrame(
        [(*r, 0.9, date(2001, 1, 1), date(2001, 7, 1), 3) for r in rows],
        "entity_id string, merchant_norm string, counterparty_kind string, txn_count long, total_debit double, total_credit double, kind_confidence double, first_month date, last_month date, active_months long",
    )


def test_amounts(spark):
    answers = spark.createDataFrame([(1, "You spent 1234.5 and 1234.50 of 12345 on 99"), (2, "About ₹ 5000, 777"), (3, None)], "answer_id int, text string")
    facts = spark.createDataFrame([(1, 1234.5), (1, 99.0), (2, 5000.0), (2, 777.0)], "answer_id int, value double")
    got = {r.answer_id: r.text for r in trust.amounts_written(answers, facts).collect()}
    assert got == {1: "You spent ₹1,234.50 and ₹1,234.50 of 12345 on 99", 2: "About ₹5,000.00, 777", 3: None}
    rows = spark.createDataFrame([(1, "x", 2, 3.5), (2, "y", None, -1.0)], "answer_id int, name string, n int, v double")
    assert sorted(map(tuple, trust.figures_of(rows).collect())) == [(1, 2.0), (1, 3.5), (2, -1.0)]


def test_sentences(spark):
    row = spark.createDataFrame([(100.0, 150.0, 50.0, 50.0, 3, 450.0, True)], "earlier double, later double, delta double, pct_change double, matches int, match_total double, truncated boolean")
    got = row.select(*(trust.sentence(k).alias(k) for k in ("compare", "list", "threshold"))).first()
    assert got.compare == "It was ₹150.00 after ₹100.00, a rise of ₹50.00 (50.0 %)."
    assert got.list == "3 transactions of ₹450.00, the first of them shown." and got.threshold == "3 transactions above the amount, ₹450.00 together."


def test_persons_and_guards(spark, vocab_dim):
    people = resolve.people(resolve.vocabulary(vocab_dim))
    asked = spark.createDataFrame([(1, "1", "how much did my friend send", None), (2, "1", "how much did she send", "ASHA ROY"), (3, "1", "show my balances", None), (4, "9", "someone paid me", None), (5, "1", None, None)], "question_id int, entity_id string, text string, merchant_norm string")
    got = {r.question_id: (r.ask_person, r.candidates) for r in conversations.needs_person(asked, people).collect()}
    assert got == {1: (True, ["ASHA ROY", "RAVI RAO"]), 2: (False, None), 3: (False, None), 4: (True, []), 5: (False, None)}
    mentions = spark.createDataFrame([(1, "1", ""), (2, "1", "asha roy"), (3, "1", "swiggy"), (4, "9", None)], "mention_id int, entity_id string, name string")
    got = {r.mention_id: (r.status, r.entity, r.candidates) for r in resolve.persons(mentions, vocab_dim).collect()}
    assert got[1] == ("AMBIGUOUS", None, ["ASHA ROY", "RAVI RAO"]) and got[2][:2] == ("MATCH", "ASHA ROY") and got[3][0] == "NOT_FOUND" and got[4] == ("NOT_FOUND", None, [])
    literals = spark.createDataFrame([(1, "1", "debit"), (2, "1", "450.5"), (3, "1", "2001-07-01"), (4, "1", "last month"), (5, "1", "swigy"), (6, "1", "Snowflake"), (7, "1", "selection")], "mention_id int, entity_id string, name string")
    got = {r.mention_id: (r.status, r.value) for r in resolve.guarded(literals, resolve.vocabulary(vocab_dim)).collect()}
    assert got == {1: ("PLAIN", "debit"), 2: ("PLAIN", "450.5"), 3: ("PLAIN", "2001-07-01"), 4: ("PLAIN", "last month"), 5: ("MATCH", "SWIGGY"), 6: ("NOT_FOUND", None), 7: ("AMBIGUOUS", None)}
    answers = resolve.resolved(mentions, resolve.vocabulary(vocab_dim))
    stats = {r.mention_id: r.statistics for r in resolve.with_statistics(answers, mentions, vocab_dim).collect()}
    assert stats[2].total_credit == 70.0 and stats[2].active_months == 3 and stats[4].txn_count == 0
    loose = resolve.resolved(spark.createDataFrame([(1, "1", "swgy")], "mention_id int, entity_id string, name string"), resolve.vocabulary(vocab_dim), profile=resolve.VENDORS).first()
    assert loose.status == "MATCH" and loose.entity == "SWIGGY"


def test_names_after_prepositions(spark):
    texts = ["how much did I spend on Uber Eats last month", "paid to Asha Roy?", "spend in April", "transactions from last week", "nothing here"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in rows.select("i", resolve.named_after(F.col("t")).alias("n")).orderBy("i").collect()] == ["Uber Eats", "Asha Roy", None, None, None]


def test_baselines(spark):
    day = date
    rows = [(1, day(2026, 5, 1), day(2026, 5, 31), None, None), (2, day(2026, 5, 1), day(2026, 5, 31), day(2026, 5, 1), day(2026, 5, 31)), (3, day(2026, 5, 1), day(2026, 5, 31), day(2025, 5, 1), day(2025, 5, 31))]
    got = spend.compared_with(spark.createDataFrame(rows, "i int, start date, end date, base_start date, base_end date")).orderBy("i").collect()
    assert [(r.base_start, r.base_end) for r in got] == [(day(2026, 4, 1), day(2026, 4, 30))] * 2 + [(day(2025, 5, 1), day(2025, 5, 31))]
    same = spark.range(1).select(periods.same_window(F.lit(None), F.lit(None), F.lit(None), F.lit(None)).alias("s"), periods.suggestions(F.lit("UNRESOLVED")).alias("more")).first()
    assert same.s and "last_month" in same.more


def test_vendor_questions(spark):
    texts = ["latest payment to Acme", "show unreconciled payouts in 2024", "spend by category", "how much did we pay Acme last month", "list pending payments", "hello"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r.x) for r in rows.select("i", questions.vendor_intent(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [("latest_payment", None, None), ("reconciliation_audit", "unreconciled", "year_2024"), ("category_summary", None, None), ("spend_summary", None, "last_month"), ("transaction_list", "pending", None), (None, None, None)]
    vendors = spark.createDataFrame([(1, "Zenith, Inc. Software"), (2, "Acme Co")], "vendor_id int, vendor_name string")
    asked = spark.createDataFrame([(1, "what did zenith get"), (2, "the acme one")], "text_id int, text string")
    assert [tuple(r) for r in payouts.mentioned_vendors(asked, vendors).collect()] == [(1, 1)]


def test_carried_counterparties(spark):
    rows = [(1, 0, "spend", False, "debit", "april", "UBER"), (1, 1, "spend", True, None, None, None), (1, 2, "rank", True, None, None, None)]
    tagged = spark.createDataFrame(rows, "conv_id int, turn int, intent string, follows boolean, direction string, period string, merchant string")
    got = {r.turn: (r.direction, r.period, r.merchant) for r in conversations.carried(tagged, "merchant").collect()}
    assert got == {0: ("debit", "april", "UBER"), 1: ("debit", "april", "UBER"), 2: (None, None, None)}


@pytest.fixture(scope="module")
def two_builds(spark, tmp_path_factory):
    """A warehouse of early transactions and one increment."""
    root, tables = f"file://{tmp_path_factory.mktemp('warehouse')}", ledger.read(spark, SF)
    t = tables["transaction"]
    early = stored(t.filter(F.col("transaction_date") < F.lit(datetime(2001, 7, 1))), "early")
    build.full(spark, tables | {"transaction": early}, root, cluster=False)
    files = set(build.read(spark, root)["fact"].inputFiles())
    return root, tables, files, build.increment(spark, tables, root, cluster=False)


def test_increments_leave_files_alone(spark, two_builds):
    root, tables, files, m = two_builds
    w = build.read(spark, root)
    assert files < set(w["fact"].inputFiles()) and m["before"] + m["added"] == m["row_count"] == w["fact"].count()
    again = build.increment(spark, tables, root, cluster=False)
    assert again["added"] == 0 and again["version"] == m["version"]
    for ours, whole in ((w["rollup"], model.rollup(w["fact"])), (w["dim"], model.merchant_dim(w["fact"]))):
        assert ours.exceptAll(whole.select(*ours.columns)).isEmpty() and whole.select(*ours.columns).exceptAll(ours).isEmpty()
    assert w["account"].count() == tables["account"].count() and w["bank"].count() == tables["bank"].count()


def test_quality_finds_what_is_broken(spark, two_builds):
    root, tables, _, _ = two_builds
    w = build.read(spark, root)
    fact, bank = w["fact"], tables["bank"]
    found = lambda **kw: {r["check"]: r.found for r in quality.report(*({"t": tables["transaction"], "fact": fact, "rollup": w["rollup"], "dim": w["dim"], "bank": bank} | kw).values()).collect() if r.found}
    assert found() == {}
    lost = fact.filter("transaction_id <> '10'")
    assert found(fact=lost).keys() == {"rows_missing_from_fact", "entities_that_differ"}
    assert "duplicate_keys" in found(fact=fact.unionByName(fact.limit(3)))
    assert found(fact=fact.withColumn("entity_id", F.lit(None).cast("string"))).get("rows_without_entity") == fact.count()
    bad = w["dim"].limit(1)
    for name, check in (("AMZN", "brands_not_folded"), ("FOO LIMITED", "legal_forms_left"), ("BANK CHARGES", "sentinels_as_merchants"), ("BUILDING", "bank_codes_as_names")):
        dim = w["dim"].unionByName(bad.withColumns({"merchant_norm": F.lit(name), "counterparty_kind": F.lit("merchant")}))
        assert found(dim=dim) == {check: 1}, name
    assert found(fact=fact.withColumn("merchant_norm", F.lit("UNKNOWN"))).get("coverage_below_90_percent") == 1
    assert found(fact=fact.filter("counterparty_kind <> 'person'")).get("kinds_missing") == 1


def test_letters_rule_out_no_similar_pair():
    """What is skipped for its letters is below the threshold, on names with and without words in common."""
    import itertools
    import random

    import pandas as pd

    from tallyweave.functions import similarity

    rng = random.Random(3)
    words = ["SWIGGY", "SWGY", "BIG", "BASKET", "BASKTE", "ÉTÉ", "A", "AB", "STORES", "TORSES", ""]
    names = ["", *(" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60))]
    pairs = list(itertools.combinations(names, 2))
    a, b = pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs])
    for least in (50, 70, 92):
        skipped = [p for p, low in zip(pairs, similarity.hopeless(a, b, least), strict=True) if low]
        assert skipped and all(similarity.token_set_ratio(*p) < least for p in skipped)


def test_similar_pairs_of_the_vocabulary(spark, two_builds):
    """Against all pairs: at 92 none is lost, at 70 at least 99 of 100 are found."""
    from tallyweave.functions import similarity

    root = two_builds[0]
    names = sorted({r.merchant_norm for r in build.read(spark, root)["alias"].select("merchant_norm").distinct().collect()})[:260]
    names += ["SWGGY", "SWIGY", "SWIGGY", "SWIGGY STORE", "BIG BASKET", "BASKET BIG", "BIGG BASKET", "SELECTION", "SELECTION ELECTRONICS", "AB", "ABC", "A B"]
    ranked = spark.createDataFrame([(n, n) for n in sorted(set(names))], "name string, rank string")
    scores = {(a, b): similarity.token_set_ratio(a, b) for i, a in enumerate(sorted(set(names))) for b in sorted(set(names))[i + 1 :]}
    for least, recall in ((92, 1.0), (70, 0.99)):
        got = {(r.high, r.low) for r in vocabulary.similar_pairs(ranked, least).collect()}
        want = {p for p, s in scores.items() if s >= least}
        assert got <= want and len(got) >= recall * len(want), (least, sorted(want - got)[:5])
