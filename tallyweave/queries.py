"""All ledger queries by name: each takes (spark, sf_dir) and returns a DataFrame over the given tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import narration, periods, privacy, similarity
from .operators import adhoc, balances, conversations, model, payouts, quality, resolve, spend, trust, vocabulary
from .plans import build
from .plans.storage import shared_dir, state_of, stored
from .sources import landing, ledger
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
#: Windows of the benchmark questions (fixed values): the last whole month, its predecessor, a quarter, thirty days.
LAST, BEFORE = (date(2001, 7, 1), date(2001, 7, 31)), (date(2001, 6, 1), date(2001, 6, 30))
Q2, Q1 = (date(2001, 4, 1), date(2001, 6, 30)), (date(2001, 1, 1), date(2001, 3, 31))
DAYS = (date(2001, 7, 3), date(2001, 8, 1))
PEPPER = "pepper"
PHRASES = [
    "last month", "lastMonth", " LAST-MONTH ", "prior_month", "this quarter", "q1", "q9", "ytd", "last 3 months", "last_30_days", "past_2_months",
    "last_99_months", "2000", "fy2001", "in 2000", "the year 1999", "april", "feb_2000", "total", "", "fortnight", "last year", "month before last", "q4",
]


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return ledger.read(spark, sf_dir)


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return narration.extracted(t["transaction"], t["bank"])


_built: dict[tuple[str, str, str, bool], str] = {}
_building = threading.Lock()
#: Tables that the ledger is made of.
LEDGER_TABLES = ["orders", "part", "customer"]


def _place(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def warehouse(spark: SparkSession, sf_dir: str, cluster: bool = False) -> dict[str, DataFrame]:
    """The warehouse of a folder's tables, read."""
    return build.read(spark, warehouse_root(spark, sf_dir, cluster))


def warehouse_root(spark: SparkSession, sf_dir: str, cluster: bool = False) -> str:
    """Where the warehouse of a folder's tables is: built once per application and state of their files.

    Names are clustered in one of the two that there are; SQL can check the other.
    """
    state = state_of(spark, [f"{sf_dir}/{n}.parquet" for n in LEDGER_TABLES])
    key = (spark.sparkContext.applicationId, sf_dir, state, cluster)
    with _building:
        if key not in _built:
            root = _place(spark, "warehouse")
            build.full(spark, _tables(spark, sf_dir), root, cluster=cluster, pepper=PEPPER)
            _built[key] = root
    return _built[key]


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse(spark, sf_dir)["alias"]


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse(spark, sf_dir)["fact"].drop(model.BLIND)


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse(spark, sf_dir)["rollup"]


def _dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse(spark, sf_dir)["dim"]


def _rows(spark: SparkSession, sf_dir: str, window: tuple[date, date] | None, aligned: bool = True) -> DataFrame:
    start, end = window or (None, None)
    w = warehouse(spark, sf_dir)
    return spend.routed(w["fact"], w["rollup"], start, end, aligned)


def _payouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = ledger.payouts(spark, sf_dir)
    return t["payouts"], t["vendors"]


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as asked for, made from the parts table: one per part and form of writing."""
    parts, i, p = ledger.named_parts(spark, sf_dir), F.col("p_partkey"), F.col("p")
    name = F.when(i % 5 == 0, F.concat(F.upper(p), F.lit(" Ltd"))).when(i % 5 == 1, F.element_at(F.split(p, " "), 2)).when(i % 5 == 2, F.lit("Bundl Technologies")).when(i % 5 == 3, F.lit("Snowflake")).otherwise(F.substring(p, 1, 6))
    return parts.select(i.alias("mention_id"), (i % 25).cast("string").alias("entity_id"), name.alias("name"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answer texts about accounts, every fifth with a figure that no fact has, and the facts."""
    a = _tables(spark, sf_dir)["account"].select(F.col("account_id").cast("bigint").alias("answer_id"), F.col("available_balance").alias("value"))
    wrong = F.when(F.col("answer_id") % 5 == 0, " and 98,765,432.10").otherwise("")
    return a.select("answer_id", F.concat(F.lit("The balance is "), F.col("value").cast("string"), F.lit(" in 2 accounts"), wrong).alias("text")), a


def _payout_files(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five CSV files of vendor payouts, written from the given tables and read under their declared schemas."""
    at = _place(spark, "payout-files")
    ledger.write_payout_files(spark, sf_dir, at)
    return landing.read_payout_files(spark, at)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' texts, each after a question chosen by the turn, as the given texts hold none."""
    asked = F.element_at(F.array(*map(F.lit, QUESTIONS)), ((F.col("conv_id") * 3 + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    return _conversations(spark, sf_dir).withColumn("text", F.concat_ws(". ", asked, "text"))


QUESTIONS = [
    "how much did I spend on swiggy last month", "what about April", "who sent me the most money this year", "compare it to the month before", "show my balances",
    "transactions over two lakh in 2000", "highest transaction this quarter", "last 5 transactions", "which month did I spend the most", "list payments above 50,000",
    "how much was I paid in total", "and last quarter", "first transaction in 1999",
]


def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(vocabulary.folded(vocabulary.vocabulary(_extracted(spark, sf_dir))), "vocabulary")  # filters below would go to each transaction
    counted = rows.filter("norm not in ('UNKNOWN', '__BANK_CHARGE__', '__SELF_TRANSFER__')").groupBy(F.col("brand").alias("name")).agg(F.sum("freq").alias("freq"))
    return vocabulary.clusters(counted)


def clustered_counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's counterparties under their clustered names, from the clustered warehouse."""
    return warehouse(spark, sf_dir, cluster=True)["dim"]


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(vocabulary.folded(vocabulary.vocabulary(_extracted(spark, sf_dir))), "vocabulary").select("brand").distinct()
    ranked = rows.select(F.col("brand").alias("name"), F.col("brand").alias("rank"))
    pairs = vocabulary.similar_pairs(ranked, 70)
    return pairs.select("high", "low", F.round("score", 4).alias("score"), F.round(similarity.best("high", "low"), 4).alias("best"))


def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an increment adds to a fact that ends in 2000, per month."""
    t = _tables(spark, sf_dir)["transaction"]
    cut = date(2000, 12, 31)
    known = t.filter((F.col("transaction_date") <= F.lit(cut).cast("timestamp_ntz")) & (F.col("transaction_id").cast("bigint") % 50 != 0))
    new = build.new_rows(t, known, cut)
    return new.groupBy(narration.month(F.col("transaction_date")).alias("txn_month")).agg(F.count("*").alias("added"))


def alias_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _aliases(spark, sf_dir)
    old = new.filter(F.length("merchant_raw") % 2 == 0).withColumn("merchant_norm", F.concat(F.lit("OLD "), F.col("merchant_norm")))
    return vocabulary.preserved(old, new)


def period_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase at the last day of each order month."""
    anchors = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.last_day("o_orderdate").alias("anchor")).distinct()
    rows = anchors.withColumn("phrase", F.explode(F.array(*map(F.lit, PHRASES))))
    return periods.resolved(rows, "phrase", "anchor").select("anchor", "phrase", "status", "canonical", "start", "end", "month_aligned")


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("anchor")).distinct()
    return periods.calendar(anchors)


def routing_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose spend differs between rollup and fact over a whole quarter: none."""
    a = spend.spend_facts(_rows(spark, sf_dir, Q2), "debit")
    b = spend.spend_facts(_rows(spark, sf_dir, Q2, aligned=False), "debit")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("different"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark, sf_dir)
    return quality.report(_tables(spark, sf_dir)["transaction"], w["fact"], w["rollup"], w["dim"], w["bank"])


def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spend.unattributed(_rows(spark, sf_dir, None)).withColumn("assumed", F.col("entity_id").cast("int") % 2 == 0)
    args = (F.lit(0.96), F.col("assumed"), F.col("unattributed"), F.lit(False), F.col("entity_id").cast("int") % 5 == 0)
    rows = rows.withColumn("score", trust.confidence(*args))
    return rows.select("entity_id", "unattributed", "score", trust.band(F.col("score")).alias("band"), F.concat_ws("; ", trust.reasons(*args)).alias("reasons"))


def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spend.spend_facts(_rows(spark, sf_dir, LAST), "debit")
    text = trust.spend_sentence(F.col("total"), F.col("txns"), F.lit("debit"), F.lit(None).cast("string"))
    return facts.select("entity_id", text.alias("answer"))


def _said(kind: str, rows: DataFrame) -> DataFrame:
    """A sentence per row of an operator's result."""
    return rows.select("entity_id", trust.sentence(kind).alias("answer"))


def grounding_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the answers' figures are in any column of the rows they come from; every fifth entity's rows are withheld."""
    rows = spend.spend_facts(_rows(spark, sf_dir, LAST), "debit").withColumnRenamed("entity_id", "answer_id")
    facts = trust.figures_of(rows.filter(F.col("answer_id").cast("int") % 5 != 0))
    return trust.grounded(rows.select("answer_id", trust.sentence("spend").alias("text")), facts)


def compared_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each calendar window is compared with, where the asker named the window itself, none, or the year 1999."""
    own, none = F.col("token") == "this_month", F.col("token") == "ytd"
    given = lambda c, d: F.when(own, F.col(c)).when(~none, F.lit(d))
    windows = _calendar(spark, sf_dir).withColumns({"base_start": given("start", date(1999, 1, 1)), "base_end": given("end", date(1999, 12, 31))})
    return spend.compared_with(windows).select("anchor", "token", "base_start", "base_end")


def period_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be asked instead of the phrases that aren't understood."""
    rows = period_phrases(spark, sf_dir).withColumn("suggestions", F.concat_ws(",", periods.suggestions(F.col("status"))))
    return rows.filter("status = 'UNRESOLVED'").select("anchor", "phrase", "suggestions")


def account_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs of entity and account that orders claim, those that exist."""
    claimed = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 25).cast("string").alias("entity_id"), F.col("o_custkey").cast("string").alias("account_id"))
    return balances.owned(claimed.distinct(), _tables(spark, sf_dir)["account"])


def answer_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each answer on a leading person covers."""
    rows = spend.top_counterparties(_rows(spark, sf_dir, Q2), "credit", 3, "person")
    text = spend.scope_text(F.col("merchant_norm"), F.lit("q2"), F.lit("credit"), F.col("counterparty_kind"), F.lit(None).cast("string"))
    return rows.select("entity_id", "rank", text.alias("scope"))


def _stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events drained through the deduplicating stream into the shared folder, twice; each is there once."""
    at = _place(spark, "stream")
    for i in range(2):
        rows = ingest.deduplicated(_stream_source(spark, sf_dir), "event_id", "ts").drop("event_time")
        ingest.run(rows, f"{at}/out", f"{at}/checkpoint-{i}", "event_id", "ts").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type", "value")


def stream_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals per event type, from days' totals that the stream updates."""
    at = _place(spark, "stream")
    totals = ingest.daily(_stream_source(spark, sf_dir), "ts", "value", ["event_type"])
    ingest.run_totals(totals, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return ingest.monthly(spark.read.parquet(f"{at}/out"), ["event_type"])


def warehouse_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full build with clustered names, an increment that finds nothing new, and the summary of the fact."""
    root = _place(spark, "clustered")
    tables = _tables(spark, sf_dir)
    build.full(spark, tables, root)
    added = build.increment(spark, tables, root)["added"]
    return build.summary(build.read(spark, root)["fact"]).withColumn("added", F.lit(added).cast("bigint"))


def adhoc_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ad-hoc SELECT over one entity's stored views."""
    t = warehouse(spark, sf_dir)
    tables = {n: stored(df, n).inputFiles()[0].rsplit("/", 1)[0] for n, df in adhoc.views(t["fact"], t["account"], t["bank"], "3").items()}
    text = "SELECT channel, count(*) AS txns, sum(transaction_amount) AS total FROM my_transactions WHERE dayofweek(transaction_date) IN (1, 7) AND transaction_type = ? GROUP BY channel"
    return adhoc.run(spark, tables, text, ["debit"], resolve.vocabulary(t["dim"]), "3")[0]


def guarded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guard of ad-hoc filters says of each name that is asked for."""
    return resolve.guarded(_mentions(spark, sf_dir), resolve.vocabulary(_dim(spark, sf_dir)))


def stream_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as a stream of files, joined with the warehouse's aliases batch by batch: the same fact."""
    at = _place(spark, "stream")
    _tables(spark, sf_dir)["transaction"].write.parquet(f"{at}/in")
    root = warehouse_root(spark, sf_dir)
    ingest.run_fact(ingest.source(spark, f"{at}/in"), root, at, f"{at}/checkpoint").awaitTermination()
    return ingest.committed(spark, f"{at}/fact", build.read(spark, root)["fact"].drop(model.BLIND).schema)


def mention_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counterparty that each narration names, found in the text itself."""
    fact = _fact(spark, sf_dir)
    texts = fact.select(F.col("transaction_id").alias("text_id"), "entity_id", F.col("description").alias("text"))
    return resolve.mentioned(texts, resolve.vocabulary(_dim(spark, sf_dir)))


def names_in_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counterparty, or what stands in its place, that each conversation's turn names."""
    turns = _conversations(spark, sf_dir)
    texts = turns.select(F.concat_ws(":", "conv_id", "turn").alias("text_id"), (F.col("conv_id") % 25).cast("string").alias("entity_id"), "text")
    return resolve.names_asked(texts, resolve.vocabulary(_dim(spark, sf_dir)))


def period_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions need a period, a question per transaction."""
    fact, key = _fact(spark, sf_dir), F.col("transaction_id").cast("bigint")
    asked = fact.select(F.col("transaction_id").alias("question_id"), "entity_id", "merchant_norm", F.when(key % 2 == 1, "last_month").alias("period"), (key % 5 == 0).alias("bounded"))
    return conversations.needs_period(asked, _dim(spark, sf_dir))


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates and times of cases, events standing in for them."""
    cases = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = trust.scorecard(cases.select(F.col("event_type").alias("run"), (F.col("value") > 5).alias("passed"), F.col("value").alias("ms")))
    return out.withColumn("p50_ms", F.round("p50_ms", 4))


def _events(f: Callable[..., DataFrame], window: tuple[date, date] | None, *args: object, aligned: bool = True, **kw: object) -> Query:
    return lambda spark, sf_dir: f(_rows(spark, sf_dir, window, aligned), *args, **kw)


def _of_fact(f: Callable[..., DataFrame], *args: object, **kw: object) -> Query:
    return lambda spark, sf_dir: f(_fact(spark, sf_dir), *args, **kw)


def _of_account(f: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        return f(t["account"], t["bank"])

    return run


def _of_payouts(f: Callable[..., DataFrame], *args: object) -> Query:
    return lambda spark, sf_dir: f(*_payouts(spark, sf_dir), *args)


QUERIES: dict[str, Query] = {
    "narration_extract": lambda s, d: _extracted(s, d).select("transaction_id", "channel", "merchant_raw", "txn_month"),
    "channel_mix": lambda s, d: _extracted(s, d).groupBy("channel").agg(F.count("*").alias("txns")),
    "vocabulary": lambda s, d: vocabulary.vocabulary(_extracted(s, d)).withColumn("credit_ratio", F.round("credit_ratio", 6)),
    "normalised_names": lambda s, d: vocabulary.folded(vocabulary.vocabulary(_extracted(s, d))).select("merchant_raw", "norm"),
    "alias_fold": lambda s, d: vocabulary.folded(vocabulary.vocabulary(_extracted(s, d))).groupBy("brand").agg(F.sum("freq").alias("freq"), F.count("*").alias("forms")),
    "kind_scores": _aliases,
    "vocabulary_statistics": lambda s, d: vocabulary.statistics(vocabulary.vocabulary(_extracted(s, d)), _aliases(s, d), _tables(s, d)["bank"]),
    "name_clusters": name_clusters,
    "clustered_counterparties": clustered_counterparties,
    "name_similarity": name_similarity,
    "txn_fact": _fact,
    "merchant_dim": _dim,
    "rollup_monthly": _rollup,
    "counterparty_coverage": _of_fact(model.coverage),
    "coverage_by_kind": _of_fact(model.coverage_by_kind),
    "top_merchants": _of_fact(model.ranked_counterparties, "debit", 10),
    "people_who_paid": _of_fact(model.ranked_counterparties, "credit", 6, "person"),
    "anchor_date": _of_fact(model.anchor),
    "incremental_append": incremental_append,
    "alias_preserve": alias_preserve,
    "warehouse_build": warehouse_build,
    "period_calendar": _calendar,
    "period_phrases": period_phrases,
    "preceding_window": lambda s, d: spend.baseline(_calendar(s, d)).select("anchor", "token", "base_start", "base_end"),
    "compared_windows": compared_windows,
    "period_suggestions": period_suggestions,
    "spend_facts": _events(spend.spend_facts, LAST, "debit"),
    "spend_all_time": _events(spend.spend_facts, None, "credit"),
    "spend_by_merchant": _events(spend.spend_by, LAST, "debit", "merchant_norm"),
    "spend_by_month": _events(spend.spend_by, None, "debit", "txn_month", merchant="SWIGGY"),
    "month_extremes": _events(spend.month_extremes, None, "debit"),
    "spend_last_30_days": _events(spend.spend_facts, DAYS, "debit", aligned=False),
    "credits_from_people": _events(spend.spend_by, Q2, "credit", "merchant_norm", kind="person"),
    "routing_equivalence": routing_equivalence,
    "top_counterparties": _events(spend.top_counterparties, None, "debit"),
    "top_people": _events(spend.top_counterparties, Q2, "credit", 3, "person"),
    "excluded_totals": _events(spend.top_counterparties, LAST, "debit", 1),
    "latest_transactions": _of_fact(spend.listing, limit=5),
    "largest_transaction": _of_fact(spend.extreme, True, "debit"),
    "smallest_transaction": _of_fact(spend.extreme, False, "debit"),
    "over_threshold": _of_fact(spend.listing, order_by="amount", limit=20, direction="debit", least=450000.0),
    "amounts_between": _of_fact(spend.listing, order_by="amount", ascending=True, limit=10, direction="debit", least=100000.0, most=200000.0),
    "first_in_year": _of_fact(spend.listing, ascending=True, limit=3, start=date(2000, 1, 1), end=date(2000, 12, 31)),
    "compare_months": _events(spend.compared, None, "debit", LAST, BEFORE),
    "compare_quarters": _events(spend.compared, None, "debit", Q1, Q2, "SWIGGY"),
    "balances": _of_account(balances.balances),
    "balance_totals": lambda s, d: balances.balance_totals(_tables(s, d)["account"]),
    "primary_account": _of_account(balances.primary_accounts),
    "account_ownership": account_ownership,
    "busiest_entity": lambda s, d: balances.busiest(_rollup(s, d), 3),
    "reference_lookup": lambda s, d: balances.by_reference(_fact(s, d), s.range(0, 5000, 500).select(F.concat(F.lit("REF"), F.col("id").cast("string")).alias("reference"))),
    "utr_lookup": lambda s, d: balances.by_utr(warehouse(s, d)["fact"], s.range(100000, 115000, 1000).select(F.concat(F.lit("utr"), F.col("id").cast("string")).alias("utr")), PEPPER),
    "unattributed_share": _events(spend.unattributed, LAST, "debit"),
    "confidence_bands": confidence_bands,
    "resolve_tiers": lambda s, d: resolve.tiers(_mentions(s, d), resolve.vocabulary(_dim(s, d))),
    "resolve_exact": lambda s, d: resolve.resolved(_mentions(s, d), resolve.vocabulary(_dim(s, d)), fuzzy=False).select("mention_id", "status", "entity", "confidence", "method"),
    "resolve_cascade": lambda s, d: resolve.resolved(_mentions(s, d), resolve.vocabulary(_dim(s, d))),
    "mention_detection": mention_detection,
    "names_in_conversations": names_in_conversations,
    "period_gate": period_gate,
    "scorecard": scorecard,
    "resolve_statistics": lambda s, d: resolve.with_statistics(resolve.resolved(_mentions(s, d), resolve.vocabulary(_dim(s, d)), fuzzy=False), _mentions(s, d), _dim(s, d)).select("mention_id", "entity", "statistics.txn_count", "statistics.total_debit", "statistics.active_months"),
    "resolve_people": lambda s, d: resolve.people(resolve.vocabulary(_dim(s, d))),
    "masked_accounts": lambda s, d: _tables(s, d)["account"].select("account_id", privacy.masked(F.col("account_number")).alias("account_number")),
    "redacted_descriptions": lambda s, d: _tables(s, d)["transaction"].select("transaction_id", privacy.redacted(F.col("description")).alias("description")),
    "adhoc_weekend_counts": _of_fact(adhoc.weekend_counts),
    "adhoc_channel_by_month": _of_fact(adhoc.channels_by_month),
    "adhoc_select": adhoc_weekend,
    "guarded_values": guarded_values,
    "quality_report": quality_report,
    "grounding_check": lambda s, d: trust.grounded(*_answers(s, d)),
    "answer_sentences": answer_sentences,
    "balance_sentences": lambda s, d: balances.balance_totals(_tables(s, d)["account"]).select("entity_id", trust.sentence("balances").alias("answer")),
    "extreme_sentences": lambda s, d: spend.extreme(_fact(s, d), True, "debit").select("entity_id", trust.sentence("extreme").alias("answer")),
    "month_sentences": lambda s, d: _said("monthly", spend.month_extremes(_rows(s, d, None), "debit")),
    "rank_sentences": lambda s, d: _said("rank", spend.top_counterparties(_rows(s, d, None), "debit", 1)),
    "comparison_sentences": lambda s, d: _said("compare", spend.compared(_rows(s, d, None), "debit", LAST, BEFORE)),
    "listing_sentences": lambda s, d: _said("list", spend.listing(_fact(s, d), limit=1, direction="credit", start=DAYS[0], end=DAYS[1])),
    "threshold_sentences": lambda s, d: _said("threshold", spend.listing(_fact(s, d), order_by="amount", limit=1, direction="debit", least=450000.0)),
    "grounding_of_rows": grounding_of_rows,
    "answer_scopes": answer_scopes,
    "amounts_written": lambda s, d: trust.amounts_written(*_answers(s, d)),
    "question_tags": lambda s, d: conversations.tagged(_questions(s, d)),
    "context_carry_forward": lambda s, d: conversations.carried(conversations.tagged(_questions(s, d))),
    "newest_threads": lambda s, d: conversations.newest_threads(_conversations(s, d), 20),
    "thread_summary": lambda s, d: conversations.threads(_conversations(s, d)),
    "last_n_messages": lambda s, d: conversations.last_messages(_conversations(s, d), 3),
    "conversation_totals": lambda s, d: conversations.totals(_conversations(s, d)),
    "vendor_spend": _of_payouts(payouts.vendor_summary),
    "top_vendors": _of_payouts(payouts.top_vendors),
    "payout_listing": _of_payouts(payouts.listed, 50, ["reconciled"], "promo"),
    "latest_payouts": _of_payouts(payouts.latest, 3),
    "category_spend": lambda s, d: payouts.category_summary(_payouts(s, d)[0]),
    "status_split": lambda s, d: payouts.status_split(_payouts(s, d)[0]),
    "monthly_change": lambda s, d: payouts.monthly_change(_payouts(s, d)[0]),
    "reconciliation_audit": _of_payouts(payouts.audit, ["unreconciled", "disputed"]),
    "payout_outliers": _of_payouts(payouts.outliers, date(2000, 1, 1), date(2000, 6, 30), 1.5, 1.4),
    "payout_files_audit": lambda s, d: payouts.audit_files(_payout_files(s, d), ["unreconciled", "DISPUTED"]),
    "payout_files_totals": lambda s, d: payouts.file_totals(_payout_files(s, d)),
    "stream_dedupe": stream_dedupe,
    "stream_fact": stream_fact,
    "stream_monthly": stream_monthly,
    "landed_rows": lambda s, d: landing.snapshot(_tables(s, d)["account"].orderBy("account_id"), 200),
}
