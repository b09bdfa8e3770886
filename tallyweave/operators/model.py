"""Fact, counterparty dimension, monthly rollup and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.privacy import blind_index
from ..terms import NOT_RANKED, UNKNOWN

MONEY = "decimal(25,2)"
#: Aliases and accounts are broadcast up to this many rows; beyond that the joins shuffle.
BROADCAST_ROWS = 200_000
FACT = [
    "transaction_id", "account_id", "entity_id", "transaction_date", "txn_month", "transaction_type", "transaction_amount",
    "description", "channel", "transaction_reference_id", "utr_number", "merchant_norm", "counterparty_kind", "kind_confidence",
]
#: The column with the blind index of the UTR number, in facts that are built with a pepper.
BLIND = "utr_blind_idx"


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows, else to be joined by shuffles, whatever Spark takes its size for.

    Spark takes exploded or highly compressed rows for far fewer bytes than they are, and would broadcast millions.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by shuffles: its size isn't known before it is there."""
    return df.hint("merge")


def fact(extracted: DataFrame, aliases: DataFrame, account: DataFrame, checked: bool = False, pepper: str | None = None) -> DataFrame:
    """One row per transaction with its counterparty and entity; rows without either stay.

    With ``checked`` the sizes of the small sides are counted first, and broadcast if they are small. With a ``pepper``
    the UTR number's blind index is a column too.
    """
    owner = account.select("account_id", "entity_id")
    if checked:
        aliases, owner = small(aliases), small(owner)
    rows = extracted.join(aliases, "merchant_raw", "left").join(owner, "account_id", "left")
    rows = rows.withColumns(
        {
            "merchant_norm": F.coalesce("merchant_norm", F.lit(UNKNOWN)),
            "counterparty_kind": F.coalesce("counterparty_kind", F.lit("unknown")),
            "kind_confidence": F.coalesce("kind_confidence", F.lit(0.0)),
        }
    )
    return rows.select(*FACT, *([blind_index(F.col("utr_number"), pepper).alias(BLIND)] if pepper else []))


def amount_if(condition: Column, amount: str = "transaction_amount") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(amount))), F.lit(0)).cast(MONEY)


def merchant_dim(fact: DataFrame) -> DataFrame:
    """Each entity's counterparties: kind, totals and active months."""
    return fact.groupBy("entity_id", "merchant_norm").agg(
        F.min("counterparty_kind").alias("counterparty_kind"),
        F.max("kind_confidence").alias("kind_confidence"),
        F.count("*").alias("txn_count"),
        amount_if(F.col("transaction_type") == "debit").alias("total_debit"),
        amount_if(F.col("transaction_type") == "credit").alias("total_credit"),
        F.min("txn_month").alias("first_month"),
        F.max("txn_month").alias("last_month"),
        F.count_distinct("txn_month").alias("active_months"),
    )


def dim_of_rollup(rollup: DataFrame, aliases: DataFrame) -> DataFrame:
    """The same dimension from the rollup, which is far smaller than the fact, and the names' confidence."""
    sure = aliases.groupBy("merchant_norm").agg(F.max("kind_confidence").alias("kind_confidence"))
    total = lambda way: F.coalesce(F.sum(F.when(F.col("transaction_type") == way, F.col("total_amount"))), F.lit(0)).cast(MONEY)
    per = rollup.groupBy("entity_id", "merchant_norm").agg(
        F.min("counterparty_kind").alias("counterparty_kind"), F.sum("txn_count").alias("txn_count"), total("debit").alias("total_debit"), total("credit").alias("total_credit"),
        F.min("txn_month").alias("first_month"), F.max("txn_month").alias("last_month"), F.count_distinct("txn_month").alias("active_months"),
    )
    per = per.join(sure, "merchant_norm", "left").withColumn("kind_confidence", F.coalesce("kind_confidence", F.lit(0.0)))
    return per.select("entity_id", "merchant_norm", "counterparty_kind", "kind_confidence", "txn_count", "total_debit", "total_credit", "first_month", "last_month", "active_months")


def rollup(fact: DataFrame) -> DataFrame:
    """Totals per entity, counterparty, kind, month and direction, with the days of the first and last transaction."""
    day = F.col("transaction_date").cast("date")
    return fact.groupBy("entity_id", "merchant_norm", "counterparty_kind", "txn_month", "transaction_type").agg(
        F.sum("transaction_amount").cast(MONEY).alias("total_amount"),
        F.count("*").alias("txn_count"),
        F.max("transaction_amount").alias("max_amount"),
        F.min(day).alias("min_date"),
        F.max(day).alias("max_date"),
    )


def coverage(fact: DataFrame) -> DataFrame:
    """Rows and value attributed to a counterparty, of all, in one row."""
    known = F.col("merchant_norm") != UNKNOWN
    return fact.agg(
        F.count("*").alias("txns"),
        F.count_if(known).alias("attributed"),
        F.sum("transaction_amount").cast(MONEY).alias("value"),
        amount_if(known).alias("attributed_value"),
        F.round(F.try_divide(F.count_if(known).cast("double"), F.count("*")), 6).alias("row_coverage"),
        F.round(F.try_divide(amount_if(known).cast("double"), F.sum("transaction_amount").cast("double")), 6).alias("value_coverage"),
    )


def coverage_by_kind(fact: DataFrame) -> DataFrame:
    """Transactions, names and share of each kind; the window is over one row per kind."""
    out = fact.groupBy("counterparty_kind").agg(F.count("*").alias("txns"), F.count_distinct("merchant_norm").alias("names"))
    return out.withColumn("share", F.round(100.0 * F.col("txns") / F.sum("txns").over(Window.partitionBy()), 4))


def ranked_counterparties(fact: DataFrame, direction: str, k: int, kind: str | None = None) -> DataFrame:
    """The k counterparties with the highest total, all entities together, excluded kinds removed unless one is named."""
    chosen = F.col("counterparty_kind") == kind if kind else ~F.col("counterparty_kind").isin(*NOT_RANKED)
    rows = fact.filter(chosen & (F.col("transaction_type") == direction)).groupBy("merchant_norm")
    return rows.agg(F.sum("transaction_amount").cast(MONEY).alias("total"), F.count("*").alias("txns")).orderBy(F.desc("total"), "merchant_norm").limit(k)


def anchor(fact: DataFrame) -> DataFrame:
    """The day of the last transaction, one row."""
    return fact.agg(F.max("transaction_date").cast("date").alias("anchor"))


ORACLE = """
fact AS (SELECT x.transaction_id, x.account_id, a.entity_id, x.transaction_date, x.txn_month, x.transaction_type, x.transaction_amount, x.description, x.channel,
                x.transaction_reference_id, x.utr_number, coalesce(l.merchant_norm, 'UNKNOWN') AS merchant_norm, coalesce(l.counterparty_kind, 'unknown') AS counterparty_kind,
                coalesce(l.kind_confidence, 0.0)::DOUBLE AS kind_confidence
         FROM extracted x LEFT JOIN alias l ON x.merchant_raw = l.merchant_raw LEFT JOIN account a ON x.account_id = a.account_id),
dim AS (SELECT entity_id, merchant_norm, min(counterparty_kind) AS counterparty_kind, max(kind_confidence) AS kind_confidence, count(*) AS txn_count,
               coalesce(sum(transaction_amount) FILTER (WHERE transaction_type = 'debit'), 0)::DECIMAL(25,2) AS total_debit,
               coalesce(sum(transaction_amount) FILTER (WHERE transaction_type = 'credit'), 0)::DECIMAL(25,2) AS total_credit,
               min(txn_month) AS first_month, max(txn_month) AS last_month, count(DISTINCT txn_month) AS active_months FROM fact GROUP BY entity_id, merchant_norm),
rollup_monthly AS (SELECT entity_id, merchant_norm, counterparty_kind, txn_month, transaction_type, sum(transaction_amount)::DECIMAL(25,2) AS total_amount, count(*) AS txn_count,
                          max(transaction_amount) AS max_amount, min(transaction_date)::DATE AS min_date, max(transaction_date)::DATE AS max_date
                   FROM fact GROUP BY entity_id, merchant_norm, counterparty_kind, txn_month, transaction_type)
"""
