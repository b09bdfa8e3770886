"""Accounts, balances, references and the numbers that a session starts with."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.privacy import blind_index, masked
from .model import BLIND, MONEY

#: Up to this many needles are conditions of the scan, which skip row groups by their Bloom filters; more are only joined.
LITERAL_NEEDLES = 64


def balances(account: DataFrame, bank: DataFrame, entity: str | None = None, account_id: str | None = None) -> DataFrame:
    """Accounts with masked numbers and their banks."""
    rows = account if entity is None else account.filter(F.col("entity_id") == entity)
    rows = rows if account_id is None else rows.filter(F.col("account_id") == account_id)
    return rows.join(bank, "bank_code", "left").select("entity_id", "account_id", masked(F.col("account_number")).alias("account_number"), "bank_name", "available_balance")


def balance_totals(account: DataFrame) -> DataFrame:
    return account.groupBy("entity_id").agg(F.count("*").alias("accounts"), F.sum("available_balance").cast(MONEY).alias("combined_balance"))


def primary_accounts(account: DataFrame, bank: DataFrame) -> DataFrame:
    """Each entity's account with the highest balance, the first id of equal ones."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("available_balance"), "account_id")
    first = account.withColumn("k", F.row_number().over(order)).filter("k = 1")
    return balances(first, bank)


def busiest(rollup: DataFrame, k: int = 1) -> DataFrame:
    """The entities with the most transactions."""
    return rollup.groupBy("entity_id").agg(F.sum("txn_count").alias("txns")).orderBy(F.desc("txns"), "entity_id").limit(k)


def narrowed(fact: DataFrame, needles: DataFrame, column: str) -> DataFrame:
    """``fact`` without the row groups that hold none of the needles in ``column``, if the needles are few.

    Equalities one by one, as a longer ``isin`` reaches the scan as a mere range, which no hash falls outside of.
    """
    found = [r[0] for r in needles.select(column).filter(F.col(column).isNotNull()).distinct().limit(LITERAL_NEEDLES + 1).collect()]
    if len(found) > LITERAL_NEEDLES:
        return fact
    return fact.filter(functools.reduce(operator.or_, (F.col(column) == x for x in found), F.lit(False)))


def owned(needles: DataFrame, account: DataFrame) -> DataFrame:
    """The (entity_id, account_id) pairs that exist."""
    return needles.join(account, ["entity_id", "account_id"], "left_semi")


def by_reference(fact: DataFrame, needles: DataFrame, limit: int = 50) -> DataFrame:
    """Per entity and reference of ``needles`` (reference): matches, their sum, and up to ``limit`` transactions."""
    near = narrowed(fact, needles.select(F.col("reference").alias("transaction_reference_id")), "transaction_reference_id")
    hits = near.join(needles, F.col("transaction_reference_id") == F.col("reference"), "inner")
    order = Window.partitionBy("entity_id", "reference").orderBy(F.desc("transaction_date"), "transaction_id")
    first = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    whole = hits.groupBy("entity_id", "reference").agg(F.count("*").alias("matches"), F.sum("transaction_amount").cast(MONEY).alias("match_total"))
    return first.join(whole, ["entity_id", "reference"]).select("entity_id", "reference", "rank", "transaction_id", "transaction_amount", "matches", "match_total")


def by_utr(fact: DataFrame, needles: DataFrame, pepper: str | None) -> DataFrame:
    """Transactions of the UTR numbers in ``needles`` (utr), compared as blind indexes; refused without a pepper.

    A fact built with this pepper has them stored, so only needles are hashed; for others all its rows are.
    """
    if not pepper:
        raise ValueError("UTR search needs a pepper")
    wanted = needles.select(blind_index(F.col("utr"), pepper).alias(BLIND)).distinct()
    if BLIND in fact.columns:
        rows = narrowed(fact, wanted, BLIND)
    else:
        rows = fact.filter("utr_number is not null").withColumn(BLIND, blind_index(F.col("utr_number"), pepper))
    return rows.join(wanted, BLIND).select("entity_id", "transaction_id", BLIND, "transaction_amount")
