"""Reconciliation of landed rows, fact and rollup, and checks of the derived names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import _SUFFIX
from ..terms import BRANDS, FEE_LABEL, KINDS, SELF_LABEL
from .model import MONEY


def _check(name: str, bad: Column, df: DataFrame) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.coalesce(bad, F.lit(0)).cast("bigint").alias("found"))


def entity_differences(fact: DataFrame, rollup: DataFrame) -> DataFrame:
    """Entities whose totals differ by more than a cent between fact and rollup; both sides are aggregated first."""
    a = fact.groupBy("entity_id").agg(F.sum("transaction_amount").cast(MONEY).alias("fact_total"), F.count("*").alias("fact_count"))
    b = rollup.groupBy(F.col("entity_id").alias("entity_b")).agg(F.sum("total_amount").cast(MONEY).alias("rollup_total"), F.sum("txn_count").alias("rollup_count"))
    both = a.join(b, F.col("entity_id").eqNullSafe(F.col("entity_b")), "full").select(F.coalesce("entity_id", "entity_b").alias("entity_id"), "fact_total", "rollup_total", "fact_count", "rollup_count")
    difference = F.abs(F.coalesce("fact_total", F.lit(0)) - F.coalesce("rollup_total", F.lit(0)))
    return both.filter((difference > 0.01) | ~F.col("fact_count").eqNullSafe(F.col("rollup_count")))


def report(transactions: DataFrame, fact: DataFrame, rollup: DataFrame, dim: DataFrame, bank: DataFrame) -> DataFrame:
    """(check, found): how many rows break each rule; 0 everywhere is right."""
    brands = list(BRANDS)
    duplicated = fact.groupBy("transaction_id").count().filter("count > 1")
    unlike = (F.col("merchant_norm").isin(FEE_LABEL, SELF_LABEL)) & (F.col("counterparty_kind") == "merchant")
    present = fact.select("counterparty_kind").distinct()
    parts = [
        _check("rows_missing_from_fact", F.count("*"), transactions.join(fact, "transaction_id", "left_anti")),
        _check("entities_that_differ", F.count("*"), entity_differences(fact, rollup)),
        _check("rows_without_entity", F.count_if(F.col("entity_id").isNull()), fact),
        _check("duplicate_keys", F.count("*"), duplicated),
        _check("brands_not_folded", F.count_if(F.col("merchant_norm").isin(*brands)), dim),
        _check("legal_forms_left", F.count_if(F.col("merchant_norm").rlike(_SUFFIX)), dim),
        _check("sentinels_as_merchants", F.count_if(unlike), dim),
        _check("kinds_missing", F.lit(len(KINDS)) - F.count("*"), present),
        _check("bank_codes_as_names", F.count("*"), bank.join(dim, F.upper("bank_code") == F.col("merchant_norm"), "left_semi")),
        _check("coverage_below_90_percent", F.when(F.count_if(F.col("merchant_norm") != "UNKNOWN") < 0.9 * F.count("*"), 1).otherwise(0), fact),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
