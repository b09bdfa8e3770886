"""Vendor payouts: summaries, reconciliation and outliers, for all vendors at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import MONEY


def _sum(c: str = "amount") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def filtered(payouts: DataFrame, statuses: list[str] | None = None, category: str | None = None) -> DataFrame:
    """Payouts by reconciliation status (any of them, in any case) and part of a category's name."""
    if statuses:
        payouts = payouts.filter(F.lower("reconciliation_status").isin(*(s.lower() for s in statuses)))
    if category:
        payouts = payouts.filter(F.lower("category").contains(category.lower()))
    return payouts


def latest(payouts: DataFrame, vendors: DataFrame, n: int = 1) -> DataFrame:
    """Each vendor's last payouts."""
    order = Window.partitionBy("vendor_id").orderBy(F.desc("payout_date"), F.desc("amount"), "payout_key", "line", "status", "category")
    return payouts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).join(vendors, "vendor_id").select("vendor_name", "rank", "payout_date", "amount")


def vendor_summary(payouts: DataFrame, vendors: DataFrame) -> DataFrame:
    """Count, sum, average and span per vendor; aggregated before the join."""
    per = payouts.groupBy("vendor_id").agg(
        F.count("*").alias("payouts"), _sum().alias("total"), F.round(F.avg(F.col("amount").cast("double")), 2).alias("average"),
        F.min("payout_date").alias("first_date"), F.max("payout_date").alias("last_date"),
    )
    return per.join(vendors, "vendor_id").drop("vendor_id")


def top_vendors(payouts: DataFrame, vendors: DataFrame, k: int = 20) -> DataFrame:
    """The k vendors with the highest totals, with the total and number of all."""
    per = vendor_summary(payouts, vendors).select("vendor_name", "payouts", "total")
    whole = payouts.agg(_sum().alias("all_total"), F.count_distinct("vendor_id").alias("vendors"))
    return per.orderBy(F.desc("total"), "vendor_name").limit(k).crossJoin(F.broadcast(whole))


def audit(payouts: DataFrame, vendors: DataFrame, statuses: list[str], n: int = 50) -> DataFrame:
    """The newest payouts of some reconciliation statuses, with the number and sum of all such payouts."""
    rows = filtered(payouts, statuses)
    whole = rows.agg(F.count("*").alias("matches"), _sum().alias("match_total"))
    first = rows.join(vendors, "vendor_id").orderBy(F.desc("payout_date"), F.desc("amount"), "payout_key", "line", "vendor_name").limit(n)
    return first.select("payout_key", "line", "vendor_name", "payout_date", "amount", "reconciliation_status").crossJoin(F.broadcast(whole))


def audit_files(tables: dict[str, DataFrame], statuses: list[str], n: int = 50) -> DataFrame:
    """The newest transactions of some reconciliation statuses with their vendors, and the number and sum of all such.

    From the five files' tables. Transactions without a reconciliation or a vendor take no part.
    """
    wanted = filtered(tables["reconciliation_status"], statuses).select("transaction_id", "reconciliation_status", "notes")
    vendors = tables["vendor_list"].select("vendor_id", "vendor_name")
    rows = tables["transactions"].join(wanted, "transaction_id").join(vendors, "vendor_id")
    whole = rows.agg(F.count("*").alias("matches"), _sum().alias("match_total"))
    first = rows.orderBy(F.desc("transaction_date"), F.desc("amount"), "transaction_id").limit(n)
    return first.select("transaction_id", "vendor_name", "transaction_date", "amount", "reconciliation_status", "notes").crossJoin(F.broadcast(whole))


def file_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, rows, total): payouts by status, and transactions without a payout, from the five files' tables."""
    paid = tables["vendor_payouts"].groupBy(F.col("status").alias("what")).agg(F.count("*").alias("rows"), _sum().alias("total"))
    unpaid = tables["transactions"].filter("payout_id is null").agg(F.lit("no payout").alias("what"), F.count("*").alias("rows"), _sum().alias("total"))
    return paid.unionByName(unpaid)


def category_summary(payouts: DataFrame) -> DataFrame:
    return payouts.groupBy("category").agg(F.count("*").alias("payouts"), _sum().alias("total"))


def status_split(payouts: DataFrame) -> DataFrame:
    return payouts.groupBy("status").agg(F.count("*").alias("payouts"), _sum().alias("total"))


def monthly_change(payouts: DataFrame) -> DataFrame:
    """Per category and month the total and its change from the month before."""
    rows = payouts.groupBy("category", F.trunc("payout_date", "MM").alias("month")).agg(_sum().alias("total"))
    before = F.lag("total").over(Window.partitionBy("category").orderBy("month"))
    return rows.withColumn("change", (F.col("total") - before).cast(MONEY))


def outliers(payouts: DataFrame, vendors: DataFrame, start: date, end: date, deviations: float = 2.0, times: float = 1.8) -> DataFrame:
    """Payouts of a window far above what their vendor gets otherwise.

    Mean and deviation come from the payouts outside the window, or from all where fewer than two lie outside; an
    unknown deviation counts as 0.3 of the mean. One pass gathers both.
    """
    inside = F.col("payout_date").between(F.lit(start), F.lit(end))
    x = F.col("amount").cast("double")
    away = F.when(~inside, x)
    stats = payouts.groupBy("vendor_id").agg(
        F.count(away).alias("n_out"), F.avg(away).alias("mean_out"), F.stddev_samp(away).alias("sd_out"), F.count("*").alias("n_all"), F.avg(x).alias("mean_all"), F.stddev_samp(x).alias("sd_all")
    )
    enough = F.col("n_out") >= 2
    mean, sd = F.when(enough, F.col("mean_out")).otherwise(F.col("mean_all")), F.when(enough, F.col("sd_out")).otherwise(F.col("sd_all"))
    stats = stats.select("vendor_id", F.when(enough, F.col("n_out")).otherwise(F.col("n_all")).alias("n"), mean.alias("mean"), F.coalesce(sd, 0.3 * mean).alias("sd"))
    rows = payouts.filter(inside).join(stats, "vendor_id").join(vendors, "vendor_id")
    odd = rows.filter((x > F.col("mean") + deviations * F.col("sd")) & (x > times * F.col("mean")) & (F.col("n") >= 2))
    return odd.select("vendor_name", "payout_key", "line", "payout_date", "amount", F.round("mean", 2).alias("usual"), F.round(x / F.col("mean"), 1).alias("times"))


def listed(payouts: DataFrame, vendors: DataFrame, n: int = 50, statuses: list[str] | None = None, category: str | None = None) -> DataFrame:
    """The newest payouts that a filter lets through, with their number and sum over all that match."""
    rows = filtered(payouts, statuses, category)
    whole = rows.agg(F.count("*").alias("matches"), _sum().alias("match_total"))
    first = rows.join(vendors, "vendor_id").orderBy(F.desc("payout_date"), F.desc("amount"), "payout_key", "line", "vendor_name", "status", "category").limit(n)
    return first.select("payout_key", "line", "vendor_name", "payout_date", "amount", "status", "category").crossJoin(F.broadcast(whole))


def mentioned_vendors(texts: DataFrame, vendors: DataFrame, common: list[str] | None = None) -> DataFrame:
    """(text_id, vendor_id) of vendors with a distinctive word, of over four letters, in the text."""
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9#]+"), lambda w: (F.length(w) > 4) & ~w.isin(*(common or ["limited", "services", "company"])))))
    return texts.select("text_id", words("text").alias("w")).join(vendors.select("vendor_id", words("vendor_name").alias("w")), "w").select("text_id", "vendor_id").distinct()
