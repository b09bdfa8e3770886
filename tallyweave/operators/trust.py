"""Grounding of figures in answers, answer sentences, and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIGURE = r"\d(?:[\d,]*\d)?(?:\.\d+)?"
#: Bands of confidence, and the largest integer that needs no ground (fixed values).
HIGH, MEDIUM, FREE_UP_TO = 0.88, 0.72, 3000


def figures(answers: DataFrame) -> DataFrame:
    """(answer_id, figure, value) of the numbers in each answer (answer_id, text)."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FIGURE), F.lit(0))))
    rows = answers.select("answer_id", found.alias("figure"))
    return rows.withColumn("value", F.regexp_replace("figure", ",", "").try_cast("double")).filter("value is not null")


def allowed(facts: DataFrame) -> DataFrame:
    """(answer_id, value): the facts (answer_id, value) as they may be written, rounded to two places or none."""
    x = F.abs(F.col("value").cast("double"))
    return facts.select("answer_id", F.explode(F.array(F.round(x, 2), F.round(x, 0))).alias("value")).distinct()


def grounded(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer_id, grounded, offending): whether every figure of an answer is a fact or a small integer."""
    small = (F.col("value") == F.floor("value")) & (F.col("value") <= FREE_UP_TO)
    bad = figures(answers).filter(~small).withColumn("value", F.round("value", 2)).join(allowed(facts), ["answer_id", "value"], "left_anti")
    bad = bad.groupBy("answer_id").agg(F.array_sort(F.collect_list("figure")).alias("offending"))
    out = answers.select("answer_id").join(bad, "answer_id", "left")
    return out.select("answer_id", F.col("offending").isNull().alias("grounded"), F.coalesce("offending", F.array().cast("array<string>")).alias("offending"))


def money(value: Column, symbol: str = "₹") -> Column:
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit(symbol), F.format_number(F.abs(value.cast("double")), 2))


def spend_sentence(total: Column, txns: Column, direction: Column, merchant: Column) -> Column:
    """Answer to a spend question from its facts."""
    verb = F.when(direction == "credit", "received").otherwise("spent")
    place = F.when(merchant.isNotNull(), F.concat(F.when(direction == "credit", " from ").otherwise(" on "), merchant)).otherwise("")
    return F.when(txns > 0, F.concat(F.lit("You "), verb, F.lit(" "), money(total), place, F.lit(" in "), txns.cast("string"), F.lit(" transactions."))).otherwise(F.concat(F.lit("No transactions"), place, F.lit(".")))


def amounts_written(answers: DataFrame, facts: DataFrame, symbol: str = "₹") -> DataFrame:
    """(answer_id, text): figures of 1,000 or more that are facts are written as money, others stay as they are."""
    found = figures(answers).filter("value >= 1000").withColumn("value", F.round("value", 2)).join(allowed(facts), ["answer_id", "value"], "left_semi")
    pairs = F.sort_array(F.collect_list(F.struct(F.length("figure").alias("n"), "figure", money(F.col("value"), symbol).alias("written"))), False)
    out = answers.join(found.groupBy("answer_id").agg(pairs.alias("pairs")), "answer_id", "left")
    whole = lambda p: F.concat(F.lit(r"(?:₹\s*)?(?<![\d.,])\Q"), p["figure"], F.lit(r"\E(?![\d]|[.,]\d)"))
    text = F.aggregate("pairs", F.col("text"), lambda t, p: F.regexp_replace(t, whole(p), p["written"]))
    return out.select("answer_id", F.when(F.col("pairs").isNull(), F.col("text")).otherwise(text).alias("text"))


def figures_of(rows: DataFrame, key: str = "answer_id") -> DataFrame:
    """(answer_id, value): every number in any column of ``rows``, as facts that answers may quote."""
    numeric = [f.name for f in rows.schema if f.name != key and f.dataType.typeName() in ("decimal", "double", "float", "long", "integer", "short", "byte")]
    return rows.select(F.col(key).alias("answer_id"), F.explode(F.array(*(F.col(c).cast("double") for c in numeric))).alias("value")).filter("value is not null")


def _counted(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {what}").otherwise(f" {what}s"))


def sentence(kind: str) -> Column:
    """Answer to a question of a kind, from the columns that its operator returns."""
    c, s = F.col, F.concat
    forms = {
        "spend": lambda: spend_sentence(c("total"), c("txns"), F.lit("debit"), F.lit(None).cast("string")),
        "monthly": lambda: s(F.lit("Your highest month was "), F.date_format("top_month", "MMMM yyyy"), F.lit(" with "), money(c("top_total")), F.lit(", the lowest "), F.date_format("low_month", "MMMM yyyy"), F.lit(" with "), money(c("low_total")), F.lit(".")),
        "rank": lambda: s(F.lit("Number "), c("rank").cast("string"), F.lit(" is "), c("merchant_norm"), F.lit(" with "), money(c("total")), F.lit(" of "), money(c("all_total")), F.when(c("truncated"), s(F.lit(", of "), c("groups").cast("string"), F.lit(" in all"))).otherwise(""), F.lit(".")),
        "compare": lambda: s(F.lit("It was "), money(c("later")), F.lit(" after "), money(c("earlier")), F.when(c("delta") < 0, ", a fall of ").otherwise(", a rise of "), money(F.abs(c("delta"))), F.when(c("pct_change").isNotNull(), s(F.lit(" ("), c("pct_change").cast("string"), F.lit(" %)"))).otherwise(""), F.lit(".")),
        "list": lambda: s(_counted(c("matches"), "transaction"), F.lit(" of "), money(c("match_total")), F.when(c("truncated"), ", the first of them shown").otherwise(""), F.lit(".")),
        "threshold": lambda: s(_counted(c("matches"), "transaction"), F.lit(" above the amount, "), money(c("match_total")), F.lit(" together.")),
        "extreme": lambda: s(money(c("transaction_amount")), F.lit(" at "), c("merchant_norm"), F.lit(" on "), F.date_format("transaction_date", "yyyy-MM-dd"), F.lit(".")),
        "balances": lambda: s(_counted(c("accounts"), "account"), F.lit(" with "), money(c("combined_balance")), F.lit(" together.")),
        "sql": lambda: s(F.lit("The "), c("column"), F.lit(" of "), _counted(c("n"), "row"), F.lit(" adds up to "), money(c("sum")), F.lit(", at most "), money(c("max")), F.lit(".")),
    }
    return forms[kind]()


def confidence(resolution: Column, assumed_period: Column, unattributed: Column, rejected: Column, adhoc: Column) -> Column:
    """Product of what weakens an answer, from 0 to 1."""
    lost = F.when(unattributed > 0.02, 1 - unattributed).otherwise(1.0)
    score = resolution * F.when(assumed_period, 0.92).otherwise(1.0) * lost * F.when(rejected, 0.85).otherwise(1.0) * F.when(adhoc, 0.85).otherwise(1.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low")


def reasons(resolution: Column, assumed_period: Column, unattributed: Column, rejected: Column, adhoc: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(resolution < 1, "name matched inexactly"), F.when(assumed_period, "period assumed"), F.when(unattributed > 0.02, "some transactions unattributed"),
            F.when(rejected, "written answer rejected"), F.when(adhoc, "ad-hoc query"),
        )
    )


def scorecard(results: DataFrame) -> DataFrame:
    """Pass rate, failures, median and longest time per run of labelled cases (run, passed, ms)."""
    return results.groupBy("run").agg(
        F.count("*").alias("cases"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.count_if(~F.col("passed")).alias("failures"),
        F.percentile("ms", F.lit(0.5)).alias("p50_ms"), F.max("ms").alias("max_ms"),
    )
