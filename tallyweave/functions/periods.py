"""Period phrases as date windows: tokens are columns, rules are one projection, fixed tokens a joinable calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Synonyms of each canonical token (fixed values).
SYNONYMS = {
    "all_time": ["all", "all_time", "total", "lifetime", "ever", "overall", "any", "everything", "none"],
    "this_month": ["this_month", "current_month", "mtd", "month_to_date"],
    "last_month": ["last_month", "previous_month", "prev_month", "past_month", "prior_month", "the_last_month"],
    "two_months_ago": ["two_months_ago", "month_before_last", "month_before"],
    "this_quarter": ["this_quarter", "current_quarter", "qtd", "quarter_to_date"],
    "last_quarter": ["last_quarter", "previous_quarter", "past_quarter", "prior_quarter"],
    "q1": ["q1"],
    "q2": ["q2"],
    "q3": ["q3"],
    "q4": ["q4"],
    "ytd": ["ytd", "year_to_date", "this_year", "current_year"],
    "last_year": ["last_year", "previous_year", "past_year", "prior_year"],
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SUGGESTIONS = ["last_month", "last_3_months", "this_month", "ytd", "all_time"]
TOKENS = [t for t in SYNONYMS if t != "all_time"]


def token(phrase: Column) -> Column:
    """One spelling of a phrase: snake case, lower case."""
    s = F.regexp_replace(F.trim(phrase), "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[\s_-]+", "_"), "^_+|_+$", "")


def canonical(tok: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in SYNONYMS.items() for s in v for x in (s, k)))
    return F.try_element_at(table, tok)


def _month_number(name: Column) -> Column:
    keys = [(m, i) for i, m in enumerate(MONTHS, 1)] + [(m[:3], i) for i, m in enumerate(MONTHS, 1) if m != "may"] + [("sept", 9)]
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in keys for x in kv)), name)


def start_of(tok: Column, anchor: Column) -> Column:
    """First day of a fixed token's window; null for others."""
    month, quarter, year = F.trunc(anchor, "MM"), F.trunc(anchor, "quarter"), F.trunc(anchor, "year")
    out = F.when(tok == "this_month", month).when(tok == "last_month", F.add_months(month, -1)).when(tok == "two_months_ago", F.add_months(month, -2))
    out = out.when(tok == "this_quarter", quarter).when(tok == "last_quarter", F.add_months(quarter, -3))
    for i in range(4):
        out = out.when(tok == f"q{i + 1}", F.add_months(year, 3 * i))
    return out.when(tok == "ytd", year).when(tok == "last_year", F.add_months(year, -12))


def end_of(tok: Column, anchor: Column) -> Column:
    months = F.when(tok.isin("this_month", "last_month", "two_months_ago"), 1).when(tok.startswith("q") | tok.isin("this_quarter", "last_quarter"), 3).when(tok == "last_year", 12)
    return F.when(tok == "ytd", F.last_day(anchor)).otherwise(F.date_sub(F.add_months(start_of(tok, anchor), months), 1))


def aligned(start: Column, end: Column) -> Column:
    """Whether a window is whole months; no window at all counts as such."""
    return F.coalesce((F.dayofmonth(start) == 1) & (end == F.last_day(end)), F.lit(True))


def resolved(phrases: DataFrame, phrase: str, anchor: str) -> DataFrame:
    """``phrases`` with status, canonical, start, end and month_aligned of column ``phrase`` at date ``anchor``.

    Unknown phrases are UNRESOLVED, never all time; null and blank ones are ALL_TIME.
    """
    day, tok = F.col(anchor), F.col("__token")
    known = canonical(tok)
    n_months = F.regexp_extract(tok, r"^(?:last|past)_(\d{1,2})_months?$", 1).try_cast("int")
    n_days = F.regexp_extract(tok, r"^(?:last|past)_(\d{1,4})_days?$", 1).try_cast("int")
    year = F.regexp_extract(tok, r"^(?:(?:in|during|for|of|the|calendar|fy|year)_?)*((?:19|20)\d{2})$", 1).try_cast("int")
    month = _month_number(F.regexp_extract(tok, r"^([a-z]+)(?:_((?:19|20)\d{2}))?$", 1))
    month_year = F.coalesce(F.regexp_extract(tok, r"^[a-z]+_((?:19|20)\d{2})$", 1).try_cast("int"), F.year(day))
    month_start = F.make_date(month_year, month, F.lit(1))
    start = (
        F.when(known.isNotNull(), start_of(known, day))
        .when(n_months.between(1, 60), F.add_months(F.trunc(day, "MM"), 1 - n_months))
        .when(n_days.between(1, 3650), F.date_sub(day, n_days - 1))
        .when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1)))
        .when(month.isNotNull(), month_start)
    )
    end = (
        F.when(known.isNotNull(), end_of(known, day))
        .when(n_months.between(1, 60), F.last_day(day))
        .when(n_days.between(1, 3650), day)
        .when(year.isNotNull(), F.make_date(year, F.lit(12), F.lit(31)))
        .when(month.isNotNull(), F.last_day(month_start))
    )
    blank = F.coalesce(F.trim(F.col(phrase)) == "", F.lit(True))
    status = F.when(blank | (known == "all_time"), "ALL_TIME").when(F.col("start").isNotNull(), "RESOLVED").otherwise("UNRESOLVED")
    rows = phrases.withColumn("__token", token(F.col(phrase))).withColumns({"start": start, "end": end})
    rows = rows.withColumns(
        {
            "status": status,
            "canonical": F.when(blank, "all_time").when(status == "UNRESOLVED", None).otherwise(F.coalesce(known, tok)),
            "month_aligned": F.when(status != "UNRESOLVED", aligned(F.col("start"), F.col("end"))),
        }
    )
    return rows.drop("__token")


def absolute(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Windows of two written days: swapped if inverted, UNRESOLVED if malformed."""
    good = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col(c), "yyyy-MM-dd"))
    rows = rows.withColumns({"__a": good(start), "__b": good(end)})
    fine = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    rows = rows.withColumns(
        {
            "status": F.when(fine, "RESOLVED").otherwise("UNRESOLVED"),
            "window_start": F.when(fine, F.least("__a", "__b")),
            "window_end": F.when(fine, F.greatest("__a", "__b")),
        }
    )
    return rows.drop("__a", "__b")


def previous(start: Column, end: Column) -> tuple[Column, Column]:
    """The window of equal length just before: whole months if aligned, else days."""
    months = F.round(F.months_between(F.date_add(end, 1), start)).cast("int")
    days = F.datediff(end, start) + 1
    return F.when(aligned(start, end), F.add_months(start, -months)).otherwise(F.date_sub(start, days)), F.date_sub(start, 1)


def same_window(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two windows are one; no window at all is like itself."""
    return a_start.eqNullSafe(b_start) & a_end.eqNullSafe(b_end)


def suggestions(status: Column) -> Column:
    """What may be asked instead of a phrase that isn't understood."""
    return F.when(status == "UNRESOLVED", F.array(*map(F.lit, SUGGESTIONS)))


def calendar(anchors: DataFrame) -> DataFrame:
    """(anchor, token, start, end, month_aligned) for each anchor day and fixed token."""
    rows = anchors.select("anchor", F.explode(F.array(*map(F.lit, TOKENS))).alias("token"))
    rows = rows.withColumns({"start": start_of(F.col("token"), F.col("anchor")), "end": end_of(F.col("token"), F.col("anchor"))})
    return rows.withColumn("month_aligned", aligned(F.col("start"), F.col("end")))


def window_of(spark: SparkSession, phrase: str | None, anchor: object) -> tuple[object, object, str, bool]:
    """(start, end, status, month_aligned) of one phrase."""
    row = resolved(spark.createDataFrame([(phrase, anchor)], "phrase string, anchor date"), "phrase", "anchor").first()
    return row["start"], row["end"], row["status"], row["month_aligned"]
