"""Narration, names, periods, similarity, privacy, questions and trust: values, row by row."""

from __future__ import annotations

import hashlib
import hmac
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import names, narration, periods, privacy, questions, similarity
from tallyweave.operators import trust

ANCHOR = date(2026, 6, 24)


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_narration(spark):
    cases = [
        ("UPI-TATA POWER-XXXXXX9300-HDFC0009348-...", "UPI", "TATA POWER"),
        ("IMPS/P2A/6000/HDFC/9180/00/INET/2960/NAVYUG SELECTION/ZBFL/INWD48", "IMPS", "NAVYUG SELECTION"),
        ("IMPS OW/5076/Divya Reddy/SBIN/4329", "IMPS", "Divya Reddy"),
        ("NEFT  - ICIC0005218 - 95595159 - 9150 - LENSKART LIMITED", "NEFT", "LENSKART LIMITED"),
        ("FT -  95380307 -  50200014109376 - FLIPKART   VIMAN NAGAR", "FT", "FLIPKART"),
        ("R/SBINR5588058/ZBFLCTP405PBL88063//BIGBASKET LIMITED/REF8116", "RTGS", "BIGBASKET LIMITED"),
        ("TRF/27964914/15335598", "OTHER", None),
        ("IMPS charges", "CHARGE", "__BANK_CHARGE__"),
        ("FT - SELF - 50200013729069 - SELF TRANSFER", "FT", "__SELF_TRANSFER__"),
        ("IMPS OW/5076/Al Roy/SBIN/4329", "IMPS", "Al Roy"),
        ("UPI-PREPAID RECHARGE-XXXXXX12", "UPI", "PREPAID RECHARGE"),
        (None, "OTHER", None),
        ("", "OTHER", None),
    ]
    rows = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)], "i int, description string, transaction_date timestamp_ntz")
    bank = spark.createDataFrame([("HDFC",), ("SBIN",), (None,)], "bank_code string")
    got = narration.extracted(rows, bank).orderBy("i").collect()
    assert [(r.channel, r.merchant_raw) for r in got] == [c[1:] for c in cases]


def test_names(spark):
    cases = {
        "ZOMATO PRIVATE LIMITED": "ZOMATO", "Zomato Ltd": "ZOMATO", "  zomato  ": "ZOMATO", "NYKAA LIMITED": "NYKAA", "AIRTEL LTD": "AIRTEL",
        "SELECTION ELECTRONICS": "SELECTION ELECTRONICS", "FOO INDIA PVT LTD": "FOO", "LIMITED": "LIMITED", "ACME X12": "ACME",
    }
    assert column(spark, list(cases), names.normalised) == list(cases.values())


@pytest.mark.parametrize("phrase", ["last_month", "previous_month", "past_month", "prior_month", "last month", "Last Month", "last-month", "LAST_MONTH", "  last_month  ", "lastMonth"])
def test_last_month(spark, phrase):
    assert periods.window_of(spark, phrase, ANCHOR) == (date(2026, 5, 1), date(2026, 5, 31), "RESOLVED", True)


def test_periods(spark):
    cases = {
        "last 3 months": (date(2026, 4, 1), date(2026, 6, 30), "RESOLVED", True),
        "last_30_days": (date(2026, 5, 26), date(2026, 6, 24), "RESOLVED", False),
        "2026": (date(2026, 1, 1), date(2026, 12, 31), "RESOLVED", True),
        "year_2026": (date(2026, 1, 1), date(2026, 12, 31), "RESOLVED", True),
        "in 2026": (date(2026, 1, 1), date(2026, 12, 31), "RESOLVED", True),
        "the year 2025": (date(2025, 1, 1), date(2025, 12, 31), "RESOLVED", True),
        "fy2026": (date(2026, 1, 1), date(2026, 12, 31), "RESOLVED", True),
        "ytd": (date(2026, 1, 1), date(2026, 6, 30), "RESOLVED", True),
        "last quarter": (date(2026, 1, 1), date(2026, 3, 31), "RESOLVED", True),
        "q4": (date(2026, 10, 1), date(2026, 12, 31), "RESOLVED", True),
        "april": (date(2026, 4, 1), date(2026, 4, 30), "RESOLVED", True),
        "feb_2024": (date(2024, 2, 1), date(2024, 2, 29), "RESOLVED", True),
    }
    for phrase in ["trailing_month", "sometime", "last_99_months", "fortnight", "q9"]:
        cases[phrase] = (None, None, "UNRESOLVED", None)
    for phrase in ["", "all", "total"]:
        cases[phrase] = (None, None, "ALL_TIME", True)
    rows = spark.createDataFrame([(p, ANCHOR) for p in [*cases, None]], "phrase string, anchor date")
    got = {r.phrase: (r.start, r.end, r.status, r.month_aligned) for r in periods.resolved(rows, "phrase", "anchor").collect()}
    assert got == cases | {None: (None, None, "ALL_TIME", True)}


def test_windows_before_and_absolute(spark):
    rows = spark.createDataFrame([(0, date(2026, 4, 1), date(2026, 6, 30)), (1, date(2026, 5, 1), date(2026, 5, 31)), (2, date(2026, 5, 26), date(2026, 6, 24))], "i int, s date, e date")
    a, b = periods.previous(F.col("s"), F.col("e"))
    got = [tuple(r)[1:] for r in rows.select("i", a, b).orderBy("i").collect()]
    assert got == [(date(2026, 1, 1), date(2026, 3, 31)), (date(2026, 4, 1), date(2026, 4, 30)), (date(2026, 4, 26), date(2026, 5, 25))]
    rows = spark.createDataFrame([("2026-05-31", "2026-05-01"), ("05/01/2026", "05/31/2026")], "a string, b string")
    got = [(r.status, r.window_start, r.window_end) for r in periods.absolute(rows, "a", "b").collect()]
    assert got == [("RESOLVED", date(2026, 5, 1), date(2026, 5, 31)), ("UNRESOLVED", None, None)]


def test_similarity(spark):
    assert round(similarity.ratio("SWIGY", "SWIGGY"), 2) == 90.91
    assert similarity.token_set_ratio("SELECTION", "SELECTION ELECTRONICS") == 100
    assert similarity.token_set_ratio("B A", "A B") == 100
    assert similarity.ratio("", "") == 100 and similarity.token_set_ratio("", "A") == 0

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in [("ABCBDAB", "BDCABA"), ("X", "Y"), ("HELLO WORLD", "WORLD HELLO"), ("AAAA", "AA")]:
        assert similarity.ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def test_privacy(spark):
    assert column(spark, ["123456789", "1234", "12", None], privacy.masked) == ["XXXXX6789", "XXXX", "XX", ""]
    assert column(spark, ["pay 123456789012 now", "12345678", None], privacy.redacted) == ["pay [REDACTED] now", "12345678", None]
    want = [hmac.new(b"pepper", v.strip().upper().encode(), hashlib.sha256).hexdigest() for v in ("utr1", " UTR1 ", "x")]
    assert column(spark, ["utr1", " UTR1 ", "x"], lambda c: privacy.blind_index(c, "pepper")) == want
    long = "k" * 100
    assert column(spark, ["a"], lambda c: privacy.blind_index(c, long)) == [hmac.new(long.encode(), b"A", hashlib.sha256).hexdigest()]
    assert column(spark, ["a"], lambda c: privacy.blind_index(c, None)) == [None]


def test_questions(spark):
    texts = ["how much did my friend pay me", "what did I spend last month", "transactions over two lakh", "above 2.5 crore", "more than 50,000", "hello"]
    assert column(spark, texts, questions.direction) == ["credit", "debit", None, None, None, None]
    assert column(spark, texts, questions.threshold) == [None, None, 200000.0, 25000000.0, 50000.0, None]
    texts = ["in 2026", "past 4 months", "last 10 days", "THIS month", "q3 please", "in April", "so far", "nothing"]
    assert column(spark, texts, questions.period) == ["year_2026", "last_4_months", "last_10_days", "this_month", "q3", "april", "all_time", None]
    texts = ["the 3 months before", "the three months before that", "last month", "the previous 3 months", "April", "the same period last year"]
    other = ["SWIGGY", "Swiggy Ltd", "UBER", "Last Mile Logistics", "Monthly Gym", "Gautam Singh", "SELECTION ELECTRONICS"]
    assert column(spark, texts + other, questions.is_period) == [True] * len(texts) + [False] * len(other)
    texts = ["show my balances", "compare it", "which month was highest", "over one lakh", "lowest payment", "top vendors", "first transaction in 2026", "last 7 transactions", "show me all", "how much on uber"]
    got = column(spark, texts, questions.intent)
    assert [r.intent for r in got] == ["balances", "compare", "monthly", "threshold", "extreme", "rank", "recent", "recent", "list", "spend"]
    assert [(got[i].ascending, got[i].n) for i in (4, 6, 7)] == [(True, 1), (True, 1), (False, 7)]
    assert column(spark, ["what about April?", "and uber", "in general, this", "spend on uber"], questions.follows) == [True, True, False, False]


def test_bands_and_grounding(spark):
    scores = spark.createDataFrame([(1.0,), (0.80,), (0.70,), (0.85 * 0.92 * 0.90,)], "s double")
    assert [r[0] for r in scores.select(trust.band(F.col("s"))).collect()] == ["High", "Medium", "Low", "Low"]
    answers = spark.createDataFrame([(1, "You spent 1,234.50 in 3 transactions"), (2, "You spent 9,999.99"), (3, "No figures"), (4, "About 1235")], "answer_id int, text string")
    facts = spark.createDataFrame([(1, 1234.5), (2, 1234.5), (4, -1234.5)], "answer_id int, value double")
    got = {r.answer_id: (r.grounded, r.offending) for r in trust.grounded(answers, facts).collect()}
    assert got == {1: (True, []), 2: (False, ["9,999.99"]), 3: (True, []), 4: (True, [])}


def test_legal_forms_and_marks_as_the_plain_patterns_find_them(spark):
    """Names and narrations at the edges of the cheap tests, against the patterns alone; names are told by their last letters first."""
    texts = ["A LTD", "A LTD.", "A PVT. LTD. . ", "LTD", "A,LTD,", "X&CO", "MICO", "A CO INDIA PVT LTD", "A LIMITED LTD LLP INC", "acorp", "", "A.", "my own account", "PRE/SELF/X", "- Self - x", "surcharges", "GST on fee", "gst once", "penalty.", "min bal"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = F.trim(F.regexp_replace(F.trim(F.upper("t")), r"[^A-Z0-9 &.'-]", " "))
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s+[A-Z]{0,4}\d[A-Z0-9]*$", ""), r"\s+", " "))
    for _ in range(3):
        plain = F.regexp_replace(plain, names._NAMED, "$1")
    fee = F.lower("t").rlike(narration._any(narration.FEE_MARKS, True))
    own = F.lower("t").rlike(narration._any(narration.SELF_MARKS, False))
    got = rows.select("t", names.normalised(F.col("t")).alias("a"), plain.alias("b"), narration.is_fee(F.col("t")).alias("c"), fee.alias("d"), narration.is_self(F.col("t")).alias("e"), own.alias("f"))
    for r in got.collect():
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f), r
    assert "endswith" in str(names.normalised(F.col("t"))).lower()
