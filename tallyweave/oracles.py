"""The ledger queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .functions import narration, periods
from .functions.names import _SUFFIX
from .operators import model, vocabulary
from .queries import BEFORE, DAYS, LAST, PEPPER, Q1, Q2
from .sources import ledger
from .terms import LEGAL

_BASE = f"WITH {ledger.ORACLE},\n{narration.ORACLE},\n{vocabulary.ORACLE},\n{model.ORACLE}\n"
_TXN = f"WITH {ledger.ORACLE}\n"
_PAY = f"WITH {ledger.PAYOUTS_ORACLE}\n"


def _days(w: tuple, c: str) -> str:
    return f"{c} BETWEEN DATE '{w[0]}' AND DATE '{w[1]}'"


def _spend(where: str) -> str:
    return f"""{_BASE} SELECT entity_id, sum(total_amount)::DECIMAL(25,2) AS total, sum(txn_count)::BIGINT AS txns, count(DISTINCT merchant_norm) AS merchants,
        min(min_date) AS first_day, max(max_date) AS last_day, round(sum(total_amount)::DOUBLE / sum(txn_count), 2) AS average FROM rollup_monthly WHERE {where} GROUP BY entity_id"""


def _by(key: str, where: str) -> str:
    return f"{_BASE} SELECT entity_id, {key}, sum(total_amount)::DECIMAL(25,2) AS total, sum(txn_count)::BIGINT AS txns FROM rollup_monthly WHERE {where} GROUP BY entity_id, {key}"


def _top(where: str, k: int, excluded: str = "counterparty_kind IN ('bank_charge', 'self_transfer', 'unknown')") -> str:
    return f"""{_BASE}, per AS (SELECT entity_id, merchant_norm, min(counterparty_kind) AS counterparty_kind, sum(total_amount)::DECIMAL(25,2) AS total, sum(txn_count)::BIGINT AS txns,
            bool_and({excluded}) AS excluded FROM rollup_monthly WHERE {where} GROUP BY entity_id, merchant_norm),
        whole AS (SELECT entity_id, coalesce(sum(total) FILTER (WHERE NOT excluded), 0)::DECIMAL(25,2) AS all_total, count(*) FILTER (WHERE NOT excluded) AS groups,
            coalesce(sum(total) FILTER (WHERE excluded), 0)::DECIMAL(25,2) AS excluded_total FROM per GROUP BY entity_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY total DESC, merchant_norm)::INTEGER AS rank FROM per WHERE NOT excluded)
        SELECT r.entity_id, rank, merchant_norm, counterparty_kind, total, txns, all_total, groups, groups > {k} AS truncated, excluded_total
        FROM ranked r JOIN whole w ON r.entity_id = w.entity_id WHERE rank <= {k}"""


def _listing(where: str, order: str, k: int) -> str:
    return f"""{_BASE}, rows AS (SELECT * FROM fact WHERE {where}),
        whole AS (SELECT entity_id, count(*) AS matches, sum(transaction_amount)::DECIMAL(25,2) AS match_total FROM rows GROUP BY entity_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {order}, transaction_date DESC, transaction_id)::INTEGER AS rank FROM rows)
        SELECT r.entity_id, rank, transaction_id, transaction_date, transaction_type, merchant_norm, transaction_amount, matches, match_total, matches > {k} AS truncated
        FROM ranked r JOIN whole w ON r.entity_id = w.entity_id WHERE rank <= {k}"""


def _extreme(order: str) -> str:
    return f"""{_BASE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY transaction_amount {order}, transaction_date DESC, transaction_id DESC) AS k FROM fact WHERE transaction_type = 'debit')
        SELECT entity_id, transaction_id, transaction_date, merchant_norm, transaction_amount FROM ranked WHERE k = 1"""


def _compare(a: tuple, b: tuple, more: str = "") -> str:
    (a, b) = sorted([a, b])
    return f"""{_BASE}, per AS (SELECT entity_id, coalesce(sum(total_amount) FILTER (WHERE {_days(a, "txn_month")}), 0)::DECIMAL(25,2) AS earlier,
            coalesce(sum(total_amount) FILTER (WHERE {_days(b, "txn_month")}), 0)::DECIMAL(25,2) AS later FROM rollup_monthly
            WHERE transaction_type = 'debit' {more} AND ({_days(a, "txn_month")} OR {_days(b, "txn_month")}) GROUP BY entity_id)
        SELECT entity_id, earlier, later, (later - earlier)::DECIMAL(25,2) AS delta, round((later - earlier)::DOUBLE * 100.0 / nullif(earlier::DOUBLE, 0), 1) AS pct_change,
            (later + earlier)::DECIMAL(25,2) AS combined FROM per"""


_DEBIT = "transaction_type = 'debit'"
_MASK = "CASE WHEN {c} IS NULL THEN '' WHEN length({c}) <= 4 THEN repeat('X', length({c})) ELSE repeat('X', length({c}) - 4) || right({c}, 4) END"
_TOKENS = ", ".join(f"'{t}'" for t in periods.TOKENS)
_MONTH, _QUARTER, _YEAR = (f"CAST(date_trunc('{u}', anchor) AS DATE)" for u in ("month", "quarter", "year"))


def _plus(d: str, months: int) -> str:
    return f"CAST({d} + INTERVAL '{months} months' AS DATE)" if months >= 0 else f"CAST({d} - INTERVAL '{-months} months' AS DATE)"


_START = f"""CASE token WHEN 'this_month' THEN {_MONTH} WHEN 'last_month' THEN {_plus(_MONTH, -1)} WHEN 'two_months_ago' THEN {_plus(_MONTH, -2)}
    WHEN 'this_quarter' THEN {_QUARTER} WHEN 'last_quarter' THEN {_plus(_QUARTER, -3)} WHEN 'q1' THEN {_YEAR} WHEN 'q2' THEN {_plus(_YEAR, 3)} WHEN 'q3' THEN {_plus(_YEAR, 6)}
    WHEN 'q4' THEN {_plus(_YEAR, 9)} WHEN 'ytd' THEN {_YEAR} WHEN 'last_year' THEN {_plus(_YEAR, -12)} END"""
_CALENDAR = f"""WITH anchors AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS anchor FROM orders),
    tokens AS (SELECT anchor, unnest([{_TOKENS}]) AS token FROM anchors),
    started AS (SELECT anchor, token, {_START} AS s FROM tokens),
    cal AS (SELECT anchor, token, s AS "start", CAST(CASE WHEN token IN ('this_month', 'last_month', 'two_months_ago') THEN s + INTERVAL '1 months' WHEN token = 'last_year' THEN s + INTERVAL '12 months'
        WHEN token = 'ytd' THEN CAST(date_trunc('month', anchor) AS DATE) + INTERVAL '1 months' ELSE s + INTERVAL '3 months' END - INTERVAL '1 days' AS DATE) AS "end" FROM started)
"""
_QUARTERS = {f"q{i + 1}": (_plus(_YEAR, 3 * i), _plus(_YEAR, 3 * i + 3)) for i in range(4)}
_LAST_MONTH, _NEXT = (_plus(_MONTH, -1), _MONTH), _plus(_MONTH, 1)
#: Canonical form, first day and the day after the last of each phrase; no days for all time, no form for unknown ones.
_PHRASES = {
    "last month": ("last_month", *_LAST_MONTH), "lastMonth": ("last_month", *_LAST_MONTH), " LAST-MONTH ": ("last_month", *_LAST_MONTH), "prior_month": ("last_month", *_LAST_MONTH),
    "this quarter": ("this_quarter", _QUARTER, _plus(_QUARTER, 3)), "q1": ("q1", *_QUARTERS["q1"]), "q9": (None,), "ytd": ("ytd", _YEAR, _NEXT),
    "last 3 months": ("last_3_months", _plus(_MONTH, -2), _NEXT), "last_30_days": ("last_30_days", "anchor - 29", "anchor + 1"), "past_2_months": ("past_2_months", _plus(_MONTH, -1), _NEXT),
    "last_99_months": (None,), "2000": ("2000", "DATE '2000-01-01'", "DATE '2001-01-01'"), "fy2001": ("fy2001", "DATE '2001-01-01'", "DATE '2002-01-01'"),
    "in 2000": ("in_2000", "DATE '2000-01-01'", "DATE '2001-01-01'"), "the year 1999": ("the_year_1999", "DATE '1999-01-01'", "DATE '2000-01-01'"),
    "april": ("april", _plus(_YEAR, 3), _plus(_YEAR, 4)), "feb_2000": ("feb_2000", "DATE '2000-02-01'", "DATE '2000-03-01'"), "total": ("all_time",), "": ("all_time",), "fortnight": (None,),
    "last year": ("last_year", _plus(_YEAR, -12), _YEAR), "month before last": ("two_months_ago", _plus(_MONTH, -2), _plus(_MONTH, -1)), "q4": ("q4", *_QUARTERS["q4"]),
}


def _phrase(phrase: str, form: str | None, start: str = "NULL", after: str = "NULL") -> str:
    status = "RESOLVED" if start != "NULL" else "ALL_TIME" if form else "UNRESOLVED"
    whole = "NULL::BOOLEAN" if form is None else "true" if start == "NULL" else f"day({start}) = 1 AND day({after}) = 1"
    return f"""SELECT anchor, '{phrase}' AS phrase, '{status}' AS status, {f"'{form}'" if form else "NULL::VARCHAR"} AS canonical,
        CAST({start} AS DATE) AS "start", CAST({after} AS DATE) - 1 AS "end", {whole} AS month_aligned FROM anchors"""


def _hmac(value: str, key: str) -> str:
    """HMAC-SHA256 of a text in hex, the key having at most 64 bytes."""
    blob = lambda mask: "".join(f"\\x{k ^ mask:02X}" for k in key.encode().ljust(64, b"\0"))
    return f"sha256('{blob(0x5C)}'::BLOB || unhex(sha256('{blob(0x36)}'::BLOB || encode({value}))))"


_SCORE = "round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.96::DOUBLE * CASE WHEN entity_id::INT % 2 = 0 THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN unattributed > 0.02 THEN 1 - unattributed ELSE 1.0::DOUBLE END * CASE WHEN entity_id::INT % 5 = 0 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END)), 3)"
_UNATTRIBUTED = "round(coalesce(sum(CASE WHEN merchant_norm = 'UNKNOWN' THEN txn_count ELSE 0 END)::DOUBLE / sum(txn_count), 0), 6)"
_COVER = "round(count(*) FILTER (WHERE merchant_norm <> 'UNKNOWN')::DOUBLE / count(*), 6)"
_MENTIONS = """mentions AS (SELECT p_partkey AS mention_id, (p_partkey % 25)::VARCHAR AS entity_id, CASE p_partkey % 5 WHEN 0 THEN upper(p) || ' Ltd' WHEN 1 THEN string_split(p, ' ')[2]
    WHEN 2 THEN 'Bundl Technologies' WHEN 3 THEN 'Snowflake' ELSE substr(p, 1, 6) END AS name FROM named)"""


def _tiers() -> str:
    from .functions.names import sql_normalised
    from .terms import BRANDS

    brand = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRANDS.items())
    legal = ", ".join(f"'{w}'" for w in sorted({w for f in LEGAL for w in f.split()}))
    initials = lambda ws: f"array_to_string(list_transform({ws}, lambda w: substr(w, 1, 1)), '')"
    words = "list_filter(string_split(merchant_norm, ' '), lambda w: w <> '')"
    short = f"list_filter({words}, lambda w: NOT list_contains([{legal}], w))"
    return f"""{_BASE}, {_MENTIONS}, asked AS (SELECT *, {sql_normalised("name")} AS q FROM mentions),
        asked_brand AS (SELECT *, CASE q {brand} END AS brand FROM asked WHERE q <> ''),
        both_ AS (SELECT b.mention_id, b.q, b.brand, b.name, d.merchant_norm, d.txn_count, d.counterparty_kind FROM asked_brand b JOIN dim d ON b.entity_id = d.entity_id WHERE merchant_norm <> 'UNKNOWN'),
        hits AS (SELECT mention_id, merchant_norm, txn_count, CASE WHEN merchant_norm = q THEN 1 WHEN merchant_norm = brand THEN 2 WHEN lower(merchant_norm) = lower(trim(name)) THEN 3
            WHEN length(q) >= 2 AND ({initials(words)} = q OR {initials(short)} = q) THEN 4 WHEN contains(' ' || merchant_norm || ' ', ' ' || q || ' ') THEN 5
            WHEN contains(merchant_norm, q) AND length(q) >= 3 THEN 6 END AS tier FROM both_),
        best_ AS (SELECT mention_id, min(tier) AS tier FROM hits GROUP BY mention_id),
        tiered AS (SELECT h.mention_id, h.tier, h.merchant_norm, h.txn_count FROM hits h JOIN best_ b ON h.mention_id = b.mention_id AND h.tier = b.tier)
        """


def _rupees(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN '-' ELSE '' END || '₹' || format('{{:,.2f}}', abs({c})::DOUBLE)"


def _n(c: str, what: str) -> str:
    return f"{c}::VARCHAR || CASE WHEN {c} = 1 THEN ' {what}' ELSE ' {what}s' END"


def _sentences(rows: str, text: str) -> str:
    return f"SELECT entity_id, {text} AS answer FROM ({rows}) x"


_MONTHS = f"""{_BASE}, months AS (SELECT entity_id, txn_month, sum(total_amount)::DECIMAL(25,2) AS total FROM rollup_monthly WHERE {_DEBIT} GROUP BY entity_id, txn_month),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY total DESC, txn_month DESC) AS hi, row_number() OVER (PARTITION BY entity_id ORDER BY total, txn_month DESC) AS lo FROM months)
        SELECT entity_id, max(CASE WHEN hi = 1 THEN txn_month END) AS top_month, max(total) AS top_total, max(CASE WHEN lo = 1 THEN txn_month END) AS low_month, min(total) AS low_total FROM ranked GROUP BY entity_id"""
#: Windows that are given themselves, which a year 1999 is too, or nothing to compare with.
_OWN = """(token IN ('this_month', 'ytd') OR "start" = DATE '1999-01-01' AND "end" = DATE '1999-12-31')"""
_PRECEDING = """CAST("start" - to_months(CAST(datediff('month', "start", "end") + 1 AS INTEGER)) AS DATE)"""

ORACLES = {
    "narration_extract": f"{_BASE} SELECT transaction_id, channel, merchant_raw, txn_month FROM extracted",
    "channel_mix": f"{_BASE} SELECT channel, count(*) AS txns FROM extracted GROUP BY channel",
    "vocabulary": f"{_BASE} SELECT merchant_raw, freq, credits, round(credits::DOUBLE / freq, 6) AS credit_ratio FROM vocab",
    "normalised_names": f"{_BASE} SELECT merchant_raw, norm FROM normed",
    "alias_fold": f"{_BASE} SELECT brand, sum(freq)::BIGINT AS freq, count(*) AS forms FROM branded GROUP BY brand",
    "kind_scores": f"{_BASE} SELECT * FROM alias",
    "vocabulary_statistics": f"""{_BASE} SELECT (SELECT count(*) FROM vocab) AS raw_strings, (SELECT sum(freq)::BIGINT FROM vocab) AS named_transactions,
        (SELECT count(DISTINCT merchant_norm) FROM alias) AS canonical_names, (SELECT count(DISTINCT upper(bank_code)) FROM bank) AS codes_stopped""",
    "txn_fact": f"{_BASE} SELECT * FROM fact",
    "merchant_dim": f"{_BASE} SELECT * FROM dim",
    "rollup_monthly": f"{_BASE} SELECT * FROM rollup_monthly",
    "counterparty_coverage": f"""{_BASE} SELECT count(*) AS txns, count(*) FILTER (WHERE merchant_norm <> 'UNKNOWN') AS attributed, sum(transaction_amount)::DECIMAL(25,2) AS value,
        (sum(transaction_amount) FILTER (WHERE merchant_norm <> 'UNKNOWN'))::DECIMAL(25,2) AS attributed_value, {_COVER} AS row_coverage,
        round((sum(transaction_amount) FILTER (WHERE merchant_norm <> 'UNKNOWN'))::DOUBLE / sum(transaction_amount)::DOUBLE, 6) AS value_coverage FROM fact""",
    "coverage_by_kind": f"{_BASE} SELECT counterparty_kind, count(*) AS txns, count(DISTINCT merchant_norm) AS names, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM fact), 4) AS share FROM fact GROUP BY counterparty_kind",
    "top_merchants": f"{_BASE} SELECT merchant_norm, sum(transaction_amount)::DECIMAL(25,2) AS total, count(*) AS txns FROM fact WHERE counterparty_kind NOT IN ('bank_charge', 'self_transfer', 'unknown') AND {_DEBIT} GROUP BY merchant_norm ORDER BY total DESC, merchant_norm LIMIT 10",
    "people_who_paid": f"{_BASE} SELECT merchant_norm, sum(transaction_amount)::DECIMAL(25,2) AS total, count(*) AS txns FROM fact WHERE counterparty_kind = 'person' AND transaction_type = 'credit' GROUP BY merchant_norm ORDER BY total DESC, merchant_norm LIMIT 6",
    "anchor_date": f"{_BASE} SELECT max(transaction_date)::DATE AS anchor FROM fact",
    "incremental_append": f"""{_TXN} SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS txn_month, count(*) AS added FROM txn t WHERE transaction_date >= DATE '2000-12-24'
        AND NOT EXISTS (SELECT 1 FROM txn k WHERE k.transaction_id = t.transaction_id AND k.transaction_date <= DATE '2000-12-31' AND k.transaction_id::BIGINT % 50 <> 0) GROUP BY 1""",
    "alias_preserve": f"{_BASE} SELECT merchant_raw, CASE WHEN length(merchant_raw) % 2 = 0 THEN 'OLD ' || merchant_norm ELSE merchant_norm END AS merchant_norm, counterparty_kind, kind_confidence FROM alias",
    "period_calendar": f"""{_CALENDAR} SELECT anchor, token, "start", "end", true AS month_aligned FROM cal""",
    "preceding_window": f"""{_CALENDAR} SELECT anchor, token, CAST("start" - to_months(CAST(datediff('month', "start", "end") + 1 AS INTEGER)) AS DATE) AS base_start, CAST("start" - INTERVAL '1 days' AS DATE) AS base_end FROM cal""",
    "spend_facts": _spend(f"{_DEBIT} AND {_days(LAST, 'txn_month')}"),
    "spend_all_time": _spend("transaction_type = 'credit'"),
    "spend_by_merchant": _by("merchant_norm", f"{_DEBIT} AND {_days(LAST, 'txn_month')}"),
    "spend_by_month": _by("txn_month", f"{_DEBIT} AND merchant_norm = 'SWIGGY'"),
    "credits_from_people": _by("merchant_norm", f"transaction_type = 'credit' AND counterparty_kind = 'person' AND {_days(Q2, 'txn_month')}"),
    "month_extremes": f"""{_BASE}, months AS (SELECT entity_id, txn_month, sum(total_amount)::DECIMAL(25,2) AS total FROM rollup_monthly WHERE {_DEBIT} GROUP BY entity_id, txn_month),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY total DESC, txn_month DESC) AS hi, row_number() OVER (PARTITION BY entity_id ORDER BY total, txn_month DESC) AS lo FROM months)
        SELECT entity_id, count(*) AS months, max(CASE WHEN hi = 1 THEN txn_month END) AS top_month, max(total) AS top_total, max(CASE WHEN lo = 1 THEN txn_month END) AS low_month,
               min(total) AS low_total, round(avg(total::DOUBLE), 2) AS mean_total FROM ranked GROUP BY entity_id""",
    "spend_last_30_days": f"""{_BASE} SELECT entity_id, sum(transaction_amount)::DECIMAL(25,2) AS total, count(*) AS txns, count(DISTINCT merchant_norm) AS merchants, min(transaction_date)::DATE AS first_day,
        max(transaction_date)::DATE AS last_day, round(sum(transaction_amount)::DOUBLE / count(*), 2) AS average FROM fact WHERE {_DEBIT} AND {_days(DAYS, "transaction_date::DATE")} GROUP BY entity_id""",
    "routing_equivalence": "SELECT 0::BIGINT AS different",
    "top_counterparties": _top(_DEBIT, 10),
    "top_people": _top(f"transaction_type = 'credit' AND counterparty_kind = 'person' AND {_days(Q2, 'txn_month')}", 3, "false"),
    "excluded_totals": _top(f"{_DEBIT} AND {_days(LAST, 'txn_month')}", 1),
    "latest_transactions": _listing("true", "transaction_date DESC", 5),
    "largest_transaction": _extreme("DESC"),
    "smallest_transaction": _extreme("ASC"),
    "over_threshold": _listing(f"{_DEBIT} AND transaction_amount >= 450000", "transaction_amount DESC", 20),
    "first_in_year": _listing("year(transaction_date) = 2000", "transaction_date ASC", 3),
    "compare_months": _compare(LAST, BEFORE),
    "compare_quarters": _compare(Q1, Q2, "AND merchant_norm = 'SWIGGY'"),
    "balances": f"{_TXN} SELECT entity_id, account_id, {_MASK.format(c='account_number')} AS account_number, bank_name, available_balance FROM account a LEFT JOIN bank b ON a.bank_code = b.bank_code",
    "balance_totals": f"{_TXN} SELECT entity_id, count(*) AS accounts, sum(available_balance)::DECIMAL(25,2) AS combined_balance FROM account GROUP BY entity_id",
    "primary_account": f"""{_TXN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY available_balance DESC, account_id) AS k FROM account)
        SELECT entity_id, account_id, {_MASK.format(c="account_number")} AS account_number, bank_name, available_balance FROM ranked a LEFT JOIN bank b ON a.bank_code = b.bank_code WHERE k = 1""",
    "busiest_entity": f"{_BASE} SELECT entity_id, count(*) AS txns FROM fact GROUP BY entity_id ORDER BY txns DESC, entity_id LIMIT 3",
    "reference_lookup": f"""{_BASE}, hits AS (SELECT *, transaction_reference_id AS reference FROM fact WHERE transaction_reference_id IN ({", ".join(f"'REF{i}'" for i in range(0, 5000, 500))})),
        whole AS (SELECT entity_id, reference, count(*) AS matches, sum(transaction_amount)::DECIMAL(25,2) AS match_total FROM hits GROUP BY entity_id, reference),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id, reference ORDER BY transaction_date DESC, transaction_id)::INTEGER AS rank FROM hits)
        SELECT r.entity_id, r.reference, rank, transaction_id, transaction_amount, matches, match_total FROM ranked r JOIN whole w ON r.entity_id = w.entity_id AND r.reference = w.reference WHERE rank <= 50""",
    "utr_lookup": f"""{_BASE} SELECT entity_id, transaction_id, {_hmac("upper(trim(utr_number))", PEPPER)} AS utr_blind_idx, transaction_amount FROM fact
        WHERE utr_number IN ({", ".join(f"'UTR{i}'" for i in range(100000, 115000, 1000))})""",
    "period_phrases": "WITH anchors AS (SELECT DISTINCT last_day(o_orderdate)::DATE AS anchor FROM orders) " + " UNION ALL ".join(_phrase(p, *x) for p, x in _PHRASES.items()),
    "warehouse_build": f"""{_BASE} SELECT count(*) AS facts, count(DISTINCT entity_id) AS entities, count(DISTINCT account_id) AS accounts, max(transaction_date)::DATE AS anchor, {_COVER} AS coverage, 0::BIGINT AS added FROM fact""",
    "answer_sentences": f"""{_BASE} SELECT entity_id, 'You spent ₹' || format('{{:,.2f}}', sum(total_amount)::DOUBLE) || ' in ' || sum(txn_count)::BIGINT::VARCHAR || ' transactions.' AS answer
        FROM rollup_monthly WHERE {_DEBIT} AND {_days(LAST, 'txn_month')} GROUP BY entity_id""",
    "month_sentences": _sentences(_MONTHS, f"""'Your highest month was ' || strftime(top_month, '%B %Y') || ' with ' || {_rupees("top_total")} || ', the lowest ' || strftime(low_month, '%B %Y') || ' with ' || {_rupees("low_total")} || '.'"""),
    "rank_sentences": _sentences(_top(_DEBIT, 1), f"""'Number ' || rank::VARCHAR || ' is ' || merchant_norm || ' with ' || {_rupees("total")} || ' of ' || {_rupees("all_total")} || CASE WHEN truncated THEN ', of ' || groups::VARCHAR || ' in all' ELSE '' END || '.'"""),
    "comparison_sentences": _sentences(_compare(LAST, BEFORE), f"""'It was ' || {_rupees("later")} || ' after ' || {_rupees("earlier")} || CASE WHEN delta < 0 THEN ', a fall of ' ELSE ', a rise of ' END || {_rupees("abs(delta)")}
        || CASE WHEN pct_change IS NOT NULL THEN ' (' || pct_change::VARCHAR || ' %)' ELSE '' END || '.'"""),
    "listing_sentences": _sentences(_listing(f"transaction_type = 'credit' AND {_days(DAYS, 'transaction_date::DATE')}", "transaction_date DESC", 1), f"""{_n("matches", "transaction")} || ' of ' || {_rupees("match_total")} || CASE WHEN truncated THEN ', the first of them shown' ELSE '' END || '.'"""),
    "threshold_sentences": _sentences(_listing(f"{_DEBIT} AND transaction_amount >= 450000", "transaction_amount DESC", 1), f"""{_n("matches", "transaction")} || ' above the amount, ' || {_rupees("match_total")} || ' together.'"""),
    "grounding_of_rows": f"""{_BASE} SELECT entity_id AS answer_id, entity_id::INT % 5 <> 0 AS grounded, CASE WHEN entity_id::INT % 5 = 0 THEN [format('{{:,.2f}}', sum(total_amount)::DOUBLE)] ELSE []::VARCHAR[] END AS offending
        FROM rollup_monthly WHERE {_DEBIT} AND {_days(LAST, 'txn_month')} GROUP BY entity_id""",
    "answer_scopes": f"""SELECT entity_id, rank, 'counterparty: ' || merchant_norm || '; period: q2; direction: credit; kind: ' || counterparty_kind AS scope
        FROM ({_top(f"transaction_type = 'credit' AND counterparty_kind = 'person' AND {_days(Q2, 'txn_month')}", 3, "false")}) x""",
    "amounts_between": _listing(f"{_DEBIT} AND transaction_amount >= 100000 AND transaction_amount <= 200000", "transaction_amount ASC", 10),
    "compared_windows": f"""{_CALENDAR} SELECT anchor, token, CASE WHEN {_OWN} THEN {_PRECEDING} ELSE DATE '1999-01-01' END AS base_start,
        CASE WHEN {_OWN} THEN CAST("start" - INTERVAL '1 days' AS DATE) ELSE DATE '1999-12-31' END AS base_end FROM cal""",
    "period_suggestions": f"""SELECT anchor, unnest(['q9', 'last_99_months', 'fortnight']) AS phrase, '{",".join(periods.SUGGESTIONS)}' AS suggestions
        FROM (SELECT DISTINCT last_day(o_orderdate)::DATE AS anchor FROM orders) x""",
    "account_ownership": "SELECT DISTINCT c_nationkey::VARCHAR AS entity_id, c_custkey::VARCHAR AS account_id FROM customer WHERE c_custkey % 25 = c_nationkey AND c_custkey IN (SELECT o_custkey FROM orders)",
    "amounts_written": f"""{_TXN} SELECT account_id::BIGINT AS answer_id, 'The balance is ' || CASE WHEN abs(available_balance) >= 1000 THEN CASE WHEN available_balance < 0 THEN '-' ELSE '' END || '₹' || format('{{:,.2f}}', abs(available_balance)::DOUBLE)
        ELSE available_balance::VARCHAR END || ' in 2 accounts' || CASE WHEN account_id::BIGINT % 5 = 0 THEN ' and 98,765,432.10' ELSE '' END AS text FROM account""",
    "landed_rows": f"""{_TXN} SELECT '{{"account_id":"' || account_id || '","entity_id":"' || entity_id || '","account_number":"' || account_number || '","program_id":' || program_id::VARCHAR || ',"available_balance":'
        || available_balance::VARCHAR || ',"bank_code":"' || bank_code || '"}}' AS json FROM account ORDER BY account_id LIMIT 200""",
    "payout_files_audit": f"""WITH {ledger.PAYOUT_FILES_ORACLE}, rows AS (SELECT t.*, vendor_name, reconciliation_status, notes FROM transactions t JOIN vendor_list v ON t.vendor_id = v.vendor_id
            JOIN reconciliation_status r ON t.transaction_id = r.transaction_id WHERE reconciliation_status IN ('Unreconciled', 'Disputed'))
        SELECT transaction_id, vendor_name, transaction_date, amount, reconciliation_status, notes, (SELECT count(*) FROM rows) AS matches, (SELECT sum(amount)::DECIMAL(25,2) FROM rows) AS match_total
        FROM rows ORDER BY transaction_date DESC, amount DESC, transaction_id LIMIT 50""",
    "payout_files_totals": f"""WITH {ledger.PAYOUT_FILES_ORACLE} SELECT status AS what, count(*) AS "rows", sum(amount)::DECIMAL(25,2) AS total FROM vendor_payouts GROUP BY status
        UNION ALL SELECT 'no payout', count(*), sum(amount)::DECIMAL(25,2) FROM transactions WHERE payout_id IS NULL""",
    "unattributed_share": f"{_BASE} SELECT entity_id, {_UNATTRIBUTED} AS unattributed FROM rollup_monthly WHERE {_DEBIT} AND {_days(LAST, 'txn_month')} GROUP BY entity_id",
    "confidence_bands": f"""{_BASE}, shares AS (SELECT entity_id, {_UNATTRIBUTED} AS unattributed FROM rollup_monthly GROUP BY entity_id), scores AS (SELECT *, {_SCORE} AS score FROM shares)
        SELECT entity_id, unattributed, score, CASE WHEN score >= 0.88 THEN 'High' WHEN score >= 0.72 THEN 'Medium' ELSE 'Low' END AS band,
            array_to_string(list_filter(['name matched inexactly', CASE WHEN entity_id::INT % 2 = 0 THEN 'period assumed' END, CASE WHEN unattributed > 0.02 THEN 'some transactions unattributed' END,
                CASE WHEN entity_id::INT % 5 = 0 THEN 'ad-hoc query' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM scores""",
    "resolve_tiers": f"""{_tiers()}, ranked AS (SELECT *, count(*) OVER (PARTITION BY mention_id) AS n, row_number() OVER (PARTITION BY mention_id ORDER BY txn_count DESC, merchant_norm)::INTEGER AS rank FROM tiered)
        SELECT mention_id, tier, n, rank, merchant_norm, txn_count FROM ranked""",
    "resolve_exact": f"""{_tiers()}, grouped AS (SELECT mention_id, min(tier) AS tier, count(*) AS n, list(merchant_norm ORDER BY txn_count DESC, merchant_norm) AS found FROM tiered GROUP BY mention_id)
        SELECT m.mention_id, CASE WHEN g.n IS NULL THEN 'NOT_FOUND' WHEN g.n = 1 OR g.tier <= 3 THEN 'MATCH' ELSE 'AMBIGUOUS' END AS status, CASE WHEN g.n = 1 OR g.tier <= 3 THEN found[1] END AS entity,
            CASE WHEN g.n IS NULL THEN 0.0::DOUBLE WHEN g.n = 1 OR g.tier <= 3 THEN [1.0, 0.98, 1.0, 0.96, 0.95, 0.92][g.tier]::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
            CASE WHEN g.n IS NULL THEN 'none' ELSE ['exact', 'brand', 'case', 'acronym', 'word', 'part'][g.tier] END AS method
        FROM mentions m LEFT JOIN grouped g ON m.mention_id = g.mention_id""",
    "resolve_statistics": f"""{_tiers()}, grouped AS (SELECT mention_id, min(tier) AS tier, count(*) AS n, list(merchant_norm ORDER BY txn_count DESC, merchant_norm) AS found FROM tiered GROUP BY mention_id),
        answered AS (SELECT m.mention_id, m.entity_id, CASE WHEN g.n = 1 OR g.tier <= 3 THEN found[1] END AS entity FROM mentions m LEFT JOIN grouped g ON m.mention_id = g.mention_id)
        SELECT a.mention_id, a.entity, coalesce(d.txn_count, 0) AS txn_count, coalesce(d.total_debit, 0)::DECIMAL(25,2) AS total_debit, coalesce(d.active_months, 0) AS active_months
        FROM answered a LEFT JOIN dim d ON a.entity_id = d.entity_id AND a.entity = d.merchant_norm""",
    "mention_detection": f"""{_BASE}, clean AS (SELECT transaction_id AS text_id, entity_id, ' ' || trim(regexp_replace(upper(description), '[^A-Z0-9&.''-]+', ' ', 'g')) || ' ' AS c FROM fact),
        hits AS (SELECT text_id, merchant_norm, row_number() OVER (PARTITION BY text_id ORDER BY length(merchant_norm) DESC, merchant_norm DESC) AS k FROM clean t JOIN dim d ON t.entity_id = d.entity_id
            WHERE merchant_norm <> 'UNKNOWN' AND contains(c, ' ' || merchant_norm || ' '))
        SELECT text_id, merchant_norm FROM hits WHERE k = 1""",
    "period_gate": f"""{_BASE} SELECT f.transaction_id AS question_id, coalesce(d.active_months, 0) > 1 AND f.transaction_id::BIGINT % 2 = 0 AND f.transaction_id::BIGINT % 5 <> 0 AS ask_period
        FROM fact f LEFT JOIN dim d ON f.entity_id = d.entity_id AND f.merchant_norm = d.merchant_norm""",
    "scorecard": """SELECT event_type AS run, count(*) AS cases, round(avg(CASE WHEN value > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS pass_rate, count(*) FILTER (WHERE NOT value > 5) AS failures,
        round(quantile_cont(value, 0.5), 4) AS p50_ms, max(value) AS max_ms FROM events GROUP BY event_type""",
    "resolve_people": f"""{_BASE}, ranked AS (SELECT entity_id, merchant_norm, total_credit, row_number() OVER (PARTITION BY entity_id ORDER BY total_credit DESC, merchant_norm)::INTEGER AS rank FROM dim WHERE counterparty_kind = 'person')
        SELECT entity_id, rank, merchant_norm, total_credit FROM ranked WHERE rank <= 5""",
    "masked_accounts": f"{_TXN} SELECT account_id, {_MASK.format(c='account_number')} AS account_number FROM account",
    "redacted_descriptions": f"{_TXN} SELECT transaction_id, regexp_replace(description, '\\d{{9,}}', '[REDACTED]', 'g') AS description FROM txn",
    "adhoc_weekend_counts": f"{_BASE} SELECT entity_id, count(*) FILTER (WHERE dayofweek(transaction_date) NOT IN (0, 6)) AS weekday, count(*) FILTER (WHERE dayofweek(transaction_date) IN (0, 6)) AS weekend FROM fact GROUP BY entity_id",
    "adhoc_channel_by_month": f"{_BASE} SELECT txn_month, channel, count(*) AS txns, sum(transaction_amount)::DECIMAL(25,2) AS total FROM fact GROUP BY txn_month, channel",
    "adhoc_select": f"{_BASE} SELECT channel, count(*) AS txns, sum(transaction_amount)::DECIMAL(25,2) AS total FROM fact WHERE entity_id = '3' AND dayofweek(transaction_date) IN (0, 6) AND {_DEBIT} GROUP BY channel",
    "quality_report": f"""{_BASE} SELECT 'rows_missing_from_fact' AS "check", (SELECT count(*) FROM txn t WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.transaction_id = t.transaction_id)) AS found
        UNION ALL SELECT 'entities_that_differ', 0 UNION ALL SELECT 'rows_without_entity', (SELECT count(*) FROM fact WHERE entity_id IS NULL)
        UNION ALL SELECT 'duplicate_keys', (SELECT count(*) FROM (SELECT transaction_id FROM fact GROUP BY transaction_id HAVING count(*) > 1) x)
        UNION ALL SELECT 'brands_not_folded', (SELECT count(*) FROM dim WHERE merchant_norm IN ({", ".join(f"'{b}'" for b in vocabulary.BRANDS)}))
        UNION ALL SELECT 'legal_forms_left', (SELECT count(*) FROM dim WHERE regexp_matches(merchant_norm, '{_SUFFIX}'))
        UNION ALL SELECT 'sentinels_as_merchants', (SELECT count(*) FROM dim WHERE merchant_norm IN ('BANK CHARGES', 'SELF TRANSFER') AND counterparty_kind = 'merchant')
        UNION ALL SELECT 'kinds_missing', 5 - (SELECT count(DISTINCT counterparty_kind) FROM fact)
        UNION ALL SELECT 'bank_codes_as_names', (SELECT count(*) FROM bank WHERE upper(bank_code) IN (SELECT merchant_norm FROM dim))
        UNION ALL SELECT 'coverage_below_90_percent', (SELECT CASE WHEN count(*) FILTER (WHERE merchant_norm <> 'UNKNOWN') < 0.9 * count(*) THEN 1 ELSE 0 END FROM fact)""",
    "grounding_check": """SELECT c_custkey AS answer_id, c_custkey % 5 <> 0 AS grounded, CASE WHEN c_custkey % 5 = 0 THEN ['98,765,432.10'] ELSE []::VARCHAR[] END AS offending FROM customer""",
    "balance_sentences": f"""{_TXN}, t AS (SELECT entity_id, count(*) AS n, sum(available_balance)::DECIMAL(25,2) AS b FROM account GROUP BY entity_id)
        SELECT entity_id, n::VARCHAR || CASE WHEN n = 1 THEN ' account' ELSE ' accounts' END || ' with ' || CASE WHEN b < 0 THEN '-' ELSE '' END || '₹' || format('{{:,.2f}}', abs(b)::DOUBLE) || ' together.' AS answer FROM t""",
    "extreme_sentences": f"""{_BASE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY transaction_amount DESC, transaction_date DESC, transaction_id DESC) AS k FROM fact WHERE transaction_type = 'debit')
        SELECT entity_id, '₹' || format('{{:,.2f}}', transaction_amount::DOUBLE) || ' at ' || merchant_norm || ' on ' || strftime(transaction_date, '%Y-%m-%d') || '.' AS answer FROM ranked WHERE k = 1""",
    "thread_summary": """WITH firsts AS (SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, trim(regexp_replace(arg_min(text, turn), '[ \\t\\r\\n]+', ' ', 'g')) AS first FROM conversations GROUP BY conv_id)
        SELECT conv_id, messages, last_turn, CASE WHEN length(first) > 60 THEN rtrim(substr(first, 1, 59)) || '…' ELSE first END AS title FROM firsts""",
    "newest_threads": """WITH firsts AS (SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, trim(regexp_replace(arg_min(text, turn), '[ \\t\\r\\n]+', ' ', 'g')) AS first FROM conversations GROUP BY conv_id)
        SELECT conv_id, messages, last_turn, CASE WHEN length(first) > 60 THEN rtrim(substr(first, 1, 59)) || '…' ELSE first END AS title FROM firsts ORDER BY last_turn DESC, conv_id DESC LIMIT 20""",
    "last_n_messages": "SELECT conv_id, turn, role, back FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS back FROM conversations) x WHERE back <= 3",
    "conversation_totals": "SELECT count(DISTINCT conv_id) AS threads, count(*) AS messages FROM conversations",
    "vendor_spend": f"{_PAY} SELECT vendor_name, count(*) AS payouts, sum(amount)::DECIMAL(25,2) AS total, round(avg(amount::DOUBLE), 2) AS average, min(payout_date) AS first_date, max(payout_date) AS last_date FROM payouts p JOIN vendors v ON p.vendor_id = v.vendor_id GROUP BY v.vendor_id, vendor_name",
    "top_vendors": f"""{_PAY} SELECT vendor_name, count(*) AS payouts, sum(amount)::DECIMAL(25,2) AS total, (SELECT sum(amount)::DECIMAL(25,2) FROM payouts) AS all_total, (SELECT count(DISTINCT vendor_id) FROM payouts) AS vendors
        FROM payouts p JOIN vendors v ON p.vendor_id = v.vendor_id GROUP BY v.vendor_id, vendor_name ORDER BY total DESC, vendor_name LIMIT 20""",
    "payout_listing": f"""{_PAY}, rows AS (SELECT * FROM payouts WHERE lower(reconciliation_status) = 'reconciled' AND contains(lower(category), 'promo'))
        SELECT payout_key, line, vendor_name, payout_date, amount, status, category, (SELECT count(*) FROM rows) AS matches, (SELECT coalesce(sum(amount), 0)::DECIMAL(25,2) FROM rows) AS match_total
        FROM rows r JOIN vendors v ON r.vendor_id = v.vendor_id ORDER BY payout_date DESC, amount DESC, payout_key, line, vendor_name, status, category LIMIT 50""",
    "latest_payouts": f"""{_PAY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY payout_date DESC, amount DESC, payout_key, line, status, category)::INTEGER AS rank FROM payouts)
        SELECT vendor_name, rank, payout_date, amount FROM ranked r JOIN vendors v ON r.vendor_id = v.vendor_id WHERE rank <= 3""",
    "category_spend": f"{_PAY} SELECT category, count(*) AS payouts, sum(amount)::DECIMAL(25,2) AS total FROM payouts GROUP BY category",
    "status_split": f"{_PAY} SELECT status, count(*) AS payouts, sum(amount)::DECIMAL(25,2) AS total FROM payouts GROUP BY status",
    "monthly_change": f"""{_PAY}, m AS (SELECT category, CAST(date_trunc('month', payout_date) AS DATE) AS month, sum(amount)::DECIMAL(25,2) AS total FROM payouts GROUP BY 1, 2)
        SELECT category, month, total, (total - lag(total) OVER (PARTITION BY category ORDER BY month))::DECIMAL(25,2) AS change FROM m""",
    "reconciliation_audit": f"""{_PAY}, rows AS (SELECT * FROM payouts WHERE lower(reconciliation_status) IN ('unreconciled', 'disputed'))
        SELECT payout_key, line, vendor_name, payout_date, amount, reconciliation_status, (SELECT count(*) FROM rows) AS matches, (SELECT sum(amount)::DECIMAL(25,2) FROM rows) AS match_total
        FROM rows r JOIN vendors v ON r.vendor_id = v.vendor_id ORDER BY payout_date DESC, amount DESC, payout_key, line, vendor_name LIMIT 50""",
    "payout_outliers": f"""{_PAY}, marked AS (SELECT *, amount::DOUBLE AS x, payout_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' AS inside FROM payouts),
        stats AS (SELECT vendor_id, count(*) FILTER (WHERE NOT inside) AS n_out, avg(x) FILTER (WHERE NOT inside) AS mean_out, stddev_samp(x) FILTER (WHERE NOT inside) AS sd_out, count(*) AS n_all, avg(x) AS mean_all, stddev_samp(x) AS sd_all FROM marked GROUP BY vendor_id),
        used AS (SELECT vendor_id, CASE WHEN n_out >= 2 THEN n_out ELSE n_all END AS n, CASE WHEN n_out >= 2 THEN mean_out ELSE mean_all END AS mean, CASE WHEN n_out >= 2 THEN sd_out ELSE sd_all END AS sd FROM stats)
        SELECT vendor_name, payout_key, line, payout_date, amount, round(mean, 2) AS usual, round(x / mean, 1) AS times FROM marked m JOIN used u ON m.vendor_id = u.vendor_id JOIN vendors v ON m.vendor_id = v.vendor_id
        WHERE inside AND x > mean + 1.5 * coalesce(sd, 0.3 * mean) AND x > 1.4 * mean AND n >= 2""",
    "stream_fact": f"{_BASE} SELECT * FROM fact",
    "stream_dedupe": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_monthly": "SELECT CAST(date_trunc('month', ts) AS DATE) AS txn_month, event_type, count(*) AS txns, CAST(sum(value) AS DECIMAL(25,2)) AS total FROM events GROUP BY 1, 2",
}
