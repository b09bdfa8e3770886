"""Canonical names and the kind of a counterparty, as column expressions."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import CORPORATE, LEGAL, PERSON_FROM, PERSON_WORDS

_FORMS = "|".join(re.escape(x).replace("\\ ", " ") for x in sorted(LEGAL, key=lambda x: (-len(x), x)))
#: A legal form at the end, and the same with what stands before it, which can't be empty.
_SUFFIX = r"\b(" + _FORMS + r")\s*$"
_NAMED = r"^(.*?[^\s,.])[\s,.]*\b(?:" + _FORMS + r")[\s,.]*$"
#: Last letters of names that end in a legal form.
_ENDS = sorted({form.rstrip(".").split(" ")[-1] for form in LEGAL} | {" ", ".", ","})


def normalised(raw: Column) -> Column:
    """Upper case, plain characters, single spaces, no trailing code and up to three legal forms less."""
    name = F.regexp_replace(F.trim(F.upper(raw)), r"[^A-Z0-9 &.'-]", " ")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\s+[A-Z]{0,4}\d[A-Z0-9]*$", ""), r"\s+", " "))
    # most names end in no legal form, which their last letters tell at less cost than the pattern
    formed = lambda n: reduce(operator.or_, (n.endswith(x) for x in _ENDS))
    return F.aggregate(F.array(*map(F.lit, range(3))), name, lambda n, _: F.when(formed(n), F.regexp_replace(n, _NAMED, "$1")).otherwise(n))


def kind_score(name: Column, samples: Column, credit_ratio: Column, freq: Column) -> Column:
    """Several weak signals that a name is a person's, added up."""
    words = F.split(name, " ")
    corporate = F.arrays_overlap(words, F.array(*map(F.lit, CORPORATE)))
    spelled = F.size(words).between(2, PERSON_WORDS) & F.forall(words, lambda w: w.rlike(r"^\p{L}+$"))
    mixed = F.exists(F.slice(samples, 1, 5), lambda s: (s != F.upper(s)) & (s != F.lower(s)))
    return (
        F.when(corporate, -3).otherwise(0)
        + F.when(F.size(words) == 1, -2).when(spelled, 1).otherwise(0)
        + F.when(mixed, 2).otherwise(0)
        + F.when(credit_ratio > 0.6, 2).when(credit_ratio < 0.2, -1).otherwise(0)
        + F.when(freq <= 3, 1).otherwise(0)
    )


def kind(score: Column) -> Column:
    return F.when(score >= PERSON_FROM, "person").otherwise("merchant")


def kind_confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.5 + F.abs(score) / 8.0), 2)


def sql_normalised(raw: str) -> str:
    """The same for DuckDB, of a column or expression."""
    name = f"trim(regexp_replace(regexp_replace(regexp_replace(trim(upper({raw})), '[^A-Z0-9 &.''-]', ' ', 'g'), '\\s+[A-Z]{{0,4}}\\d[A-Z0-9]*$', ''), '\\s+', ' ', 'g'))"
    for _ in range(3):
        name = f"regexp_replace({name}, '{_NAMED}', '\\1')"
    return name
