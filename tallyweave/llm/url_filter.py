"""URL filters: host and path rules first, then a blocked Bloom filter of listed canonical URLs backed by an exact join.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, is on no list and is
allowed. Repeated pages are judged one by one. Only ``page_id`` and ``url`` are read, so further columns can't clash.
An empty list blocks nothing. Where one address has very many pages, the hits on it are joined in one task unless adaptive
execution splits it; a page that the filter settles moves nowhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Filter blocks are sent to all executors only up to this many (40 bytes each); beyond it the join shuffles.
BROADCAST_BLOCKS = 100_000
#: A block has four 64-bit words; each URL sets two bits in each.
WORDS, BITS_PER_URL = 4, 16


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column, host: Column, path: Column) -> Column:
    """What variants of an address share: no scheme, www., default port, last slash, fragment or tracking parameters.

    Null where the url has no host.
    """
    site = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(site, F.regexp_replace(path, "/+$", ""), tail))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, else null. Rules are a short fixed list, so they become one expression."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def _place(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A URL's block, and its two bits in each word of it."""
    where, bits = F.xxhash64(url), F.xxhash64(url, F.lit("bits"))
    masks = []
    for w in range(WORDS):
        low, high = (F.shiftrightunsigned(bits, 12 * w + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in (0, 1))
        one = [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in (low, high)]
        masks.append(one[0].bitwiseOR(one[1]))
    return F.pmod(where, F.lit(blocks)), masks


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row per block in use: (block, w0..w3). Bits are combined before the shuffle."""
    block, masks = _place(F.col("url"), blocks)
    return listed.groupBy(block.alias("block")).agg(*(F.bit_or(m).alias(f"w{i}") for i, m in enumerate(masks)))


def on_list(keyed: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """``keyed`` plus boolean ``listed``: whether its ``key`` is a url of ``listed`` (distinct column ``url``).

    The filter settles most rows without moving them; only possible hits meet the list itself.
    """
    n = listed.count()
    blocks = max(1, math.ceil(n * BITS_PER_URL / (64 * WORDS)))
    index = bloom_filter(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        index = F.broadcast(index)
    rows = keyed.filter(F.col(key).isNotNull()).select(F.struct(*keyed.columns).alias("row"), F.col(key).alias("url"))
    block, masks = _place(F.col("url"), blocks)
    probed = rows.withColumns({"block": block, **{f"m{i}": m for i, m in enumerate(masks)}}).join(index, "block", "left")
    may = F.col("w0").isNotNull()
    for i in range(WORDS):
        may = may & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    probed = probed.select("row", "url", F.coalesce(may, F.lit(False)).alias("may"))
    hits = probed.filter("may").join(listed.select("url", F.lit(True).alias("there")), "url", "left")
    none = keyed.filter(F.col(key).isNull()).select(*keyed.columns, F.lit(False).alias("listed"))  # they share a block, but no list
    hits = hits.select("row.*", F.coalesce("there", F.lit(False)).alias("listed"))
    return hits.unionByName(probed.filter("not may").select("row.*", F.lit(False).alias("listed"))).unionByName(none)


def addressed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, address) of each page; address is the canonical URL."""
    rows = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    return rows.select("page_id", "host", "path", canonical(F.col("url"), F.col("host"), F.col("path")).alias("address"))


def listed_urls(rows: DataFrame, sites: list[str]) -> DataFrame:
    """Distinct canonical URLs of the addressed ``rows`` on one of the ``sites`` (a label of the host)."""
    return rows.filter(F.arrays_overlap(F.split("host", "\\."), F.array(*map(F.lit, sites)))).select(F.col("address").alias("url")).distinct()


def filter_urls(rows: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page, from ``addressed`` rows and a list of canonical URLs.

    A rule's verdict holds where one fits; else a page is blocked if its canonical URL is on the list.
    """
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(verdict)
    out = on_list(rows, "address", listed)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
