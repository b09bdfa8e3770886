"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of consecutive k-grams the smallest hash is chosen, the
rightmost where equal; a choice is kept once, with its position. Any passage of at least ``k + window - 1`` code
points that two texts share gives them a fingerprint in common. The likeness of two texts is the share of chosen
hashes, counted with repeats, that they have in common (Dice).

All texts use the same grams and windows, so the guarantee holds between any two. A text with fewer k-grams than a window
is one window; one with fewer than k code points is one gram.

Defined results: a null text is empty. An empty text has the empty fingerprint; two empty ones are alike (1). Rows with equal doc_id follow one another by
their texts' hash, as do rows without doc_id, which come last; repeated rows are documents of their own; the only row of a table
follows itself. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Code points of a k-gram (a power of two), and k-grams of a window (a power of two).
K, WINDOW = 8, 32
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def chosen(points: np.ndarray, k: int = K, window: int = WINDOW) -> np.ndarray:
    """The kept choices in order, each as hash << 32 | position."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.uint64)
    h = (points.astype(np.uint64) + np.uint64(1)) * _BASE
    step, power = 1, int(_BASE)
    while step < k:  # a hash of 2s code points from two of s; a text that ends before gives what it has
        if len(h) > step:
            h = h[:-step] * np.uint64(power) + h[step:]
        else:
            h = (h * np.uint64(power)).sum(keepdims=True) + np.uint64(n)
        power, step = power * power & 0xFFFFFFFFFFFFFFFF, step * 2
    h = (h ^ (h >> np.uint64(29))) * _MIX
    # the smallest of a window, the rightmost where equal: the hash above, the reversed position below
    low = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    span = 1
    while span < window:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low.min(keepdims=True)
        span *= 2
    kept = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (kept & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF)))


def hashes(choices: np.ndarray) -> np.ndarray:
    """Sorted hashes of the choices."""
    return np.sort(choices >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice's measure of two sorted arrays of hashes, counted with repeats."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    if len(a) == len(np.unique(a)) and len(b) == len(np.unique(b)):
        common = int((both[1:] == both[:-1]).sum())
    else:
        va, ca = np.unique(a, return_counts=True)
        vb, cb = np.unique(b, return_counts=True)
        _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        common = int(np.minimum(ca[ia], cb[ib]).sum())
    return 2.0 * common / (len(a) + len(b))


def text_of(choices: np.ndarray) -> str:
    """The fingerprint as text: 16 hex digits for each choice, eight of the hash and eight of the position."""
    return choices.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _passed(bounds: list[tuple[int, int]], falling: Column, h: Column) -> Column:
    """How many of the rising ``bounds`` (falling, hash) are at or below a row's; found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    own = F.struct(falling.alias("f"), h.alias("h"))
    ends = lambda xs: F.array(*(F.struct(F.lit(f).cast("bigint").alias("f"), F.lit(x).cast("bigint").alias("h")) for f, x in xs))
    whole = F.size(F.filter(ends([c[-1] for c in chunks]), lambda b: b <= own))
    inner = F.get(F.array(*map(ends, chunks)), whole)
    rest = F.when(inner.isNotNull(), F.size(F.filter(inner, lambda b: b <= own))).otherwise(0)
    return F.least(F.lit(len(bounds)), whole * width + rest)


def _even(j: int, n: int) -> int:
    """Where the j-th of n equal parts of all hashes begins."""
    return -(1 << 63) + (j << 64) // n


def ranged(docs: DataFrame, parts: int) -> DataFrame:
    """(part, follows, doc_id, falling, h, text): the rows by falling doc_id in about ``parts`` ranges, each with the row after it.

    That row, the first of the next range or, after the last, of the first range, has ``follows`` true and is there for
    its text alone. Range ends are quantiles of the ids; an id that several quantiles meet, and rows without one, are cut
    into as many ranges by their texts' hash. Which ends are chosen doesn't change any result. What reaches the driver
    is a few numbers per range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    n, known = ids.agg(F.count("*"), F.count("doc_id")).first()
    ends = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], max(0.2 / parts, 1e-5)) if parts > 1 and known else []
    often = Counter(int(q) for q in ends)
    bounds = sorted((~q, _even(j, k)) for q, k in often.items() for j in range(k))
    lost = max(1, round(parts * (n - known) / max(1, n)))
    h, falling = F.xxhash64("text"), F.bitwise_not(F.col("doc_id").cast("bigint"))
    rows = rows.withColumns({"h": h, "falling": falling})
    without = F.lit(len(bounds) + 1) + F.size(F.filter(F.array(*(F.lit(_even(j, lost)) for j in range(1, lost))).cast("array<bigint>"), lambda b: b <= F.col("h")))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), without).otherwise(_passed(bounds, F.col("falling"), F.col("h"))).cast("int"))
    key = F.struct(F.col("falling").isNull().alias("none"), "falling", "h")
    first = sorted((r.part, r.first) for r in rows.groupBy("part").agg(F.min(key).alias("first")).collect())
    count = len(bounds) + 1 + lost
    heads, before = [None] * count, [0] * count
    for i, (p, head) in enumerate(first):
        heads[p], before[p] = head, first[i - 1][0]  # the range whose last row this range's first row follows
    kind = "struct<f:bigint,h:bigint>"
    table = F.array(*(F.lit(None).cast(kind) if x is None else F.struct(F.lit(x.falling).cast("bigint").alias("f"), F.lit(x.h).alias("h")) for x in heads))
    head = F.get(table, F.col("part"))
    own = F.struct(F.col("part"), F.lit(False).alias("follows"))
    also = F.struct(F.get(F.array(*map(F.lit, before)), F.col("part")).alias("part"), F.lit(True).alias("follows"))
    leads = F.col("falling").eqNullSafe(head["f"]) & (F.col("h") == head["h"])
    rows = rows.withColumn("at", F.explode(F.when(leads, F.array(own, also)).otherwise(F.array(own))))
    return rows.select("at.part", "at.follows", "doc_id", "text", "falling", "h")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of sorted ranges; holds a document, the one before it, and what a batch returns."""
    out: list[tuple] = []
    size = 0
    held = None  # range, doc_id, text and choices of the row that still waits for the one after it
    for batch in pieces(batches, text=3):
        for part, follows, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held is not None and held[0] != part:
                held = None
            if follows and held is None:
                continue
            choices = chosen(code_points(text))
            found = hashes(choices)
            if held is not None:
                changed = edited(held[2], text)
                new = chosen(code_points(changed))
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((held[1], len(held[2]), digest, text_of(held[3]), text_of(new), likeness(held[4], hashes(new)), likeness(held[4], found)))
                size += len(held[2])
                if size >= 1 << 20:
                    yield _batch(out)
                    out, size = [], 0
            held = None if follows else (part, doc_id, text, choices, found)
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame, ranges_per_task: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness, a row per document."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranged(docs, ranges_per_task * n).repartition(n, "part")
    return dealt.sortWithinPartitions("part", "follows", F.asc_nulls_last("falling"), "h").select("part", "follows", "doc_id", "text").mapInArrow(_rows, _SCHEMA)
