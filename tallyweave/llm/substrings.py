"""Substring dedup: removal of word passages that a document with a smaller id has, too.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window over it also starts in a document
with a smaller doc_id. Only some places are indexed: anchors of ``ANCHOR`` words that start at a position whose
remainder modulo ``PERIOD`` is in a difference cover. Wherever the same window starts in two documents, some offset in
it is a cover position in both, so the two share an anchor there; documents that share no anchor share no window.

1. Each anchor is hashed alone and with its context, all words that a window over it can reach. Documents are matched by
   both hashes together, 128 bits, as windows are; a document then finds its own anchors by the context's hash alone. Anchors of equal
   context have equal windows: there the smallest doc_id keeps them, and the others' windows over the anchor go
   (``covered``). Where one anchor occurs in several contexts, its windows are compared one by one (``check``).
2. The windows over anchors to check are hashed (128 bits); of equal ones the smallest doc_id keeps its own.
3. The texts meet what is known of their anchors and windows, and lose the words that these cover.

Tasks combine what they have before they shuffle it: an anchor's context or a window leaves a task once, however many
documents of the task share it, so a passage that a third of all documents share is a few rows per task.

What is known of a document is gathered by doc_id; where rows of one doc_id, or rows without one, differ in text, by
doc_id and text, so however many rows share an id, each gets the hashes of its own text and no others.

Defined results: a null text has no words; texts shorter than a window stay whole. A null doc_id counts as larger than
all others but 2**63 - 1, which it equals. Rows with equal doc_id never remove anything from one another. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, fresh, pieces, stored

#: Words of a window; a perfect difference cover and its period (fixed values); words of an anchor.
WINDOW, PERIOD = 50, 31
COVER = [1, 5, 11, 24, 25, 27]
ANCHOR = WINDOW - PERIOD + 1
#: Anchors or windows that a task combines at a time.
COMBINED = 1_500_000
_LAST = (1 << 63) - 1

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASES = {"byte": 0x9E3779B97F4A7C15, "one": 0xC2B2AE3D27D4EB4F, "two": 0xD6E8FEB86659FD93}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo 2**64, and of its inverse."""
    if name not in _powers or len(_powers[name][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for base in (_BASES[name], pow(_BASES[name], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[name] = (out[0], out[1])
    up, down = _powers[name]
    return up[:n], down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


class Hashed:
    """Hashes of a text's words, and of any run of them, from running sums."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        gap = np.concatenate([[True], _SPACE[raw], [True]])
        turns = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = turns[::2], turns[1::2]
        self.n = len(start)
        up, down = _power("byte", len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)])])
        self.words = _mixed((sums[end] - sums[start]) * down[start])
        self.sums = {}

    def runs(self, start: np.ndarray, end: np.ndarray, name: str = "one") -> np.ndarray:
        """Hash of the words from start up to end, for each pair."""
        up, down = _power(name, self.n + 1)
        if name not in self.sums:
            words = self.words if name == "one" else _mixed(self.words + _U(1))
            self.sums[name] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: self.n])])
        sums = self.sums[name]
        return _mixed((sums[end] - sums[start]) * down[start])


_cover_at: list[np.ndarray] = [np.empty(0, np.int64)]


def anchors(h: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, their hashes, and their hashes in context."""
    last = h.n - ANCHOR
    if not len(_cover_at[0]) or _cover_at[0][-1] < last:
        size = max(1 << 12, 2 * (last + PERIOD))
        _cover_at[0] = np.flatnonzero(np.isin(np.arange(size) % PERIOD, COVER))
    at = _cover_at[0][: int(np.searchsorted(_cover_at[0], last, side="right"))]
    low, high = np.maximum(0, at - (PERIOD - 1)), np.minimum(h.n, at + WINDOW)
    context = h.runs(low, high) + (at - low).astype(np.uint64) * _U(0x9FB21C651E98DF25) + (high - at).astype(np.uint64) * _U(0xA0761D6478BD642F)
    return at, h.runs(at, at + ANCHOR), _mixed(context)


def starts_over(at: np.ndarray, n: int) -> np.ndarray:
    """For each place where a window may start, whether it holds one of the anchors."""
    marks = np.zeros(n + 2, np.int64)
    np.add.at(marks, np.maximum(0, at - (PERIOD - 1)), 1)
    np.add.at(marks, at + 1, -1)
    return np.cumsum(marks)[: n - WINDOW + 1] > 0


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _combined_anchors(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Distinct (anchor, context, document) of a task with what is known there.

    kind 1: another document of the task with a smaller id has the same context. Of an anchor's contexts two are kept
    (kind 0), enough for other tasks to see that there are several; the rest is to check in any case (kind 2).
    """
    order = np.lexsort((doc, c, h))
    h, c, doc = h[order], c[order], doc[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    new = new_c | np.concatenate([[True], doc[1:] != doc[:-1]])
    h, c, doc, new_h, new_c = h[new], c[new], doc[new], new_h[new], new_c[new]
    classes = np.cumsum(new_c)
    rank = classes - classes[np.flatnonzero(new_h)][np.cumsum(new_h) - 1]
    kind = np.where(~new_c, 1, np.where(rank >= 2, 2, 0)).astype(np.int8)
    key = np.where(kind == 0, h, _mixed(c ^ _mixed(doc.view(np.uint64))))
    return pa.RecordBatch.from_arrays([_long(key), _long(c), _long(doc), pa.array(kind)], names=["key", "c", "doc", "kind"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in pieces(batches):
        for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
            if len(text) < 2 * WINDOW - 1:
                continue
            words = Hashed(text)
            if words.n < WINDOW:
                continue
            at, h, c = anchors(words)
            held.append((h, c, np.full(len(at), doc, np.int64)))
            size += len(at)
            if size >= COMBINED:
                yield _combined_anchors(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield _combined_anchors(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _combined_windows(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Distinct (window, document) of a task; kind 1: a smaller id of the task has the same window."""
    order = np.lexsort((doc, two, one))
    one, two, doc = one[order], two[order], doc[order]
    first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    new = first | np.concatenate([[True], doc[1:] != doc[:-1]])
    one, two, doc, first = one[new], two[new], doc[new], first[new]
    kind = np.where(first, 0, 1).astype(np.int8)
    key = np.where(first, one, _mixed(one ^ _mixed(doc.view(np.uint64))))
    return pa.RecordBatch.from_arrays([_long(key), _long(one), _long(two), _long(doc), pa.array(kind)], names=["key", "one", "two", "doc", "kind"])


def _longs(column: pa.Array, i: int) -> np.ndarray:
    value = column[i]
    return np.empty(0, np.uint64) if not value.is_valid else value.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _open_windows(words: Hashed, covered: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where the windows over anchors to check start that no covered anchor settles."""
    at, _, c = anchors(words)
    open_ = starts_over(at[np.isin(c, check)], words.n)
    if len(covered):
        open_ &= ~starts_over(at[np.isin(c, covered)], words.n)
    return np.flatnonzero(open_)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open windows of (doc, text, covered, check), combined."""
    held: list[tuple] = []
    size = 0
    for batch in pieces(batches):
        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True)):
            words = Hashed(text)
            if words.n < WINDOW:
                continue
            start = _open_windows(words, _longs(batch.column(2), i), _longs(batch.column(3), i))
            held.append((words.runs(start, start + WINDOW), words.runs(start, start + WINDOW, "two"), np.full(len(start), doc, np.int64)))
            size += len(start)
            if size >= COMBINED:
                yield _combined_windows(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield _combined_windows(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _own_rows(batches: Iterator[pa.RecordBatch], windows: bool) -> Iterator[pa.RecordBatch]:
    """(doc, mark, c): the contexts of each text's anchors, or with ``windows`` its open windows, from (doc, text, mark, ...)."""
    for batch in pieces(batches):
        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True)):
            words = Hashed(text)
            if words.n < WINDOW:
                continue
            if windows:
                start = _open_windows(words, _longs(batch.column(3), i), _longs(batch.column(4), i))
                c = np.unique(words.runs(start, start + WINDOW))
            else:
                c = np.unique(anchors(words)[2])
            mark = batch.column(2)[i].as_py()
            yield pa.RecordBatch.from_arrays([_long(np.full(len(c), doc, np.int64)), _long(np.full(len(c), mark, np.int64)), _long(c)], names=["doc", "mark", "c"])


def kept_words(text: bytes, covered: np.ndarray, windows: np.ndarray) -> tuple[list[bytes], int]:
    """Words that stay, and how many there were, given hashes of covered anchors in context and of repeated windows."""
    found = text.split()
    n = len(found)
    if n < WINDOW or not (len(covered) or len(windows)):
        return found, n
    words = Hashed(text)
    gone = np.zeros(n - WINDOW + 1, bool)
    if len(covered):
        at, _, c = anchors(words)
        gone |= starts_over(at[np.isin(c, covered)], n)
    if len(windows):
        start = np.arange(n - WINDOW + 1)
        gone |= np.isin(words.runs(start, start + WINDOW), windows)
    marks = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(gone)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + WINDOW, -1)
    return list(compress(found, (np.cumsum(marks)[:n] == 0).tolist())), n


def _placed(docs: DataFrame, doc: str, mark: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``doc``, their order, and ``mark``, which tells apart texts of one doc; and the docs of several texts.

    Rows without doc_id rank last, with one another and with an id of 2**63 - 1. Where a doc has one text only, which is
    the rule, mark is 0; elsewhere it is a hash of the text, so that what is known of a text is gathered by itself.
    """
    rows = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = rows.select(F.col(doc).alias("doc"), text.alias("text")).groupBy("doc").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    several = stored(texts.filter("a <> b").select("doc"), "substring-several")
    if several.isEmpty():
        return rows.withColumn(mark, F.lit(0).cast("bigint")), None
    named = fresh("several", rows.columns)
    rows = rows.join(several.select(F.col("doc").alias(named)), F.col(doc) == F.col(named), "left")
    return rows.withColumn(mark, F.when(F.col(named).isNull(), 0).otherwise(F.coalesce(F.nullif(text, F.lit(0)), F.lit(1)))).drop(named), several


def _dealt(fates: DataFrame, rows: DataFrame, several: DataFrame | None, columns: list[str], windows: bool = False) -> DataFrame:
    """(doc, mark, *columns) of fates (doc, *columns): one row of a doc and hash goes to each text of the doc that has it.

    ``columns`` of a row hold its hash or null. The texts' own hashes meet the fates by doc and hash, so a row that many
    texts of one doc share is met once by each of them, and no list is longer than its text.
    """
    if several is None:
        return fates.withColumn("mark", F.lit(0).cast("bigint"))
    fates = stored(fates, "substring-fates")
    alone = fates.join(several, "doc", "left_anti").withColumn("mark", F.lit(0).cast("bigint"))
    known = fates.join(several, "doc", "left_semi").groupBy("doc", F.coalesce(*columns).alias("c")).agg(*(F.max(n).alias(n) for n in columns))
    own = rows.filter("mark <> 0").mapInArrow(lambda b: _own_rows(b, windows), "doc long, mark long, c long")
    return alone.select("doc", "mark", *columns).unionByName(own.join(known, ["doc", "c"]).select("doc", "mark", *columns))


def repeats(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    """What texts have to remove: (doc, mark, covered, windows), hashes of anchors in context and of windows.

    ``rows`` hold doc, text and mark, ``several`` the docs of several texts, both as ``_placed`` gives them.
    """
    found = rows.select("doc", "text").mapInArrow(_anchor_rows, "key long, c long, doc long, kind byte")
    shared = F.when(F.col("kind") == 0, F.col("c"))
    # by key first: the rows then lie right for both windows
    found = found.withColumn("several", F.min(shared).over(Window.partitionBy("key")) < F.max(shared).over(Window.partitionBy("key")))
    found = found.withColumn("least", F.min(F.when(F.col("kind") == 0, F.col("doc"))).over(Window.partitionBy("key", "c")))
    covered = (F.col("kind") == 1) | (F.col("kind") == 0) & (F.col("doc") > F.col("least"))
    check = (F.col("kind") == 2) | (F.col("kind") == 0) & F.col("several") & ~covered
    fates = found.select("doc", F.when(covered, F.col("c")).alias("covered"), F.when(check, F.col("c")).alias("check")).filter("covered is not null or check is not null")
    fates = _dealt(fates, rows.select("doc", "text", "mark"), several, ["covered", "check"])
    key = ["doc"] if several is None else ["doc", "mark"]
    none = F.lit(0).cast("bigint").alias("mark")
    marks = stored(fates.groupBy(*key).agg(F.collect_list("covered").alias("covered"), F.collect_list("check").alias("check")), "substring-anchors")
    asked = rows.join(marks.filter(F.size("check") > 0), key).select("doc", "text", "mark", "covered", "check")
    seen = asked.select("doc", "text", "covered", "check").mapInArrow(_window_rows, "key long, one long, two long, doc long, kind byte")
    least = F.min(F.when(F.col("kind") == 0, F.col("doc"))).over(Window.partitionBy("key", "one", "two"))
    seen = seen.withColumn("least", least).filter((F.col("kind") == 1) | (F.col("doc") > F.col("least")))
    again = _dealt(seen.select("doc", F.col("one").alias("window")), asked, several, ["window"], windows=True)
    windows = stored(again.groupBy(*key).agg(F.collect_list("window").alias("windows")), "substring-windows")
    what = marks.filter(F.size("covered") > 0).select(*key, "covered").join(windows, key, "full")
    return what.select("doc", none if several is None else F.col("mark"), "covered", "windows")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        n_words, n_removed, digests = [], [], []
        for i, text in enumerate(byte_texts(batch.column(1))):
            kept, n = kept_words(text, _longs(batch.column(2), i), _longs(batch.column(3), i))
            n_words.append(n)
            n_removed.append(n - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def removal_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    rows, several = _placed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc", "mark")
    key = ["doc"] if several is None else ["doc", "mark"]
    what = repeats(rows, several)
    rows = rows.join(what.drop("mark") if several is None else what, key, "left").select("doc_id", "text", "covered", "windows")
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _stripped(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, text=text):
        last = batch.num_columns - 2
        out, stay = [], []
        for i, raw in enumerate(batch.column(text).to_pylist()):
            stay.append(True)
            covered, windows = _longs(batch.column(last), i), _longs(batch.column(last + 1), i)
            if raw is None or not (len(covered) or len(windows)):
                out.append(raw)
                continue
            kept, n = kept_words(raw.encode(), covered, windows)
            out.append(raw if len(kept) == n else b" ".join(kept).decode())
            stay[-1] = len(kept) > 0
        arrays = [pa.array(out, pa.string()) if i == text else batch.column(i) for i in range(last)]
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:last]).filter(pa.array(stay))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents in their own columns, their texts without repeated passages; untouched texts stay as they are.

    A document of which nothing is left goes; one that came without words stays.
    """
    doc, mark, a, b, of_doc, of_mark = (fresh(n, docs.columns) for n in ("doc", "mark", "covered", "windows", "of_doc", "of_mark"))
    rows, several = _placed(docs, doc, mark)
    of = rows.select(F.col(doc).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.col(mark).alias("mark"))
    what = repeats(of, several).toDF(of_doc, of_mark, a, b)
    same = F.col(doc) == F.col(of_doc)
    if several is not None:
        same &= F.col(mark) == F.col(of_mark)
    rows = rows.join(what, same, "left").select(*docs.columns, a, b)
    at = docs.columns.index("text")
    return rows.mapInArrow(lambda batches: _stripped(batches, at), docs.schema)
