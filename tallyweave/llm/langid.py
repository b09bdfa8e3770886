"""Language identification with bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of its most frequent n-grams of letters. The filters lie side by side as slices: a
cell is a bitmask with a bit per language, in as many words of 64 bits as the languages need, so the AND of an
n-gram's cells gives all languages that have it at once.
The bits are counted per language over a text; what the filter's false positives add on average is taken off; the
language with the highest corrected count wins.

The profiles are learned from a bounded sample: about ``sample`` documents of each language, chosen by a hash of
doc_id; further documents change nothing. All languages of the documents are told apart. Only the text is an input of
a prediction.

Defined results: ``und`` with score 0 for a null text, an empty one or one without a letter, and for all texts when
there is nothing to learn from. A text with letters but no known n-gram gets the language with the most documents, score
0. Ties go to the language with more documents, then the smaller name. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, pieces

#: Lengths of n-grams, n-grams kept of a language, cells per n-gram, and bits of the cell index per kept n-gram.
LENGTHS, KEPT, HASHES, CELLS_PER_GRAM = (3, 4), 600, 3, 32

_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_BASE = np.uint64(0x100000001B3)
_alpha: dict[str, np.ndarray] = {}


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _is_letter(points: np.ndarray) -> np.ndarray:
    if "bmp" not in _alpha:
        _alpha["bmp"] = np.array([chr(i).isalpha() for i in range(0x10000)])
    out = _alpha["bmp"][np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        out[i] = chr(points[i]).isalpha()
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of each n-gram, and whether each text has a letter. A word's two ends count as a character."""
    joined = " " + " ".join(t.lower() for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])
    letter = _is_letter(points)
    keep = letter | np.concatenate([[True], letter[:-1]])  # one separator after each word
    of = (np.cumsum(np.bincount(np.minimum(starts[1:], len(points) - 1), minlength=len(points))))[keep] if len(texts) else np.empty(0, np.int64)
    of = np.minimum(of, max(0, len(texts) - 1))
    c, letter = np.where(letter, points, 0)[keep].astype(np.uint64), letter[keep]
    has = np.bincount(of[letter], minlength=len(texts)) > 0
    found, where = [], []
    for n in LENGTHS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h, good = np.full(m, n, np.uint64), np.zeros(m, bool)
        for i in range(n):
            h = h * _BASE + c[i : i + m]
            good |= letter[i : i + m]
        for i in range(1, n - 1):
            good &= letter[i : i + m]  # no n-gram reaches over a separator
        if n == 2:
            good = letter[:m] | letter[1 : 1 + m]
        at = np.flatnonzero(good)
        inner = at + np.where(letter[at], 0, 1)  # the first letter's text
        found.append((h[at] ^ (h[at] >> np.uint64(15))) * _SEEDS[0])
        where.append(of[inner])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    return np.concatenate(found), np.concatenate(where), has


def _cells(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of n-grams in a filter of ``size`` cells, a power of two."""
    shift = np.uint64(64 - (size.bit_length() - 1))
    return [((h ^ (h >> np.uint64(31))) * s) >> shift for s in _SEEDS[:HASHES]]


@dataclass(frozen=True)
class Model:
    """Languages, the sliced filter of the first 64, each slice's rate of false positives, and filters of further 64s."""

    languages: list[str]
    cells: np.ndarray
    wrong: np.ndarray
    more: np.ndarray


def build(languages: list[str], profiles: dict[str, np.ndarray]) -> Model:
    size = 1 << max(10, (KEPT * CELLS_PER_GRAM - 1).bit_length())
    cells = np.zeros((max(1, -(-len(languages) // 64)), size), np.uint64)
    for i, language in enumerate(languages):
        for at in _cells(profiles.get(language, np.empty(0, np.uint64)), size):
            cells[i // 64, at] |= np.uint64(1 << i % 64)
    full = np.array([((cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, cells[0], full**HASHES, cells[1:])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        langs = batch.column(0).to_pylist()
        h, of, _ = grams([t or "" for t in batch.column(1).to_pylist()])
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs])[of]
        for i, name in enumerate(names):
            values, n = np.unique(h[of == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, sample: int = 2000) -> Model:
    """A model from (doc_id, text, lang); rows without lang are left out, and those whose lang is ``und``, which names no
    language. What reaches the driver: a profile of each language.
    """
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and lang <> 'und'")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in counts]
    if not languages:
        return build([], {})
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in counts], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    some = known.join(F.broadcast(share), "lang").filter(chance < F.col("share")).select("lang", "text")
    sums = some.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= KEPT).select("lang", "gram").collect()
    lists: dict[str, list[int]] = {}
    for r in top:
        lists.setdefault(r["lang"], []).append(r["gram"])
    return build(languages, {k: np.array(sorted(v), np.int64).view(np.uint64) for k, v in lists.items()})


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (the winner's share of its count and the runner-up's), and the share of n-grams that it has."""
    h, of, has = grams([t or "" for t in texts])
    n = np.bincount(of, minlength=len(texts)).astype(float)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    hits = np.empty((len(texts), len(model.languages)), np.int64)
    places = _cells(h, len(model.cells))
    for word, cells in enumerate([model.cells, *model.more]):
        mask = np.full(len(h), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in places:
            mask &= cells[at]
        for i in range(64 * word, min(64 * word + 64, len(model.languages))):
            hits[:, i] = np.bincount(of[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
    true = np.maximum(0.0, (hits - n[:, None] * model.wrong) / (1.0 - model.wrong))
    best = true.argmax(axis=1)
    won = true[np.arange(len(texts)), best]
    rest = true.copy()
    rest[np.arange(len(texts)), best] = 0
    second = rest.max(axis=1)
    score = np.where(has & (won > 0), won / np.maximum(won + second, 1e-12), 0.0)
    covered = np.where(n > 0, won / np.maximum(n, 1), 0.0)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, has, strict=True)], score, np.clip(covered, 0.0, 1.0)


def tagged(docs: DataFrame, model: Model, columns: list[str], names: list[str]) -> DataFrame:
    """``columns`` of the documents, then language, score and covered under ``names``. The model is of fixed size."""
    last = len(columns)
    kept = docs.select(*columns, F.col("text").alias(fresh("text", columns)))
    schema = T.StructType([*kept.schema.fields[:last], *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=last):
            lang, score, covered = predict(model, batch.column(last).to_pylist())
            arrays = [*batch.columns[:last], pa.array(lang, pa.string()), pa.array(score), pa.array(covered)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *names])

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, learned: Column, sample: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, covered) of every document; those with ``learned`` may be learned from."""
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows.filter(learned), sample)
    return tagged(rows.withColumn("held_out", F.coalesce(~learned, F.lit(False))), model, ["doc_id", "held_out"], ["lang_pred", "score", "covered"])


def fluent(docs: DataFrame, sample: int = 2000, least: float = 0.15) -> DataFrame:
    """The documents whose language is told: not ``und``, and at least ``least`` of their n-grams are the language's own.

    Where no row has a language (null and ``und`` are none), nothing can be told of any document, and all stay.
    """
    model = learn(docs, sample)
    if not model.languages:
        return docs
    names = [fresh(n, docs.columns) for n in ("lang_pred", "lang_score", "lang_covered")]
    out = tagged(docs, model, docs.columns, names)
    return out.filter((F.col(names[0]) != "und") & (F.col(names[2]) >= least)).select(*docs.columns)
