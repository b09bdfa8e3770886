"""SentencePiece encoding and decoding with a given model, by a shared-prefix forward pass.

Texts are marked the model's way (a dummy prefix, spaces as U+2581) and cut where no piece reaches over. The distinct
marked words of a batch are sorted, which makes them the paths of a trie in depth-first order; the forward states of a
prefix (its best last piece, and for unigram models its score) are computed once for all words that begin with it,
and a word's pieces are read from its end.

Unigram models take the path with the highest sum of piece scores (Viterbi). For BPE models that path is not what
their merges give, so the state follows the merges instead: the last piece of a prefix is the one piece there that
merges neither with nor into the last piece before it; this gives the library's ids. Characters without a piece become
byte pieces, or the unknown id where the model has none.

Models are read, never trained; their path is a parameter, and tasks get the pieces (of the vocabulary's fixed size)
with the job. Defined results: a null text is empty; an empty text has no ids and decodes to itself. A text that holds
U+2581 itself decodes to spaces there, as with the library. Words of any length work; repeated rows are encoded one by
one. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import importlib.util
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

MARK = "▁"
#: Distinct words of which a task remembers the pieces before it starts anew, and pairs of pieces.
WORDS_KEPT, PAIRS_KEPT = 500_000, 500_000


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """Path of an installed public model."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.submodule_search_locations:
        raise FileNotFoundError("public_tokenizers is not installed; give the path of a model")
    return os.path.join(list(spec.submodule_search_locations)[0], name)


class Vocabulary:
    """A model's pieces and how it marks texts; small enough to go with a job."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        self.unigram = proto.trainer_spec.model_type == 1
        self.prefix = norm.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.unknown, self.bytes = 0, [-1] * 256
        self.raw: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            raw = p.piece.replace(MARK, " ").encode()
            if p.type == 2:
                self.unknown, raw = i, " ⁇ ".encode()
            elif p.type == 3:
                raw = b""
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                raw = bytes([int(p.piece[3:5], 16)])
            else:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
            self.raw.append(raw)
        self.longest = max(map(len, self.ids), default=1)
        self.low = min(self.scores.values(), default=0.0) - 10.0
        inner = [p for p in self.ids if MARK in p.lstrip(MARK)]
        alone = [c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.ids)]
        solo = "".join(map(re.escape, alone))
        self.cut = None if inner else (f"[{solo}]|" if solo else "") + f"{MARK}*[^{MARK}{solo}]+|{MARK}+"

    def fallback(self, c: str) -> list[int]:
        """Ids of a character without a piece."""
        if -1 in self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]


class Encoder:
    """Ids of marked words; what it has found is kept up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[tuple[str, str], bool] = {}
        self.forget()
        self.endings: dict = {}
        for piece in () if vocabulary.unigram else vocabulary.ids:
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        self.split = re.compile(vocabulary.cut).findall if vocabulary.cut else lambda text: [text] if text else []

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.found: list[np.ndarray] = []
        self.starts = self.lengths = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging neighbours, the highest score first, then the leftmost."""
        scores, at = self.v.scores, list(text)
        right, left = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
        heap = [(-scores[p], i, p) for i in range(len(at) - 1) if (p := at[i] + at[i + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = right[i] if at[i] else len(at)
            if not at[i] or j >= len(at) or at[i] + at[j] != piece:
                continue
            at[i], at[j], right[i] = piece, "", right[j]
            if right[i] < len(at):
                left[right[i]] = i
                if (p := piece + at[right[i]]) in scores:
                    heapq.heappush(heap, (-scores[p], i, p))
            if left[i] >= 0 and (p := at[left[i]] + piece) in scores:
                heapq.heappush(heap, (-scores[p], left[i], p))
        return [p for p in at if p]

    def _fit(self, before: str, piece: str) -> bool:
        """Whether merging leaves the two pieces as they are, side by side."""
        key = (before, piece)
        out = self.fits.get(key)
        if out is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            out = self.fits[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return out

    def _extend_merges(self, word: str, last: list[str]) -> None:
        """Last pieces of the word's prefixes that are longer than those in ``last``."""
        fits, fit = self.fits, self._fit
        for end in range(len(last), len(word) + 1):
            node, start = self.endings, end
            while start:  # the pieces that end here, found from their last characters on
                start -= 1
                node = node.get(word[start])
                if node is None:
                    break
                piece = node.get("")
                if piece is None:
                    continue
                if start:
                    before = last[start]
                    good = fits.get((before, piece))
                    if not (fit(before, piece) if good is None else good):
                        continue
                elif end > 1 and not self._fit("", piece):
                    continue
                last.append(piece)
                break
            if len(last) == end:  # a character without a piece stands alone
                last.append(word[end - 1])

    def _extend_scores(self, word: str, last: list[str], best: list[float]) -> None:
        scores, low, longest = self.v.scores, self.v.low, self.v.longest
        for end in range(len(last), len(word) + 1):
            top, choice = -float("inf"), ""
            for start in range(max(0, end - longest), end):
                piece = word[start:end]
                score = scores.get(piece)
                if score is None:
                    if end - start > 1:
                        continue
                    score = low
                if best[start] + score > top:
                    top, choice = best[start] + score, piece
            last.append(choice)
            best.append(top)

    def learn(self, words: Iterable[str]) -> None:
        """Pieces of new words: in sorted order each keeps the states of the prefix that it shares with the one before."""
        last, best, before = [""], [0.0], ""
        ids, fallback = self.v.ids, self.v.fallback
        found = []
        for word in sorted(words):
            common = len(os.path.commonprefix((before, word)))
            del last[common + 1 :], best[common + 1 :]
            if self.v.unigram:
                self._extend_scores(word, last, best)
            else:
                self._extend_merges(word, last)
            out: list[list[int]] = []
            end = len(word)
            while end:
                piece = last[end]
                i = ids.get(piece)
                out.append([i] if i is not None else fallback(piece))
                end -= len(piece)
            self.known[word] = len(self.known)
            found.append(np.array([i for part in reversed(out) for i in part], np.int32))
            before = word
        if found:
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, found), np.int64, len(found))])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.pool = np.concatenate([self.pool, *found])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all texts' ids one after another, and where each text's end."""
        if len(self.known) > WORDS_KEPT:
            self.forget()
        prefix = MARK if self.v.prefix else ""
        words = [self.split(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn({w for ws in words for w in ws}.difference(self.known))
        at = np.fromiter((self.known[w] for ws in words for w in ws), np.int64)
        n = self.lengths[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)]
        of = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        return ids, np.concatenate([[0], ends])[of]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of some ids; bytes that aren't UTF-8 become U+FFFD."""
    raw = b"".join(map(vocabulary.raw.__getitem__, ids))
    if vocabulary.prefix and raw.startswith(b" "):
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every document; round_trip: the ids decode to the text."""
    vocabulary = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in pieces(batches, most=2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, ends = encoder.encode(texts)
            offsets = np.concatenate([[0], ends])
            same = [decode(vocabulary, ids[a:b].tolist()) == t for a, b, t in zip(offsets[:-1], offsets[1:], texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            arrays = [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_pieces", "ids", "round_trip"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces bigint, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    vocabulary = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(vocabulary, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
