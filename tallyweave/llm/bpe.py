"""BPE encoding and decoding with a given tokenizer file: frequent words by a minimal acyclic transducer, others by merging.

A text falls into chunks at ASCII white space; what the tokenizer does to a chunk depends on the chunk alone. A chunk is
normalised (NFC, white space, lower case) and cut into words by the file's pattern; a word's ids come from its merges.

The words of all texts are counted with Spark, and the most frequent ones (up to ``LEXICON`` of them, of up to ``LONGEST``
bytes, all whose count lies above a limit that a histogram of the counts gives) are compiled into a lexicon: the minimal automaton of the sorted words, whose equal suffixes are shared, with
additive outputs on its arcs. The outputs along a word's path sum up to its number, and a table has the ids of each
number. The lexicon is one file in the shared folder, which Spark hands to every executor and tasks map into memory, so
the workers of a machine share its pages. A task looks all distinct words of a batch up at once, one letter of each at a
time. Words that the lexicon doesn't have are merged, exactly, one by one; the lexicon decides nothing but speed.

Ids are packed as little-endian unsigned 32-bit integers, the form in which training reads them. Decoding joins the
tokens' strings by single spaces, as the file, which has no decoder, asks for; ids without a token are left out.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text. The file's special tokens
stand for themselves where a text holds their strings. Words of any length are merged in time near to linear. Repeated
rows are encoded one by one. An empty table gives no rows. Only doc_id and text are read. The tokenizer file is read on
the driver; its vocabulary goes with the jobs.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, pieces, shared_dir, stored

#: Words of the lexicon at the most, and bytes of its longest.
LEXICON, LONGEST = 262_144, 48
#: Bytes of text that a task works on at a time, chunks of each of the two generations that it remembers, and chunks that it counts before it passes their words on.
PIECE, CHUNKS_KEPT, CHUNKS_COUNTED = 2 << 20, 150_000, 400_000
#: Symbols of a word from which on the next merge is sought with a heap.
MANY = 96

_SHIFT = 20
_MASK = (1 << _SHIFT) - 1
_NONE = 1 << 62
#: What the file has to ask for (fixed values): its normaliser and the words of its pattern.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern over lower-cased ASCII.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
#: The same over texts of Latin letters and common punctuation, of which every Unicode version says the same.
_LATIN = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]+")
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", "\x09-\x0d\x20\x85\xa0"
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return [out.get(b) or chr(256 + sum(1 for x in range(b) if x not in out)) for b in range(256)]


class Tokenizer:
    """A tokenizer file's merges, tokens and special tokens; small enough to go with a job."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        split = cut[0]["type"] == "Split" and cut[0]["pattern"] == {"Regex": _PATTERN} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        level = len(cut) == 2 and cut[1]["type"] == "ByteLevel" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        if not (plain and split and level and spec["normalizer"].get("normalizers") == _NORMALIZERS and spec["decoder"] is None):
            raise ValueError("only BPE over bytes with this pattern and normaliser, and without a decoder, is supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.first, self.last = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << _SHIFT | vocab[b], rank << _SHIFT | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only special tokens that stand for themselves are supported")
        tokens = vocab | self.special
        self.tokens: list[bytes | None] = [None] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.tokens[i] = token.encode()

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: of all neighbours that merge, those with the lowest rank do, the leftmost of equal ones, until none does."""
        ids = list(map(self.first.__getitem__, word))
        ids[-1] = self.last[word[-1]]
        if len(ids) > MANY:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(a << _SHIFT | b, _NONE) for a, b in pairwise(ids)]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low & _MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _SHIFT | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << _SHIFT | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between what is left."""
        get, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = lambda i: get(ids[i] << _SHIFT | ids[after[i]], _NONE) if after[i] >= 0 else _NONE
        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r & _MASK, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) != _NONE:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]


class Cutter:
    """Words of chunks; the Unicode rules, for chunks that aren't ASCII, are the tokenizer library's own."""

    def __init__(self, special: Iterable[str]):
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(_PATTERN), "removed", invert=True)
        names = sorted(special, key=lambda s: (-len(s), s))
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _normalised(self, texts: list[str]) -> list[str]:
        """Each text normalised; those without white space all at once, as nothing composes over a space."""
        out, whole = [""] * len(texts), []
        for i, t in enumerate(texts):
            if len(t.split()) == 1 and not t[0].isspace() and not t[-1].isspace():
                whole.append(i)
            else:
                out[i] = self.normalizer.normalize_str(t)
        made = self.normalizer.normalize_str(" ".join([texts[i] for i in whole])).split(" ") if whole else []
        for i, t in zip(whole, made, strict=True):
            out[i] = t
        return out

    def _cut(self, text: str) -> list[bytes]:
        words = _LATIN_WORDS.findall(text) if _LATIN.fullmatch(text) else [w for w, _ in self.splitter.pre_tokenize_str(text)]
        return [w.encode() for w in words]

    def parts(self, chunks: list[bytes]) -> list[list[str | bytes]]:
        """The words of each chunk, and its special tokens as texts."""
        out: list[list[str | bytes]] = [[]] * len(chunks)
        others = []
        for i, chunk in enumerate(chunks):
            if chunk.isalpha():
                out[i] = [chunk.lower()]
            elif self.special is not None and b"<" in chunk and len(split := self.special.split(chunk.decode())) > 1:
                cut = iter(self.parts([x.encode() for x in split[::2]]))
                out[i] = [w for k, x in enumerate(split) for w in ([x] if k % 2 else next(cut))]
            elif chunk.isascii():
                out[i] = _ASCII.findall(chunk.lower())
            else:
                others.append(i)
        for i, text in zip(others, self._normalised([chunks[i].decode() for i in others]), strict=True):
            out[i] = self._cut(text)
        return out


def automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted words, with outputs that number them.

    key: state and letter of each arc, rising; target: the state it leads to; add: how many words leave or end before
    it, seen from its state; final: whether a word ends in a state; root: the first state.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    open_: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]

    def settled(final: bool, arcs: tuple) -> int:
        i = known.setdefault((final, arcs), len(states))
        if i == len(states):
            states.append((final, arcs))
        return i

    before = b""
    for word in [*words, b""]:
        common = len(os.path.commonprefix((before, word)))
        while len(open_) > common + 1:
            final, arcs = open_.pop()
            open_[-1][1].append((before[len(open_) - 1], settled(final[0], tuple(arcs))))
        open_ += [([False], []) for _ in word[common:]]
        if word:
            open_[-1][0][0] = True
        before = word
    root = settled(open_[0][0][0], tuple(open_[0][1]))
    count: list[int] = []
    key, target, add = [], [], []
    for i, (final, arcs) in enumerate(states):  # targets come before their sources
        passed = int(final)
        for letter, to in arcs:
            key.append(i << 8 | letter)
            target.append(to)
            add.append(passed)
            passed += count[to]
        count.append(passed)
    arrays = {"key": np.array(key, np.uint32), "target": np.array(target, np.int32), "add": np.array(add, np.int32)}
    return arrays | {"final": np.array([f for f, _ in states], np.uint8), "root": np.array([root], np.int32)}


def numbers(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The number of each word in the lexicon, -1 where it has none; all words go one letter on at a time."""
    out = np.full(len(words), -1, np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    at = np.flatnonzero((length > 0) & (length <= LONGEST))
    if not len(at) or not len(lexicon["key"]):
        return out
    order = at[np.argsort(-length[at], kind="stable")]  # longest first: those that go on are always the first ones
    letters = np.array([words[i] for i in order], f"S{LONGEST}").view(np.uint8).reshape(len(order), LONGEST)
    left = length[order]
    key, target, add = lexicon["key"], lexicon["target"], lexicon["add"]
    state, total = np.full(len(order), int(lexicon["root"][0]), np.int64), np.zeros(len(order), np.int64)
    for step in range(int(left[0])):
        n = int(np.searchsorted(-left, -step, side="left"))
        wanted = state[:n] << 8 | letters[:n, step]
        live = state[:n] >= 0
        arc = np.minimum(np.searchsorted(key, np.where(live, wanted, 0).astype(np.uint32)), len(key) - 1)
        hit = live & (key[arc] == wanted)
        total[:n] += np.where(hit, add[arc], 0)
        state[:n] = np.where(hit, target[arc], -1)
    ends = (state >= 0) & (lexicon["final"][np.maximum(state, 0)] > 0)
    out[order[ends]] = total[ends]
    return out


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one file: a line that says what is where, then the arrays at multiples of 64 bytes."""
    places = list(accumulate((-(-a.nbytes // 64) * 64 for a in arrays.values()), initial=0))
    head = json.dumps({k: [a.dtype.str, len(a), p] for (k, a), p in zip(arrays.items(), places, strict=False)}).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 64) for a in arrays.values())


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file that ``packed`` made, mapped into memory."""
    whole = np.memmap(path, np.uint8, "r")
    with open(path, "rb") as f:
        head = f.readline()
    out = {}
    for name, (kind, n, place) in json.loads(head).items():
        start = len(head) + place
        out[name] = whole[start : start + n * np.dtype(kind).itemsize].view(kind)
    return out


class Encoder:
    """Ids of texts in one task: words from the lexicon, others merged.

    Chunks are remembered in two generations: those that the present one hasn't seen are taken over from the one before,
    so frequent ones stay and others go.
    """

    def __init__(self, tokenizer: Tokenizer, lexicon: dict[str, np.ndarray]):
        self.t, self.lexicon, self.cutter = tokenizer, lexicon, Cutter(tokenizer.special)
        self.of: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in tokenizer.special.items()}
        self.ids, self.ends = memoryview(lexicon["ids"]).cast("B"), np.append(lexicon["ends"], 0).astype(np.int64) * 4

    def learn(self, chunks: list[bytes]) -> None:
        """Packed ids of new chunks."""
        parts = self.cutter.parts(chunks)
        words = list({w for ws in parts for w in ws if isinstance(w, bytes)})
        number = numbers(self.lexicon, words)
        ids, merge = self.ids, self.t.merge
        spans = zip(words, number.tolist(), self.ends[number].tolist(), self.ends[number + 1].tolist(), strict=True)
        known: dict[str | bytes, bytes] = {w: bytes(ids[a:b]) if i >= 0 else np.array(merge(w), "<u4").tobytes() for w, i, a, b in spans}
        known |= self.special
        self.of |= {c: known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for c, ws in zip(chunks, parts, strict=True)}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.of) > CHUNKS_KEPT:
            self.of, self.before = {}, self.of
        split = [t.split() for t in texts]
        new = {c for cs in split for c in cs}.difference(self.of)
        again = new.intersection(self.before)
        self.of |= {c: self.before[c] for c in again}
        new = list(new - again)
        self.learn(new)
        out = [b"".join(map(self.of.__getitem__, cs)) for cs in split]
        for chunk in new:
            if len(chunk) > 8 * LONGEST:  # long ones aren't remembered
                del self.of[chunk]
        return out


def word_counts(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(word, n) of all words of up to LONGEST bytes in all texts; tasks add up what they have before it is shuffled."""
    special = list(tokenizer.special)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, chunks = Cutter(special), Counter()

        def out() -> pa.RecordBatch:
            held: Counter[bytes] = Counter()
            for words, n in zip(cutter.parts(list(chunks)), chunks.values(), strict=True):
                for word in words:
                    if isinstance(word, bytes) and len(word) <= LONGEST:
                        held[word] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in pieces(batches, text=0, most=PIECE):
            for text in byte_texts(batch.column(0)):
                chunks.update(text.split())
            if len(chunks) > CHUNKS_COUNTED:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[bytes]:
    """The most frequent words of (word, n): all those above the lowest limit that ``most`` of them at the most reach.

    The limit comes from a histogram of the counts in eighths of powers of two, so no task and not the driver sees more.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    taken, limit = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # 512 rows at the most
        taken += r.words
        if taken > most:
            break
        limit = r.step
    return [] if limit is None else counts.filter(step >= limit).select("word").toArrow().column(0).to_pylist()


def lexicon_of(tokenizer: Tokenizer, words: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The lexicon of some words, with their ids."""
    ordered = sorted(words)
    ids = [tokenizer.merge(w) for w in ordered]
    ends = np.fromiter(accumulate(map(len, ids), initial=0), np.uint32, len(ids) + 1)
    return automaton(ordered) | {"ids": np.array([i for x in ids for i in x], "<u4"), "ends": ends}


def _handed_out(spark: SparkSession, data: bytes) -> str:
    """``data`` as a file of the shared folder that Spark brings to every executor; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark).rstrip('/')}/{name}"
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def encoded(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """(doc_id, ids) of every document, ids packed; ``path`` is a tokenizer file, ``most`` the words of the lexicon."""
    tokenizer = Tokenizer(path)
    counts = stored(word_counts(docs, tokenizer), "bpe-words")
    name = _handed_out(docs.sparkSession, packed(lexicon_of(tokenizer, frequent(counts, most))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, mapped(SparkFiles.get(name)))
        for batch in pieces(batches, most=PIECE):
            ids = encoder.encode(byte_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with the text that the ids decode to."""
    table = Tokenizer(path).tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            texts = []
            for ids in byte_texts(batch.column(1)):
                i = np.frombuffer(ids, "<u4")
                texts.append(b" ".join(filter(None, map(table.__getitem__, i[i < len(table)].tolist()))).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def digests(decoded_: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, text)."""
    return decoded_.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
