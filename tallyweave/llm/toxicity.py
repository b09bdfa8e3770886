"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word enters as its embedding, if it is one of the sample's frequent words, and as the last states of a gated
recurrent network that reads its characters in both directions. A second bidirectional network reads the words of a
window; attention pools its states, and a linear unit makes the window's logit. All windows of a text are scored, each
overlapping the next by half. A text's score is a logistic function of the highest window logit, the mean window
probability and the share of likely windows, so that one chance word in a long text doesn't make it toxic.

The network learns from a bounded sample: up to ``most`` documents of each label (those with the smallest hash of
doc_id) and up to ``windows`` windows of each; further labelled documents change nothing. One task trains on the sample;
the others get the weights, whose size is fixed. Only the text is an input of a score.

Defined results: a null or empty text, or one without a letter, has no window and scores 0. Without labels of both
kinds there is nothing to learn and all texts score 0. Words of over ``CHARS`` characters are read in parts, texts are
read whole. Documents without doc_id are scored but not learned from. Repeated rows are scored one by one.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, pieces

#: Words of a window and of its step; characters of a word; sizes of embeddings and states.
SPAN, STEP, CHARS = 32, 16, 16
WORD_DIM, CHAR_DIM, CHAR_STATE, STATE, ATTENTION = 12, 8, 16, 12, 12
#: Words with an embedding, characters with one; words of which a task keeps the inputs.
VOCABULARY, ALPHABET, WORDS_KEPT = 3000, 200, 150_000
#: Learning rate, decay of weights per unit of it, and the share of words shown in training by their letters only.
RATE, DECAY, HIDDEN = 0.015, 0.03, 0.5
_WORD = re.compile(r"[^\W\d_]+")

Weights = dict[str, np.ndarray]


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, long ones in parts."""
    found = _WORD.findall((text or "").lower())
    if any(len(w) > CHARS for w in found):
        found = [w[i : i + CHARS] for w in found for i in range(0, len(w), CHARS)]
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def gru(inputs: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (steps, rows, size) of a gated recurrent network over projected inputs (steps, rows, 3 size).

    Where ``mask`` (steps, rows, 1) is 0 the state stays. With ``keep`` the second result holds what backward needs.
    """
    steps, rows, three = inputs.shape
    size = three // 3
    h = np.zeros((rows, size), np.float32)
    out, kept = np.empty((steps, rows, size), np.float32), []
    for t in range(steps):
        x, g = inputs[t], h @ u
        zr = _sigmoid(x[:, : 2 * size] + g[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(x[:, 2 * size :] + r * g[:, 2 * size :])
        new = n + z * (h - n)
        if mask is not None:
            new = h + mask[t] * (new - h)
        if keep:
            kept.append((h, z, r, n, g[:, 2 * size :]))
        h = out[t] = new
    return out, kept


def gru_backward(d_out: np.ndarray, kept: list, mask: np.ndarray | None, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    steps, rows, size = d_out.shape
    d_in, d_u = np.empty((steps, rows, 3 * size), np.float32), np.zeros_like(u)
    dh = np.zeros((rows, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, hn = kept[t]
        dh = dh + d_out[t]
        d_new = dh if mask is None else dh * mask[t]
        stay = z * d_new if mask is None else z * d_new + dh * (1 - mask[t])
        dn = d_new * (1 - z) * (1 - n * n)
        dz = d_new * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        d_in[t] = np.concatenate([dz, dr, dn], axis=1)
        d_u += h.T @ dg
        dh = stay + dg @ u.T
    return d_in, d_u


def spell(table: np.ndarray, spelling: np.ndarray, active: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Last states over spelled words (CHARS, rows), longest first; a step has as many rows as words go on.

    ``table`` has the projected input of each character.
    """
    size = u.shape[0]
    h, kept = np.zeros((spelling.shape[1], size), np.float32), []
    for t, k in enumerate(active.tolist()):
        if not k:
            break
        x, old = table[spelling[t, :k]], h[:k]
        g = old @ u
        zr = _sigmoid(x[:, : 2 * size] + g[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(x[:, 2 * size :] + r * g[:, 2 * size :])
        new = n + z * (old - n)
        if keep:
            kept.append((old.copy(), z, r, n, g[:, 2 * size :]))
        h[:k] = new
    return h, kept


def spell_backward(dh: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the steps' inputs, one step after another, and of u."""
    dh, d_u, out = dh.copy(), np.zeros_like(u), []
    for h, z, r, n, hn in reversed(kept):
        d = dh[: len(h)]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        out.append(np.concatenate([dz, dr, dn], axis=1))
        d_u += h.T @ dg
        dh[: len(h)] = z * d + dg @ u.T
    return np.concatenate(out[::-1]), d_u


def _summed(at: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of d by their number in ``at``."""
    out = np.zeros((n, d.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        of = at[order]
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[begin]] = np.add.reduceat(d[order], begin, axis=0)
    return out


def leaning(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How far the share of toxic texts among those with a word lies from the whole's, in standard deviations.

    Words of few texts stay near zero, so what it says holds in a small sample, too.
    """
    p = n_toxic / (n_toxic + n_clean)
    n = toxic + clean
    return np.clip((toxic - p * n) / np.sqrt((n + 1) * p * (1 - p)), -4, 8)


def _initial(rng: np.random.Generator, vocabulary: int, alphabet: int) -> Weights:
    def some(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w: Weights = {"words": 0.1 * some(vocabulary + 1, WORD_DIM) * np.sqrt(vocabulary + 1, dtype=np.float32), "chars": 0.5 * some(alphabet + 2, CHAR_DIM) * np.sqrt(alphabet + 2, dtype=np.float32)}
    for side in "fb":
        w |= {f"cw{side}": some(CHAR_DIM, 3 * CHAR_STATE), f"cb{side}": np.zeros(3 * CHAR_STATE, np.float32), f"cu{side}": some(CHAR_STATE, 3 * CHAR_STATE)}
        w |= {f"ww{side}": some(WORD_DIM + 2 * CHAR_STATE, 3 * STATE), f"wb{side}": np.zeros(3 * STATE, np.float32), f"wu{side}": some(STATE, 3 * STATE)}
    w |= {"aw": some(2 * STATE, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "av": some(ATTENTION, 1)[:, 0]}
    return w | {"ow": some(2 * STATE, 1)[:, 0], "ob": np.zeros(1, np.float32)}


@dataclass
class Model:
    """Weights, the words and characters with embeddings, and the logistic function over a text's windows."""

    weights: Weights
    words: dict[str, int]
    chars: dict[str, int]
    last: np.ndarray | None = None

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character numbers (CHARS, n), 0 where a word has ended, and word numbers; 0 for words without embedding."""
        out = np.zeros((len(words), CHARS), np.int64)
        other, get = len(self.chars) + 1, self.chars.get
        for i, w in enumerate(words):
            out[i, : len(w)] = [get(c, other) for c in w]
        return out.T, np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))

    def read(self, spelling: np.ndarray, numbers: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """A word's vector: its embedding and its characters' last states in both directions."""
        w = self.weights
        length = (spelling > 0).sum(axis=0)
        order = np.argsort(-length, kind="stable")
        active = np.array([(length > t).sum() for t in range(CHARS)])
        ahead = spelling[:, order]
        back = np.take_along_axis(ahead, np.maximum(0, length[order][None, :] - 1 - np.arange(CHARS)[:, None]), axis=0)
        states, kept = [], []
        for side, read in (("f", ahead), ("b", back)):
            last, k = spell(w["chars"] @ w[f"cw{side}"] + w[f"cb{side}"], read, active, w[f"cu{side}"], keep)
            out = np.empty_like(last)
            out[order] = last
            states.append(out)
            kept.append((side, read, k))
        return np.concatenate([w["words"][numbers], *states], axis=1), (order, active, kept)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.concatenate([vectors @ w["wwf"] + w["wbf"], vectors @ w["wwb"] + w["wbb"]], axis=1)

    def windows(self, inputs: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows from projected words (SPAN, windows, 6 STATE)."""
        w, half = self.weights, 3 * STATE
        forward, kf = gru(inputs[:, :, :half], mask, w["wuf"], keep)
        backward, kb = gru(inputs[::-1, :, half:], mask[::-1], w["wub"], keep)
        h = np.concatenate([forward, backward[::-1]], axis=2)
        a = np.tanh(h @ w["aw"] + w["ab"])
        e = a @ w["av"] - np.float32(1e4) * (1 - mask[:, :, 0])
        p = np.exp(e - e.max(axis=0))
        p /= p.sum(axis=0)
        pooled = np.einsum("tb,tbd->bd", p, h)
        return pooled @ w["ow"] + w["ob"][0], (h, a, p, pooled, kf, kb)


def _gradients(m: Model, spelling: np.ndarray, numbers: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Weights:
    """Gradients of the weighted logistic loss over windows ``at`` (SPAN, windows) of word rows."""
    w, g = m.weights, {}
    vectors, (order, active, spelled) = m.read(spelling, numbers, True)
    projected = m.project(vectors)
    logits, (h, a, p, pooled, kf, kb) = m.windows(projected[at], mask, True)
    d = ((_sigmoid(logits) - y) * weight).astype(np.float32)
    g["ob"], g["ow"] = d.sum(keepdims=True), pooled.T @ d
    d_pooled = d[:, None] * w["ow"]
    dp = np.einsum("bd,tbd->tb", d_pooled, h)
    de = p * (dp - (p * dp).sum(axis=0))
    dh = p[:, :, None] * d_pooled
    g["av"] = np.einsum("tb,tbk->k", de, a)
    da = de[:, :, None] * w["av"] * (1 - a * a)
    g["aw"], g["ab"] = np.einsum("tbd,tbk->dk", h, da), da.sum(axis=(0, 1))
    dh = dh + da @ w["aw"].T
    df, g["wuf"] = gru_backward(dh[:, :, :STATE], kf, mask, w["wuf"])
    db, g["wub"] = gru_backward(dh[::-1, :, STATE:], kb, mask[::-1], w["wub"])
    d_in = np.concatenate([df, db[::-1]], axis=2)
    d_proj = _summed(at.ravel(), d_in.reshape(-1, d_in.shape[2]), len(projected))
    half = 3 * STATE
    g["wwf"], g["wbf"] = vectors.T @ d_proj[:, :half], d_proj[:, :half].sum(axis=0)
    g["wwb"], g["wbb"] = vectors.T @ d_proj[:, half:], d_proj[:, half:].sum(axis=0)
    dv = d_proj[:, :half] @ w["wwf"].T + d_proj[:, half:] @ w["wwb"].T
    g["words"] = _summed(numbers, dv[:, :WORD_DIM], len(w["words"]))
    g["words"][0] = 0
    g["chars"] = np.zeros_like(w["chars"])
    for i, (side, read, kept) in enumerate(spelled):
        low = WORD_DIM + i * CHAR_STATE
        d_in, g[f"cu{side}"] = spell_backward(dv[order, low : low + CHAR_STATE], kept, w[f"cu{side}"])
        d_table = _summed(np.concatenate([read[t, :k] for t, k in enumerate(active.tolist())]), d_in, len(w["chars"]))
        g[f"cw{side}"], g[f"cb{side}"] = w["chars"].T @ d_table, d_table.sum(axis=0)
        g["chars"] += d_table @ w[f"cw{side}"].T
    return g


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover n words."""
    if n <= SPAN:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - SPAN + STEP, STEP)
    starts[-1] = n - SPAN
    return starts


def _spread(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word rows (SPAN, windows) of windows, and their mask, from a text's word rows."""
    at = starts[None, :] + np.arange(SPAN)[:, None]
    mask = at < len(rows)
    return rows[np.minimum(at, len(rows) - 1)], mask.astype(np.float32)[:, :, None]


def train(texts: list[str], labels: np.ndarray, windows: int = 32, seed: int = 3, rounds: tuple[int, ...] = (200, 150, 150), batch: int = 48) -> Model | None:
    """A model from texts and labels 0 or 1.

    A toxic text's windows needn't all be toxic: the network learns from the highest-scored quarter of each toxic text,
    against windows of other texts, half of them the highest-scored ones. What scores the windows of the first round is
    the word in them that leans most to toxic texts; that leaning is also what word embeddings start with.
    """
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    have = [i for i, ws in enumerate(split) if ws]
    split, labels = [split[i] for i in have], np.asarray(labels)[have]
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    counts = Counter(w for ws in split for w in set(ws))
    least = max(3, len(split) // 100)
    frequent = sorted((w for w, n in counts.items() if n >= least), key=lambda w: (-counts[w], w))[:VOCABULARY]
    letters = Counter(c for w in counts for c in w)
    alphabet = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]]
    m = Model(_initial(rng, len(frequent), len(alphabet)), {w: i + 1 for i, w in enumerate(frequent)}, {c: i + 1 for i, c in enumerate(alphabet)})
    in_toxic = Counter(w for ws, y in zip(split, labels, strict=True) if y == 1 for w in set(ws))
    both = np.array([(in_toxic[w], counts[w] - in_toxic[w]) for w in frequent], float).reshape(-1, 2)
    lean = leaning(both[:, 0], both[:, 1], int((labels == 1).sum()), int((labels == 0).sum()))
    m.weights["words"][1:, 0] = 0.5 * lean
    vocabulary = sorted(counts)
    row = {w: i for i, w in enumerate(vocabulary)}
    spelling, numbers = m.spelled(vocabulary)
    ats, masks, of = [], [], []
    for i, ws in enumerate(split):
        starts = window_starts(len(ws))
        if len(starts) > windows:
            starts = np.sort(rng.choice(starts, windows, replace=False))
        at, mask = _spread(np.fromiter((row[w] for w in ws), np.int64, len(ws)), starts)
        ats.append(at)
        masks.append(mask)
        of.append(np.full(len(starts), i))
    at, mask, of = np.concatenate(ats, axis=1), np.concatenate(masks, axis=1), np.concatenate(of)
    y = (labels[of] == 1).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in m.weights.items()}
    second = {k: np.zeros_like(v) for k, v in m.weights.items()}
    # the logistic function is fitted to texts that the network hasn't seen, if there are enough
    aside = rng.permutation(len(split))[: len(split) // 4]
    if min((labels[aside] == 1).sum(), (labels[aside] == 0).sum()) < 10:
        aside = aside[:0]
    seen = ~np.isin(of, aside)
    bad, step = np.flatnonzero(seen & (y == 0)), 0
    leans = np.concatenate([[0.0], lean])[numbers]

    def scores() -> np.ndarray:
        projected = np.concatenate([m.project(m.read(spelling[:, i : i + 4096], numbers[i : i + 4096])[0]) for i in range(0, len(numbers), 4096)])
        return np.concatenate([m.windows(projected[at[:, i : i + 1024]], mask[:, i : i + 1024])[0] for i in range(0, at.shape[1], 1024)])

    for k, steps in enumerate(rounds):
        s = scores() if k else leans[at].max(axis=0)
        order = np.lexsort((-s, of))
        begin = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
        size = np.diff(np.concatenate([begin, [len(order)]]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(begin, size)
        top = rank < np.maximum(1, np.ceil(0.25 * size[of]))
        good = np.flatnonzero(seen & (y == 1) & top)
        hard = bad[np.argsort(-s[bad], kind="stable")[: max(batch, len(bad) // 8)]]
        for j in range(steps):
            some = np.concatenate([rng.choice(good, batch), rng.choice(bad, batch // 2), rng.choice(hard, batch // 2)])
            rows, local = np.unique(at[:, some], return_inverse=True)
            shown = np.where(rng.random(len(rows)) < HIDDEN, 0, numbers[rows])  # some words are known by their letters only
            g = _gradients(m, spelling[:, rows], shown, local.reshape(SPAN, -1), mask[:, some], y[some], np.full(len(some), 1 / len(some), np.float32))
            step += 1
            rate = RATE * (1 - 0.8 * j / steps) * (1 if k == 0 else 0.6)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            for name, v in g.items():
                v = v * np.float32(scale)
                first[name] += np.float32(0.1) * (v - first[name])
                second[name] += np.float32(0.01) * (v * v - second[name])
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                m.weights[name] = (m.weights[name] * (1 - DECAY * rate) - rate * move).astype(np.float32)
    x = features(scores(), of, len(split))
    fit = aside if len(aside) else np.arange(len(split))
    m.last = _logistic(x[fit], labels[fit] == 1)
    return m


def features(logits: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each text with windows: highest logit, mean probability, share of likely windows, and 1."""
    count = np.maximum(np.bincount(of, minlength=n), 1)
    top = np.full(n, -20.0)
    np.maximum.at(top, of, logits)
    p = _sigmoid(logits)
    mean, likely = np.bincount(of, p, minlength=n) / count, np.bincount(of[p > 0.5], minlength=n) / count
    return np.stack([np.clip(top, -8, 8) / 4, mean, likely, np.ones(n)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def _letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter in the sense of ``words_of``; made once per process."""
    if not len(_is_letter[0]):
        _is_letter[0] = np.array([bool(_WORD.match(chr(i))) for i in range(0x10000)])
    return _is_letter[0]


_is_letter: list[np.ndarray] = [np.empty(0, bool)]


def spellings(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (words, CHARS) of all texts' words, 0 after a word's end, and how many words each text has.

    The words are those of ``words_of``, found in one pass over all texts.
    """
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF).tolist():
        letter[i] = _WORD.match(chr(points[i])) is not None
    turns = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, size = turns[::2], turns[1::2] - turns[::2]
    parts = -(-size // CHARS)
    if len(parts) and parts.max() > 1:
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + CHARS * nth
        size = np.minimum(np.repeat(size, parts) - CHARS * nth, CHARS)
    out = np.zeros((len(start), CHARS), np.uint32)
    for j in range(CHARS):
        some = np.flatnonzero(size > j)
        out[some, j] = points[start[some] + j]
    ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)
    return out, np.diff(np.searchsorted(start, ends, side="left"), prepend=0)


def _hashed(points: np.ndarray) -> np.ndarray:
    h = np.zeros(len(points), np.uint64)
    for j in range(points.shape[1]):
        h = (h + points[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def advance(tables: list[np.ndarray], u: list[np.ndarray], at: np.ndarray, h: np.ndarray, out: np.ndarray, buffers: list[np.ndarray]) -> None:
    """The states after one more input, written to ``out``, which may be ``h``.

    ``tables`` have each input's share of update gate, reset gate and candidate; all arrays are whole, so no step works on
    slices. The gates' shares are halved beforehand, as sigmoid(x) is (tanh(x / 2) + 1) / 2, and so is u's of the
    candidate, as the reset gate is used as 1 + tanh.
    """
    z, r, n, g = (b[: len(h)] for b in buffers)
    np.take(tables[0], at, axis=0, out=z, mode="clip")
    z += np.matmul(h, u[0], out=g)
    np.tanh(z, out=z)
    np.take(tables[1], at, axis=0, out=r, mode="clip")
    r += np.matmul(h, u[1], out=g)
    np.tanh(r, out=r)
    r += np.float32(1)
    np.matmul(h, u[2], out=g)
    g *= r
    np.take(tables[2], at, axis=0, out=n, mode="clip")
    n += g
    np.tanh(n, out=n)
    z *= np.float32(0.5)
    z += np.float32(0.5)
    np.subtract(h, n, out=g)
    g *= z
    np.add(n, g, out=out)


def _gates(x: np.ndarray, last: float = 1.0) -> list[np.ndarray]:
    """The three gates' columns of ``x`` on their own, scaled for ``advance``."""
    return [np.ascontiguousarray(part) * np.float32(f) for part, f in zip(np.split(x, 3, axis=1), (0.5, 0.5, last), strict=True)]


class Scorer:
    """Scores texts; inputs of words that it has met are kept up to a bound. Windows of one length are read together."""

    ROWS = 2048

    def __init__(self, model: Model):
        self.m = model
        w = model.weights
        self.known: dict[int, int] = {}
        self.tables = {side: [np.empty((0, STATE), np.float32)] * 3 for side in "fb"}
        self.u = {side: _gates(w[f"wu{side}"], 0.5) for side in "fb"}
        self.chars = {side: (_gates(w["chars"] @ w[f"cw{side}"] + w[f"cb{side}"]), _gates(w[f"cu{side}"], 0.5)) for side in "fb"}
        self.number = np.full(0x10000, len(model.chars) + 1, np.int64)
        self.number[0] = 0
        for c, i in model.chars.items():
            if ord(c) < 0x10000:
                self.number[ord(c)] = i
        self.words = {int(h): i for h, i in zip(_hashed(self._points(list(model.words))), model.words.values(), strict=True)}
        self.attend = np.ascontiguousarray(w["aw"][:STATE]), np.ascontiguousarray(w["aw"][STATE:]), w["ab"], w["av"], w["ow"]
        self.ahead = np.empty((SPAN, self.ROWS, STATE), np.float32)
        self.buffers = [np.empty((self.ROWS, STATE), np.float32) for _ in range(4)]
        self.spelling = [np.empty((4096, CHAR_STATE), np.float32) for _ in range(4)]

    @staticmethod
    def _points(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), CHARS), np.uint32)
        for i, w in enumerate(words):
            out[i, : len(w)] = list(map(ord, w))
        return out

    def _read(self, points: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Vectors of distinct words, as ``Model.read`` gives them."""
        size = (points > 0).sum(axis=1)
        order = np.argsort(-size, kind="stable")
        numbers = self.number[np.minimum(points[order], 0xFFFF)]
        for i, j in np.argwhere(points[order] > 0xFFFF).tolist():
            numbers[i, j] = self.m.chars.get(chr(points[order[i], j]), len(self.m.chars) + 1)
        size = size[order]
        back = np.take_along_axis(numbers, np.maximum(0, size[:, None] - 1 - np.arange(CHARS)), axis=1)
        active = np.searchsorted(-size, -np.arange(CHARS), side="left")
        out = [self.m.weights["words"][np.fromiter((self.words.get(h, 0) for h in hashes.tolist()), np.int64, len(hashes))]]
        for side, read in (("f", np.ascontiguousarray(numbers.T)), ("b", np.ascontiguousarray(back.T))):
            tables, u = self.chars[side]
            h = np.zeros((len(points), CHAR_STATE), np.float32)
            for t, k in enumerate(active.tolist()):
                if k:
                    advance(tables, u, read[t, :k], h[:k], h[:k], self.spelling)
            last = np.empty_like(h)
            last[order] = h
            out.append(last)
        return np.concatenate(out, axis=1)

    def _learn(self, points: np.ndarray, hashes: np.ndarray) -> None:
        w, parts = self.m.weights, {side: [[t] for t in self.tables[side]] for side in "fb"}
        for i in range(0, len(points), 4096):
            vectors = self._read(points[i : i + 4096], hashes[i : i + 4096])
            for side in "fb":
                for found, gate in zip(parts[side], _gates(vectors @ w[f"ww{side}"] + w[f"wb{side}"]), strict=True):
                    found.append(gate)
        self.known.update(zip(hashes.tolist(), range(len(self.known), len(self.known) + len(hashes)), strict=True))
        self.tables = {side: [np.concatenate(p) for p in parts[side]] for side in "fb"}

    def logits(self, at: np.ndarray) -> np.ndarray:
        """Logits of up to ROWS windows of one length; ``at`` (length, windows) has the numbers of their words."""
        (length, n), (af, ab, bias, av, ow) = at.shape, self.attend
        h = np.zeros((n, STATE), np.float32)
        for t in range(length):
            advance(self.tables["f"], self.u["f"], at[t], h, self.ahead[t, :n], self.buffers)
            h = self.ahead[t, :n]
        h, e, s = np.zeros((n, STATE), np.float32), np.empty((length, n), np.float32), np.empty((length, n), np.float32)
        for t in range(length - 1, -1, -1):
            advance(self.tables["b"], self.u["b"], at[t], h, h, self.buffers)
            a = self.ahead[t, :n] @ af
            a += h @ ab
            a += bias
            np.tanh(a, out=a)
            np.dot(a, av, out=e[t])
            s[t] = self.ahead[t, :n] @ ow[:STATE] + h @ ow[STATE:]
        e -= e.max(axis=0)
        np.exp(e, out=e)
        return (e * s).sum(axis=0) / e.sum(axis=0) + self.m.weights["ob"][0]

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all texts' words, and how many words each text has."""
        points, n = spellings(texts)
        hashes, first, at = np.unique(_hashed(points), return_index=True, return_inverse=True)
        get = self.known.get
        row = np.fromiter((get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(row < 0)
        if len(new):
            if len(self.known) + len(new) > WORDS_KEPT:
                self.known, new = {}, np.arange(len(hashes))
                self.tables = {side: [t[:0] for t in self.tables[side]] for side in "fb"}
            row[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(points[first[new]], hashes[new])
        return row[at], n

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows, n = self.numbered(texts)
        begin = np.cumsum(n) - n
        starts = [window_starts(k) for k in n.tolist()]
        of = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        if not len(of):
            return np.zeros(len(texts))
        start = np.concatenate(starts) + begin[of]
        length = np.minimum(n[of], SPAN)
        logits = np.empty(len(of), np.float32)
        for k in np.unique(length).tolist():
            some = np.flatnonzero(length == k)
            for i in range(0, len(some), self.ROWS):
                cut = some[i : i + self.ROWS]
                logits[cut] = self.logits(rows[start[cut] + np.arange(k)[:, None]])
        x = features(logits, of, len(texts)) @ self.m.last
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(x, -30, 30))), 0.0)


def sampled(docs: DataFrame, labels: DataFrame, most: int, windows: int) -> DataFrame:
    """(doc_id, toxic, text): up to ``most`` documents of each label, long texts cut to as many words as the windows hold.

    Labels are ordered without texts, each task keeping its first ones; only the sample's labels meet their texts. One
    text stands for a doc_id, however often it comes, so the sample has at most 2 * ``most`` rows.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [rows.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    width = SPAN + STEP * (windows - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=2):
            texts = []
            for t in batch.column(2).to_pylist():
                ws = words_of(t)
                if len(ws) > width:  # from places spread over the text
                    at = np.linspace(0, len(ws) - SPAN, width // SPAN).astype(int)
                    ws = [w for i in at for w in ws[i : i + SPAN]]
                texts.append(" ".join(ws))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "toxic", "text"])

    return found.mapInArrow(cut, found.schema)


def learn(docs: DataFrame, labels: DataFrame, most: int = 1500, windows: int = 32) -> Model | None:
    """A model from up to ``most`` documents of each label, trained in one task of a bounded size."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r["doc_id"], r["toxic"], r["text"]) for batch in batches for r in batch.to_pylist())
        model = train([r[2] for r in sample], np.array([r[1] for r in sample]), windows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    model = sampled(docs, labels, most, windows).repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(bytes(model["model"])) if model else None


def scored(docs: DataFrame, model: Model | None, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of the documents, then their score under ``name``."""
    last = len(columns)
    kept = docs.select(*columns, F.col("text").alias(fresh("text", columns)))
    schema = T.StructType([*kept.schema.fields[:last], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in pieces(batches, text=last, most=2 << 20):
            texts = batch.column(last).to_pylist()
            score = scorer.score(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(score, pa.float64())], names=[*columns, name])

    return kept.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, learned: Column, threshold: float = 0.7, most: int = 1500) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; ``learned``, of doc_id, tells which labels may be used."""
    model = learn(docs, labels.filter(learned), most)
    rows = docs.select("doc_id", "text", F.coalesce(~learned, F.lit(False)).alias("held_out"))
    out = scored(rows, model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
