"""Toxicity, tokens, search, mixing and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import langid, mixing, sentencepiece, topk, toxicity

SF = "/root/testdata/sf0.001"


def test_gradients():
    rng = np.random.default_rng(0)
    words = ["abc", "d", "efghij", "bad", "worse", "kk"]
    m = toxicity.Model(toxicity._initial(rng, 4, 12), {w: i + 1 for i, w in enumerate(words[:4])}, {c: i + 1 for i, c in enumerate("abcdefghijkl")})
    spelling, numbers = m.spelled(words)
    at, mask = rng.integers(0, 6, (toxicity.SPAN, 5)), np.ones((toxicity.SPAN, 5, 1), np.float32)
    mask[20:, 2] = 0
    y, weight = np.array([1, 0, 1, 0, 1], np.float32), np.full(5, 0.2, np.float32)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}

    def loss():
        z = m.windows(m.project(m.read(spelling, numbers)[0])[at], mask)[0].astype(float)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    g = toxicity._gradients(m, spelling, numbers, at, mask, y, weight)
    for name, v in m.weights.items():
        for _ in range(3):
            i = tuple(int(rng.integers(1 if name in ("words", "chars") and k == 0 else 0, min(n, 4) if name in ("words", "chars") and k == 0 else n)) for k, n in enumerate(v.shape))
            old = v[i]
            v[i] = old + 0.01
            up = loss()
            v[i] = old - 0.01
            down = loss()
            v[i] = old
            assert abs((up - down) / 0.02 - float(g[name][i])) < 2e-4


def plain_score(m, text):
    """A text's score, word by word and character by character."""
    w, sigmoid = m.weights, lambda x: 1 / (1 + np.exp(-x))

    def cell(x, h, u):
        k = len(h)
        g = h @ u
        z, r = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
        n = np.tanh(x[2 * k :] + r * g[2 * k :])
        return (1 - z) * n + z * h

    def run(inputs, u):
        h, out = np.zeros(len(u)), []
        for x in inputs:
            h = cell(x, h, u)
            out.append(h)
        return out

    def vector(word):
        at = [m.chars.get(c, len(m.chars) + 1) for c in word]
        ends = [run([w["chars"][i] @ w[f"cw{d}"] + w[f"cb{d}"] for i in (at if d == "f" else at[::-1])], w[f"cu{d}"])[-1] for d in "fb"]
        return np.concatenate([w["words"][m.words.get(word, 0)], *ends])

    vectors = [vector(x) for x in toxicity.words_of(text)]
    if not vectors:
        return 0.0
    logits = []
    for s in toxicity.window_starts(len(vectors)).tolist():
        some = vectors[s : s + toxicity.SPAN]
        ahead = run([v @ w["wwf"] + w["wbf"] for v in some], w["wuf"])
        back = run([v @ w["wwb"] + w["wbb"] for v in some[::-1]], w["wub"])[::-1]
        h = np.array([np.concatenate(x) for x in zip(ahead, back, strict=True)])
        p = np.exp(np.tanh(h @ w["aw"] + w["ab"]) @ w["av"])
        logits.append((p / p.sum()) @ h @ w["ow"] + w["ob"][0])
    p = sigmoid(np.array(logits))
    x = np.array([np.clip(max(logits), -8, 8) / 4, p.mean(), (p > 0.5).mean(), 1])
    return sigmoid(x @ m.last)


def test_scores_are_those_of_a_plain_forward_pass(docs):
    rng = np.random.default_rng(6)
    texts = [r.text for r in docs.select("text").collect()][:30] + [None, "", "1 2 _", "One", "x" * 40 + " \U00010400\U00010428 Éa²b", "İstanbul a_b c1d"]
    words = sorted({w for t in texts for w in toxicity.words_of(t)})
    m = toxicity.Model(toxicity._initial(rng, 100, 20), {w: i + 1 for i, w in enumerate(words[:100])}, {c: i + 1 for i, c in enumerate("antireoshdw\U00010428é²")})
    m.weights |= {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in m.weights.items() if k[1:2] == "b"}
    m.last = np.array([1.0, 2.0, 0.5, -1.0])
    scorer = toxicity.Scorer(m)
    assert np.allclose(scorer.score(texts), [plain_score(m, t) for t in texts], atol=1e-4)
    assert np.allclose(scorer.score(texts[::-1]), scorer.score(texts)[::-1], atol=1e-6)


def test_spellings_are_those_of_the_words():
    texts = ["One two-three", None, "", "1a_b2 ² é", "x" * 50, "\U00010400b ok", "a\0b"]
    points, n = toxicity.spellings(texts)
    want = [toxicity.words_of(t) for t in texts]
    assert n.tolist() == [len(ws) for ws in want]
    assert ["".join(map(chr, p[p > 0])) for p in points] == [w for ws in want for w in ws]


def test_toxicity_sample_is_one_text_of_each_id(spark):
    """Repeated rows, a repeated doc_id with several texts, equal labels: the sample doesn't grow with them."""
    rows = [(i % 7, f"some words {'idiot' if i % 7 == 3 else 'fine'} {i % 2}") for i in range(700)] + [(None, "lost")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(7)] * 2 + [(None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, F.lit(True), most=2)
    assert got.count() == 701
    sample = toxicity.sampled(docs, labels, 2, 32).collect()
    assert sorted(r.toxic for r in sample) == [0, 0, 1] and len({r.doc_id for r in sample}) == 3


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels, langid.crc32_mod(F.col("doc_id"), 3) != 1).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null")
    r = got.selectExpr("avg(if(toxic = 1, predicted, null)) as recall", "avg(if(predicted = 1, toxic, null)) as precision").first()
    assert r.recall >= 0.6 and r.precision >= 0.7


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 100, 1000):
        starts = toxicity.window_starts(n).tolist()
        covered = {k for s in starts for k in range(s, min(n, s + toxicity.SPAN))}
        assert covered == set(range(n))
        assert all(b - a <= toxicity.STEP for a, b in zip(starts, starts[1:], strict=False))


def test_toxicity_learns_marked_words(spark):
    rng = np.random.default_rng(1)
    syllables = ["an", "ti", "re", "on", "sh", "ed", "wh", "er"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(240):
        words = [word() for _ in range(rng.integers(20, 90))]
        if i % 4 == 0:
            for _ in range(4):
                words[rng.integers(0, len(words))] = str(rng.choice(["scum", "idiot", "moron"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(900, None, 0), (901, "", 0), (902, "123 !!", 0), (903, "x" * 20_000, 0), (None, "some words", 0)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, langid.crc32_mod(F.col("doc_id"), 3) != 1, most=200).collect()}
    assert len(got) == len(rows)
    held = [(got[i].score, y) for i, _, y in rows[:240] if got[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(got[i].score == 0 for i in (900, 901, 902)) and 0 <= got[903].score <= 1


def test_toxicity_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, labels, F.lit(True)).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels, F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def model():
    return sentencepiece.public_model()


def test_pieces_are_the_librarys(model):
    import sentencepiece as library

    rng = np.random.default_rng(2)
    parts = ["a", "b", "th", "e", "in", "▁", " ", "  ", "   ", "é", "漢", "字", "\U0001f600", "\n", "\t", "(", "1", "00", "\\", "aa", "aaaa", "hello", " world", "..", "----"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 50))) for _ in range(1500)] + ["x" * 3000, "", " ", "\n"]
    ids, ends = sentencepiece.Encoder(sentencepiece.Vocabulary(model)).encode(texts)
    ends = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == library.SentencePieceProcessor(model_file=model).encode(texts)


def test_unigram_paths_are_the_best(model, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(model, "rb").read())
    proto.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    v = sentencepiece.Vocabulary(str(tmp_path / "unigram.model"))
    e = sentencepiece.Encoder(v)

    def best(word):
        score = [0.0] + [-1e18] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                p = word[start:end]
                if p in v.scores:
                    score[end] = max(score[end], score[start] + v.scores[p])
        return score[-1]

    names = {i: p for p, i in v.ids.items()}
    for text in ["hello world", "unbelievable", "the then there theme", "resting restless"]:
        ids, _ = e.encode([text])
        assert sum(v.scores[names[i]] for i in ids.tolist()) == sum(best(w) for w in ("▁" + text.replace(" ", "▁")).replace("▁", " ▁").split())


def test_round_trip(docs, empty, model):
    out = sentencepiece.encoded(docs, model)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count()
    assert all(r.round_trip for i, r in rows.items() if i != 60) and not rows[60].round_trip  # 60 holds the mark itself
    assert rows[50].ids == [] and rows[51].ids == []
    back = {r.doc_id: r.text for r in sentencepiece.decoded(out.filter("doc_id < 50"), model).collect()}
    assert all(back[i] == t for i, t in docs.select("doc_id", "text").collect() if i is not None and i < 50)
    assert sentencepiece.encoded(empty, model).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)) / 3
    x[100:150] = x[20]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (320, [1.0]), (340, [float("nan")] * 8), (341, [None] * 8), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, dims=8).collect()]
    v = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(int)
    want = []
    for q in range(0, 300, 20):
        s = v @ v[q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, k=20, dims=8).count() == 0
    assert topk.top_k(df.filter("vec_id in (0, 3, 4)"), F.col("vec_id") % 20 == 0, k=20, dims=8).count() == 2


def test_top_k_of_large_components_and_mixed_lengths(spark, monkeypatch):
    """Components up to the bounds, scores beyond 64 bits, and vectors of several lengths, against plain integers."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 25)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 1)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(240):
        x = rng.standard_normal([8, 32, 5][i % 3]) * [1, 1e3, 1e9, 1e300][i % 4 if i % 7 == 0 else 0]
        rows.append((i, [float(v) for v in x]))
    rows += [(240, [1e9] * 8), (260, [-1e300] * 8), (280, [1e300] * 8), (281, [1e300] * 8), (300, [1.0]), (320, [])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, block string, n int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect())
    whole = {i: [max(-(1 << 57), min(1 << 57, int(np.floor(np.float64(x) * 64)))) for x in v] for i, v in rows if v}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        scores = [(max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        want += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:20], 1)]
    assert got == sorted(want)
    assert topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, dims=32).select("vec_id").distinct().count() > 20


def test_search_stops_before_the_lists_end():
    """Vectors with most energy in few dimensions: the bound ends the search; with a floor, sooner still. All is exact."""
    rng = np.random.default_rng(7)
    x = np.floor(rng.standard_normal((3000, 16)) * 64 / (1 + np.arange(16)) ** 1.5)
    q, ids = x[:40], np.arange(3000)
    none = np.full(40, -np.inf)
    best, best_ids, scored = topk.search(q, ids[:40], none, x, ids, 20)
    s = q @ x.T
    s[np.arange(40), np.arange(40)] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :20]
    assert (best_ids == order).all() and (best == np.take_along_axis(s, order, 1)).all()
    assert scored < 0.5 * 40 * 3000
    again = topk.search(q, ids[:40], best[:, -1], x, ids, 20)
    assert (again[1] == order).all() and again[2] <= scored
    assert topk.search(q, ids[:40], np.full(40, 1e9), x, ids, 20)[2] == 0


def test_far_blocks_are_not_sent(spark, monkeypatch, tmp_path):
    """Clusters along different axes: groups get few of the blocks, and the result is that of all pairs."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 30)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 1)
    written = {}
    real = topk.stored

    def kept(df, tag):
        written[tag] = real(df, tag)
        return written[tag]

    monkeypatch.setattr(topk, "stored", kept)
    rng = np.random.default_rng(8)
    x = np.concatenate([3 * np.eye(8)[i % 4] * (1 if i < 4 else -1) + rng.standard_normal((120, 8)) / 10 for i in range(8)])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, dims=8).collect())
    v = np.floor(64 * x)
    want = []
    for i in range(0, len(x), 20):
        s = v @ v[i]
        s[i] = -np.inf
        want += [(i, r + 1, int(j), int(s[j])) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s))[:20])]
    assert got == sorted(want)
    blocks = written["topk-boxes"].count()
    assert blocks > 5 and written["topk-cells"].count() < blocks * blocks / 2


def test_mixing(docs, empty):
    rows = [r.asDict() for r in mixing.mix_table(docs, [5, 2, 1]).collect()]
    assert len(rows) == docs.count()
    per = {}
    for r in rows:
        s = per.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(s[1] for s in per.values())
    assert all(s[1] == s[3] and abs(s[0] - s[2]) <= 1 for s in per.values())
    assert abs(sum(s[2] for s in per.values()) - total) < 1e-6
    weights = {"a": 5, "b": 2, None: 1}
    open_ = [k for k, s in per.items() if s[2] < 3 * s[3] - 1e-6]
    assert len({round(per[k][2] / weights[k], 6) for k in open_}) <= 1
    again = [r.asDict() for r in mixing.mix_table(docs.repartition(5), [5, 2, 1]).collect()]
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    out = mixing.mixed(docs, [5, 2, 1])
    assert out.columns == docs.columns
    words = out.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == sum(r["taken"] for r in rows)
    assert mixing.mix_table(empty, [5, 2, 1]).count() == 0 and mixing.mixed(empty, [5, 2, 1]).count() == 0


def test_inclusion_follows_the_weights(spark):
    """One set of sizes in 30 sources of equal weight: the mean share taken is what each document's weight asks for."""
    sizes = [1, 2, 3, 5, 8, 15, 16, 40, 70, 120, 200, 300, 500, 9, 33, 64, 130, 20, 6, 90]
    rows = [(100_000 * k + 1000 * j + i, " ".join(["w"] * n), f"s{k:03}") for k in range(30) for j in range(25) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in mixing.mix_table(docs, [1]).collect():
        got.setdefault(r["doc_id"] % 1000, []).append(r["taken"] / r["size"])
    digits = [n.bit_length() for n in sizes]
    c = sum(sizes) / sum(n * d for n, d in zip(sizes, digits, strict=True))  # no document is at its limit
    for i, d in enumerate(digits):
        assert abs(np.mean(got[i]) - c * d) < 0.08, (sizes[i], np.mean(got[i]), c * d)
        assert max(got[i]) <= np.floor(c * d) + 1 and min(got[i]) >= np.floor(c * d)
    assert np.mean(got[0]) < 0.5 < 0.9 < np.mean(got[12])


def test_mixing_of_awkward_rows(spark):
    """Rows without doc_id draw numbers of their own; empty texts, a single source, repeated rows."""
    rows = [(None, f"word {i} more", "a") for i in range(50)] + [(None, None, "a"), (1, "", None), (2, "same text", "b"), (2, "same text", "b"), (2, "same text", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    chances = {r.chance for r in mixing.sizes(docs.filter("source = 'a'"), 1).collect()}
    assert len(chances) == 51
    got = mixing.mix_table(docs, [5, 2, 1]).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got if r.source == "b") == round(next(r.target for r in got if r.source == "b"))


def test_pipeline(spark, docs):
    sizes = []
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == docs.columns
        rows = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(rows.count())
    assert sizes[1] < sizes[0] and min(sizes) > 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == sizes[-1]
    assert corpus_pipeline.run(spark, SF).filter("not round_trip").count() == 0
