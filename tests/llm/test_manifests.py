"""The Merkle manifest against a plain tree, centroid clustering against plain k-means, BPE against the library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import bpe, clusters, manifest, queries
from tallyweave.llm.sentencepiece import public_model

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def audit(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars), sorted."""
    groups = {}
    for d, t, lang, s, n in rows:
        groups.setdefault((lang is not None, lang or ""), []).append((-(1 << 63) if d is None else d, leaf(d, s, lang, n, t), d, (d, s, lang, n, t)))
    trees = [levels([x[1] for x in sorted(g, key=lambda x: x[:2])]) for _, g in sorted(groups.items())]
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, (_, members) in enumerate(sorted(groups.items())):
        for i, (_, h, d, row) in enumerate(sorted(members, key=lambda x: x[:2])):
            bad = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
            now = leaf(row[0], row[1], row[2], row[3] + 1 if bad and row[3] is not None else row[3], row[4])
            proof = []
            for tree, at in ((trees[g], i), (top, g)):
                for level in tree[:-1]:
                    sibling = level[at ^ 1] if at ^ 1 < len(level) else None
                    proof += [sibling] if sibling else []
                    now = H(now) if sibling is None else H(sibling, now) if at % 2 else H(now, sibling)
                    at //= 2
            out.append((d, h, trees[g][-1][0], top[-1][0], H(*proof), now, now == top[-1][0]))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, grp string"


def audited(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return [tuple(r) for r in manifest.audited(docs, tampered, {"n_chars": F.col("n_chars") + 1}).collect()]


def sortable(rows):
    return sorted(rows, key=str)


def test_manifest_equals_plain_tree(spark):
    rng = random.Random(3)
    ids = [*(rng.randrange(-(1 << 62), 1 << 62) for _ in range(120)), *range(-70, 200), (1 << 63) - 1, -(1 << 63)]
    rows = [(d, rng.choice(["", "a b", "é" * 50, None, "x" * 9000]), rng.choice(["en", "fr", None, "é"]), rng.choice(["s", None]), rng.choice([None, 1, 9, (1 << 63) - 2])) for d in ids]
    rows += [(5, "tie", "en", "s", i % 3) for i in range(30)] + [(None, "n", "en", None, i) for i in range(9)] + [(7, "same", "fr", "s", 1)] * 40 + [(1, "only", "zz", "s", 1)]
    assert sortable(audited(spark, rows)) == sortable(audit(rows))


def test_manifest_of_several_rounds(spark):
    rows = [(i * 3, f"t{i}", "en", "s", i) for i in range(2500)] + [(i, "t", "de", "s", 1) for i in range(1025)]
    assert sortable(audited(spark, rows)) == sortable(audit(rows))


def test_manifest_of_few_rows(spark, empty):
    assert manifest.audited(empty, F.lit(False), {}).count() == 0
    for rows in ([(1, "a", None, "s", 1)], [(1, "a", None, "s", 1), (2, None, "", "s", None)]):
        assert sortable(audited(spark, rows)) == sortable(audit(rows))


def test_rows_alike_have_places_of_their_own(spark):
    rows = spark.range(0, 3000, 1, 5).select(F.lit("g").alias("grp"), F.lit(7).cast("bigint").alias("key"), F.lit(1).cast("bigint").alias("mark"), F.monotonically_increasing_id().alias("row"))
    got = manifest.ranked(rows, ["key", "mark", "row"]).select("rank", "total").collect()
    assert sorted(r.rank for r in got) == list(range(3000)) and {r.total for r in got} == {3000}


def k_means(vectors, k, rounds, scale, seed):
    """(vec_id, cluster, distance) and centroids, in plain integers."""
    rows = [(i, [max(-(1 << 27), min(1 << 27, int(np.floor(np.float64(x) * scale)))) for x in v]) for i, v in vectors]
    order = sorted(rows, key=lambda r: (H(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        c = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(rows, at, strict=True) if a == j]) else x for j, x in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], c


VECTORS = "vec_id long, embedding array<double>, cluster string, v string"


def framed(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in vectors], VECTORS).repartition(3)


def test_clusters_equal_plain_k_means(spark):
    rng = random.Random(4)
    good = [(i, [rng.choice([-1, 0, 1]) * rng.random() * (9 if d < 2 else 1) for d in range(6)]) for i in range(150)]
    good += [(i, [0.5] * 6) for i in range(150, 156)] + [good[0], (None, [0.25] * 6), (None, [1.0] * 6), (200, [1e300, -1e300, 0.0, 1e9, -1e9, 1.0]), (201, [-0.0] * 6)]
    bad = [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (305, [float("nan")] * 6), (306, [float("inf")] * 6)]
    got, centroids = clusters.clustered(framed(spark, good + bad), 9, 3, 6, 256, 2, leading=2)
    want, c = k_means(good, 9, 3, 256, 2)
    assert sortable(map(tuple, got.collect())) == sortable(want) and centroids.tolist() == c


def test_cluster_table(spark):
    vectors = [(i, [i / 7, -i / 3]) for i in range(30)]
    rows = clusters.cluster_table(framed(spark, vectors), 4, 2, 2, 256, 2).collect()
    want, c = k_means(vectors, 4, 2, 256, 2)
    inertia = {j: sum(d for _, k, d in want if k == j) for j in range(4)}
    assert sortable(map(tuple, rows)) == sortable((i, k, d, inertia[k], sum(inertia.values()), H(",".join(map(str, c[k])))) for i, k, d in want)
    assert clusters.cluster_table(framed(spark, vectors[:2]), 4, 2, 2, 256, 2).count() == 2
    assert clusters.cluster_table(framed(spark, []), 4, 2, 2, 256, 2).count() == 0
    huge = clusters.cluster_table(framed(spark, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [-1e300] * 64), (4, [1e300] * 64)]), 1, 0, 64, 256, 2).collect()
    assert sorted(r.distance for r in huge) == [0, 0, 1 << 62, 1 << 62] and {r.inertia for r in huge} == {(1 << 63) - 1}


def test_bounds_rule_out_most_centroids():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(4000, 64)) * np.r_[np.full(4, 2000.0), np.full(60, 5.0)]).astype(np.int64)
    c = x[:40]
    mean, axes = x.mean(axis=0), np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    lead, rest = clusters.coordinates(x.astype(float), mean, axes, 16)
    c_lead, c_rest = clusters.coordinates(c.astype(float), mean, axes, 16)
    at, far, measured = clusters.nearest(x, lead, rest, c, c_lead, c_rest)
    full = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all() and measured < 1.2 * len(x)


def awkward(n: int, seed: int) -> list:
    rng = random.Random(seed)
    parts = ["the", "don't", "it's", "WE'LL", "café", "Straße", "ΣΑΣ", "İx", "é", "́", " ", " ", "\x1c", "\x00", "\U0001f600", "你好", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "12345", "!!!'s", "''", "a" * 300, "näive", "Å", "กำ", "x\x85y", "'", "-"]
    made = lambda: "".join(rng.choice(["th", "er", "tion", "en", "q", "Z", "é", "'"]) for _ in range(rng.randint(1, 9)))
    return ["".join(rng.choice([rng.choice(parts), made(), made()]) + rng.choice([" ", " ", "\n", "\t", "", ","]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [0, 50, bpe.LEXICON])
def test_bpe_equals_the_library(spark, most):
    from tokenizers import Tokenizer

    path = public_model("word_bpe_49k.json")
    texts = [*awkward(250, 6), None, "", "   ", "ab" * 20000, "the " * 5000, "é" * 3000]
    docs = spark.createDataFrame([(i % 200, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string, word string").repartition(3)
    library = Tokenizer.from_file(path)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    want = [(i % 200, np.array(x, "<u4").tobytes(), library.decode(x, skip_special_tokens=False)) for i, x in enumerate(ids)]
    got = [(r.doc_id, bytes(r.ids), r.text) for r in bpe.decoded(bpe.encoded(docs, path, most), path).collect()]
    assert sortable(got) == sortable(want)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(spark.createDataFrame(want, "doc_id long, ids binary, text string")).collect()}
    assert digests == {(d, len(b) // 4, hashlib.sha256(b).hexdigest(), H(t)) for d, b, t in want}


def test_bpe_of_no_rows_and_of_unknown_ids(spark, empty):
    path = public_model("word_bpe_49k.json")
    assert bpe.encoded(empty, path).count() == 0
    ids = np.array([518, 4_000_000_000, 49407, 49408], "<u4").tobytes()
    rows = spark.createDataFrame([(1, ids), (None, None)], "doc_id long, ids binary")
    assert {r.text for r in bpe.decoded(rows, path).collect()} == {"the</w> <|endoftext|>", ""}


def test_automaton_numbers_words_and_shares_suffixes():
    rng = random.Random(7)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 8))) for _ in range(900)})
    lexicon = bpe.automaton(words)
    assert bpe.numbers(lexicon, words).tolist() == list(range(len(words)))
    others = [w for w in {bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(900)} if w not in set(words)] + [b"", b"a" * 60]
    assert set(bpe.numbers(lexicon, others).tolist()) == {-1}
    follow = {}
    for w in words:
        for i in range(len(w) + 1):
            follow.setdefault(w[:i], set()).add(w[i:])
    assert len(lexicon["final"]) == len({frozenset(s) for s in follow.values()})  # as few states as there are sets of endings
    assert bpe.numbers(bpe.automaton([]), [b"a"]).tolist() == [-1]


def test_packed_arrays_come_back(tmp_path):
    arrays = {"a": np.arange(5, dtype=np.uint32), "b": np.zeros(0, np.uint8), "c": np.arange(100, dtype=np.int32)}
    path = tmp_path / "x"
    path.write_bytes(bpe.packed(arrays))
    back = bpe.mapped(str(path))
    assert all((back[k] == a).all() and back[k].dtype == a.dtype for k, a in arrays.items())


def test_registered():
    assert {"op11_clusters", "op12_manifest", "op13_bpe"} <= set(queries.QUERIES)
