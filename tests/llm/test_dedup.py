"""SimHash, winnowing and substring dedup against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import simhash, substrings, winnow

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, n=3):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = WORDS.findall(lower)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(x, most):
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(x)):
        for j in range(i):
            if int(x[i] ^ x[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(x))]


def test_near_duplicates(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id is not None}
    assert all(prints[i] == f"{plain_fingerprint(t):016x}" for i, t in rows if i is not None)
    x = [int(r.fingerprint, 16) for r in got]
    groups = {}
    for root, r in zip(plain_components(x, 3), got, strict=True):
        groups.setdefault(root, []).append(r)
    for group in groups.values():
        known = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.component_id for r in group} == {min(known, default=None)}
    assert simhash.near_duplicates(empty).count() == 0


def crowded(seed, bases=30, each=30, bits=5):
    """Distinct values in crowds of near ones."""
    rng = np.random.default_rng(seed)
    x = set()
    for base in rng.integers(0, 1 << 63, bases):
        for _ in range(each):
            v = int(base)
            for bit in rng.integers(0, 63, rng.integers(0, bits)):
                v ^= 1 << int(bit)
            x.add(v)
    return sorted(x)


@pytest.mark.parametrize("block_rows", [16, 100, 16384])
def test_links_are_those_of_all_pairs(spark, block_rows):
    x = crowded(2) + [-1, -2, 0, 1 << 62, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in x], "fp long")
    edges = simhash.components(simhash.links(df, 3, block_rows)).collect()
    root = {r.a: r.b for r in edges}
    ours = {}
    for v in x:
        ours.setdefault(root.get(v, v), set()).add(v)
    theirs = {}
    for r, v in zip(plain_components([v % (1 << 64) for v in x], 3), x, strict=True):
        theirs.setdefault(r, set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_blocks_are_even_and_far_pairs_of_blocks_are_pruned(spark):
    """Values that share three quarters, as a hot group would, and spread ones: blocks keep their size, few pairs stay."""
    rng = np.random.default_rng(11)
    hot = [(0x1234_5678_9ABC << 16) + int(v) for v in rng.choice(1 << 16, 1500, replace=False)]
    spread = [int(v) for v in rng.integers(-(1 << 63), (1 << 63) - 1, 1500)]
    rows = simhash.blocks(spark.createDataFrame([(v,) for v in hot + spread], "fp long"), 64)
    sizes = [r["count"] for r in rows.groupBy("block").count().collect()]
    assert sum(sizes) == 4 * 3000 and max(sizes) <= 64
    pairs = simhash.block_pairs(rows)
    of_spread = rows.filter("y <> 0").groupBy("block").agg({"q": "max"}).count()
    assert pairs.filter("a = b").count() == len(sizes) == of_spread
    # blocks with spread values only meet themselves and their neighbours
    shared = {r.block for r in rows.filter("q = 3").select("block").distinct().collect()}
    assert pairs.count() < len(sizes) ** 2 / 8 and shared


def test_near_duplicates_of_crowds_in_small_blocks(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(25)]
    rows = []
    for i in range(300):
        t = base[i % 25].split()
        for at in rng.integers(0, 120, rng.integers(0, 3)):
            t[at] = str(rng.choice(words))
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=32).collect()}
    root = plain_components([plain_fingerprint(t) for _, t in rows], 3)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    assert [got[i].component_id for i in range(300)] == [least[r] for r in root]


def test_descent_finds_all_pairs_and_prunes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 1 << 63, 4000, dtype=np.uint64), np.array(crowded(4, 10, 20), np.uint64)])
    x = x[np.argsort(simhash.gray_rank(x), kind="stable")]
    a, b, compared = simhash.near_pairs(x)
    want = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 3) + i + 1}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    assert compared < len(x) ** 2 / 4  # one order, nothing fixed
    pinned = simhash.near_pairs(x, None, 3, simhash.LEADING)
    assert pinned[2] < 40 * len(x)  # the leading quarter fixed
    cut = {(i, j) for i, j in want if (int(x[i]) ^ int(x[j])) >> 48 == 0}
    assert set(zip(pinned[0].tolist(), pinned[1].tolist(), strict=True)) == cut
    a, b, _ = simhash.near_pairs(x[:1500], x[1500:])
    assert {(i, j + 1500) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in want if i < 1500 <= j}


def test_gray_rank_orders_the_gray_code():
    n = np.arange(256, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_one_of_each(docs, empty):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 0 in ids and 7 not in ids and 14 not in ids  # copies
    assert not {1, 8, 15, 22, 29, 36} & set(ids)  # near copies of them
    assert ids.count(3) == 1 and {2, 4, 6, 54} <= set(ids)
    assert simhash.one_of_each(empty).count() == 0


def shingle_set(text, n=5):
    words = WORDS.findall((text or "").lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def first_of_each(rows, least=0.8):
    """The smallest doc_id of each component of pairs with a Jaccard similarity of at least ``least``, over all pairs."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    kept = {}
    for i, (doc_id, _) in enumerate(rows):
        kept[find(i)] = min(kept.get(find(i), doc_id), doc_id)
    return sorted(kept.values())


def test_one_of_each_is_that_of_all_pairs(spark):
    """Chains of changes: similarities on both sides of 0.8, and pairs that only a middle text connects."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, 500, 120)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(5):
            for at in rng.integers(0, 120, rng.integers(1, 5)):
                words[at] = f"w{rng.integers(0, 500)}"
            rows.append((len(rows), " ".join(words)))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == first_of_each(rows)


def test_one_of_each_among_many_texts_of_the_same_words(spark):
    """Many texts of one set of words, none alike; ten have a copy in which the set differs, too."""
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(60)])
    rows = [(i, " ".join(rng.permutation(words))) for i in range(1124)]
    many = len(rows)
    rows += [(many + i, f"{t} extra{i}") for i, t in rows[:10]]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(many))


@pytest.mark.parametrize("block", [2, 512])
def test_similar_links_compare_all_pairs_of_a_bucket(spark, block):
    """All in one bucket: the first is like none of them; the others are alike in twos."""
    texts = [" ".join(f"w{k}" for k in range(9000, 9030))]
    for i in range(2, 22):
        texts.append(" ".join(f"w{k}" for k in [*range(100 * (i // 2), 100 * (i // 2) + 30), 5000 + i]))
    nodes = [next(simhash._sets([pa.record_batch({"row": [0], "text": [t]})], 5)).column(0)[0].as_py() for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    keyed = spark.createDataFrame([(n, i, [7], 26 + (i > 0)) for i, n in enumerate(nodes)], "node long, row long, keys array<long>, size long")
    got = {frozenset((r.a, r.b)) for r in simhash.similar_links(rows, keyed, 8, block).collect()}
    assert got == {frozenset(nodes[i : i + 2]) for i in range(1, 21, 2)}


def test_sets_of_a_hot_key_meet_leads_and_what_these_leave(spark):
    """10,000 sets share a key; leads connect all but 20: these meet everything, the others don't meet one another."""
    nodes = spark.range(1, 10001).selectExpr("id * 7919 as node", "id as row", "array(7L, 1000000 + id) as keys", "30L as size")
    members, home = simhash.homes(nodes)
    first = simhash.first_units(home, 512).groupBy("side").count().collect()
    counts = {r.side: r["count"] for r in first}
    assert counts[1] <= 30 * 20 and 10000 - 30 <= counts[0] <= 10000
    roots = spark.range(2, 9981).selectExpr("id * 7919 as a", "7919L as b")
    rows = simhash.units(members, home, roots, 512).collect()
    assert len(rows) <= 10000 + 20 * 41 and len({r.node for r in rows}) == 10000
    at = {}
    for r in rows:
        at.setdefault((r.a, r.b), []).append(r)
    opened = {7919 * i for i in range(9981, 10001)}
    met = set()
    for (a, b), group in at.items():
        for x in group:
            met |= {frozenset((x.node, y.node)) for y in group if (a == b or x.side != y.side) and x.node in opened}
    assert len(met - {frozenset((x,)) for x in opened}) == 20 * 9980 + 190


def test_fingerprints_put_copies_together_that_share_no_key(spark):
    """Two texts of 400 words, of which one differs, and one of other words: the index finds the two where no key does, which is then counted."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(400))]
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    node = [int(np.uint64(simhash._hash(x.tobytes())).view(np.int64)) for x in sets]
    fp = [int(np.uint64(simhash.fingerprint(simhash.shingle_hashes(t.encode()))).view(np.int64)) for t in texts]
    nodes = spark.createDataFrame([(n, i, [i], len(s)) for i, (n, s) in enumerate(zip(node, sets, strict=True))], "node long, row long, keys array<long>, size long")
    rows, prints = spark.createDataFrame(list(enumerate(texts)), "row long, text string"), spark.createDataFrame(list(zip(node, fp, strict=True)), "node long, fp long")
    assert (fp[0] ^ fp[1]).bit_count() <= 3
    got = {frozenset((r.a, r.b)) for r in simhash.similar_links(rows, nodes, 8, prints=prints).collect()}
    assert got == {frozenset(node[:2])}


def _given(spark, texts, prints):
    """(rows, nodes, prints, the sets' hashes) of texts whose sets share no band key, with the fingerprints given."""
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    node = [int(np.uint64(simhash._hash(x.tobytes())).view(np.int64)) for x in sets]
    nodes = spark.createDataFrame([(n, i, [i], len(s)) for i, (n, s) in enumerate(zip(node, sets, strict=True))], "node long, row long, keys array<long>, size long")
    rows, prints = spark.createDataFrame(list(enumerate(texts)), "row long, text string"), spark.createDataFrame([(node[i], p) for i, p in prints], "node long, fp long")
    return rows, nodes, prints, node


@pytest.mark.parametrize("block", [4, 512])
def test_all_sets_of_a_large_component_of_fingerprints_meet(spark, block):
    """80 texts of one fingerprint and no key in common, alike in twos only: most are unlike the leads, and all pairs are found."""
    pair = lambda i: [f"w{i}x{k}" for k in range(60)]
    texts = [" ".join([*pair(i // 2)[: 60 - i % 2], f"end{i}"]) for i in range(80)]
    rows, nodes, prints, node = _given(spark, texts, [(i, 5) for i in range(80)])
    got = {frozenset((r.a, r.b)) for r in simhash.similar_links(rows, nodes, 8, block, prints=prints).collect()}
    assert got == {frozenset(node[i : i + 2]) for i in range(0, 80, 2)}


def test_a_set_of_several_fingerprints_meets_the_components_of_all(spark):
    """One set has two fingerprints that are far apart; sets like it have one of them each."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "a"]), " ".join([*words[:-1], "b"])]
    rows, nodes, prints, node = _given(spark, texts, [(0, 0), (0, (1 << 40) - 1), (1, 0), (2, (1 << 40) - 1)])
    roots = simhash.components(simhash.similar_links(rows, nodes, 8, prints=prints)).collect()
    assert {r.a for r in roots} | {r.b for r in roots} == set(node) and len({r.b for r in roots}) == 1


def test_shared_counts():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 9000, k)) for k in (5000, 4000, 1, 0, 7000)]
    got = simhash.shared_counts(np.repeat(np.arange(5), [len(x) for x in sets]), np.concatenate(sets), 5)
    for i in range(5):
        for j in range(5):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


@pytest.mark.parametrize(("block", "chunk"), [(512, 1024), (20, 7), (100, 50)])
def test_one_large_group_of_near_copies(spark, monkeypatch, block, chunk):
    """300 texts that each differ from one text in up to a dozen words: no two need be alike enough, chains are."""
    rng = np.random.default_rng(13)
    base = [f"w{i}" for i in rng.integers(0, 500, 150)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 7)):
            words[at] = f"w{rng.integers(0, 500)}"
        rows.append((i, " ".join(words)))
    real = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda *a, **k: real(*a, **k, block=block, chunk=chunk))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == first_of_each(rows)


def plain_choices(text, k=8, window=32):
    return winnow.chosen(winnow.code_points(text), k, window)


def test_winnowing_keeps_its_guarantee():
    rng = np.random.default_rng(4)
    letters = "abcdefgh é\U0001f600"
    text = lambda n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    for _ in range(50):
        shared = text(winnow.K + winnow.WINDOW - 1)
        a, b = text(400) + shared + text(300), text(350) + shared + text(500)
        assert np.intersect1d(winnow.hashes(plain_choices(a)), winnow.hashes(plain_choices(b))).size


def test_winnowing_takes_the_rightmost_smallest():
    text = "ab" * 300  # two different grams: ties everywhere
    c = plain_choices(text)
    at = (c & np.uint64(0xFFFFFFFF)).astype(int)
    h = winnow.hashes(c)
    assert len(set(h.tolist())) == 1 and (np.diff(at) == 2).all() and at[0] >= winnow.WINDOW - 2


def windows_by_hand(text, k=winnow.K, window=winnow.WINDOW):
    """Positions chosen window by window from each gram's hash."""
    if not text:
        return []
    points = winnow.code_points(text)
    grams = [points[i : i + k] for i in range(max(1, len(points) - k + 1))]
    h = [int(winnow.chosen(g, k, 1)[0] >> np.uint64(32)) for g in grams]
    picked = []
    for i in range(max(1, len(h) - window + 1)):
        part = h[i : i + window]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if not picked or picked[-1] != at:
            picked.append(at)
    return [(h[i], i) for i in picked]


def likeness_by_hand(a, b):
    a, b = Counter(h for h, _ in a), Counter(h for h, _ in b)
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 1.0


def test_choices_are_those_of_every_window():
    rng = np.random.default_rng(5)
    for n in [0, 1, 2, 3, 5, 7, 8, 9, 12, 20, 31, 38, 39, 40, 41, 80, 200, 400]:
        for letters in ("ab", "abcdefghij é\U0001f600"):
            text = "".join(letters[i] for i in rng.integers(0, len(letters), n))
            got = winnow.chosen(winnow.code_points(text))
            assert [(int(c) >> 32, int(c) & 0xFFFFFFFF) for c in got] == windows_by_hand(text)


def test_short_and_long_texts_share_their_passages():
    rng = np.random.default_rng(6)
    text = lambda n: "".join(chr(97 + i) for i in rng.integers(0, 26, n))
    for _ in range(30):
        shared = text(winnow.K + winnow.WINDOW - 1)
        pair = [winnow.hashes(winnow.chosen(winnow.code_points(t))) for t in (shared, text(9) + shared, text(2000) + shared + text(30))]
        assert np.intersect1d(pair[0], pair[1]).size and np.intersect1d(pair[0], pair[2]).size and np.intersect1d(pair[1], pair[2]).size


@pytest.mark.parametrize("per_task", [1, 8])
def test_fingerprints(docs, empty, spark, per_task):
    hot = spark.createDataFrame([(3, f"hot {i} " * (i % 9)) for i in range(80)] + [(None, f"lost {i}") for i in range(80)] + [(None, None), (None, "lost 1")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(hot).repartition(3)
    order = [(r.doc_id, r.text) for r in rows.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").orderBy(F.desc_nulls_last("doc_id"), "h").collect()]
    got = [tuple(r) for r in winnow.fingerprints(rows, per_task).collect()]
    want = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = map(windows_by_hand, (t, changed, following))
        text = lambda picks: "".join(f"{h:08x}{p:08x}" for h, p in picks)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), text(a), text(b), likeness_by_hand(a, b), likeness_by_hand(a, c)))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert winnow.fingerprints(empty).count() == 0
    one = winnow.fingerprints(spark.createDataFrame([(1, "some words and more of them")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(("some words and more of them"[:14] + "some words and more of them"[:13]).encode()).hexdigest()


def plain_removal(rows, n=50):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    least = {}
    big = 1 << 63
    for i, w in words:
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            least[key] = min(least.get(key, big), big if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - n + 1):
            if least[tuple(w[s : s + n])] < (big if i is None else i):
                gone |= set(range(s, s + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_removal(docs, empty):
    rows = [(i, t) for i, t in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in substrings.removal_digest(docs).collect()]
    assert sorted(got, key=key) == sorted(plain_removal(rows), key=key)
    assert any(r[2] for r in got)
    assert substrings.removal_digest(empty).count() == 0


def test_removal_with_periodic_and_overlapping_passages(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [
        " ".join(base[:120]), " ".join(base[60:180]), " ".join(["to"] * 130), " ".join(["to"] * 49), " ".join(["to"] * 51 + base[:49]), " ".join(base[31:81]),
        " ".join(["z"] + base[10:60] + ["q"] + base[70:125]), " ".join(["to", "be"] * 60),
    ]
    rows = list(enumerate(texts)) + [(2, texts[2]), (9, texts[0])]
    got = [tuple(r) for r in substrings.removal_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got) == sorted(plain_removal(rows))


def test_removal_among_rows_without_id_and_of_repeated_ids(spark):
    """Rows that share no id or one id differ in text; all hold passages of other rows, some in contexts of their own."""
    rng = np.random.default_rng(17)
    shared = [[f"s{k}x{i}" for i in range(70)] for k in range(4)]
    rows = [(3, " ".join(shared[0])), (1 << 62, " ".join(shared[3])), ((1 << 63) - 2, " ".join(shared[1] + shared[0][:55]))]
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 9000, 30)]
        for k in rng.permutation(4)[:2]:
            words += shared[k][int(rng.integers(0, 15)) :] + [f"w{rng.integers(0, 9000)}"]
        rows.append(((None, 7, 7, i)[i % 4], " ".join(words)))
    rows += [(None, None), (7, ""), (7, None), rows[5], rows[5], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(plain_removal(rows), key=key)
    assert sorted((tuple(r) for r in substrings.removal_digest(docs).collect()), key=key) == want
    assert sum(r[2] > 0 for r in want if r[0] is None) > 20 and sum(r[2] > 0 for r in want if r[0] == 7) > 20
    stripped = substrings.without_repeats(docs.withColumn("doc", F.lit(1)).withColumn("of_doc", F.lit(2)).withColumn("Mark", F.lit(3)))
    assert stripped.columns == ["doc_id", "text", "doc", "of_doc", "Mark"]
    got = sorted(((r.doc_id, hashlib.sha256(" ".join(WORDS.findall(r.text or "")).encode()).hexdigest()) for r in stripped.collect()), key=key)
    assert got == sorted(((i, h) for i, n, gone, h in want if gone == 0 or gone < n), key=key)


def test_the_largest_id_stays(spark):
    rows = spark.createDataFrame([((1 << 63) - 1, "a"), (None, "b")], "doc_id long, text string")
    assert {r.doc_id for r in substrings.removal_digest(rows).collect()} == {(1 << 63) - 1, None}


def test_many_rows_without_id_get_their_own_hashes_only(spark):
    """10,000 rows without id hold one passage of a row with one; each is told of its own anchors and windows."""
    passage = " ".join(f"p{i}" for i in range(100))
    tail = F.expr("concat_ws(' ', transform(sequence(1, 60), x -> concat('t', id, 'y', x)))")
    rows = spark.range(10000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(f"{passage} "), tail).alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(5, f"{passage} end")], "doc_id long, text string"))
    told = substrings.repeats(*substrings._placed(docs, "doc", "mark"))
    anchors, windows, n = told.select(F.max(F.size("covered")), F.max(F.size("windows")), F.count("*")).first()
    assert 1 <= anchors <= 40 and 1 <= windows <= 112 and n == 10000
    assert {tuple(r) for r in substrings.removal_digest(docs).groupBy("n_removed").count().collect()} == {(0, 1), (100, 10000)}


def test_cover_is_a_difference_cover():
    p = substrings.PERIOD
    assert {(a - b) % p for a in substrings.COVER for b in substrings.COVER} == set(range(p))


def test_texts_without_repeats(docs, empty):
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    rows = docs.select("doc_id", "text").collect()
    for (i, t), (_, n, gone, _) in zip(rows, plain_removal([tuple(r) for r in rows]), strict=True):
        if gone == 0:
            assert (i, t) in got
        elif gone == n:
            assert i is None or all(j != i for j, _ in got)
    assert substrings.without_repeats(empty).count() == 0
