"""Resolution against plain loops: tiers, nearest names, mentions and names after prepositions."""

from __future__ import annotations

import random

import pytest

from tallyweave.functions import similarity
from tallyweave.operators import resolve, vocabulary
from tallyweave.operators.model import small
from tallyweave.plans.storage import stored


def made_names(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    stems = ["SWIGGY", "AMAZON", "FOO", "BAR", "TATA", "POWER", "ROY", "BIG", "BASKET", "A", "OF", "NAVYUG", "SELECTION", "É", "O'NEIL"]
    out = {" ".join(rng.choice([rng.choice(stems), "".join(rng.choice("ABCDEIOU") for _ in range(rng.randint(1, 12)))]) for _ in range(rng.randint(1, 5))) for _ in range(n)}
    return sorted(out) + ["X" * 80, "FOO FOO", "A"]


def test_block_finds_the_nearest_names():
    names, rng = made_names(500, 1), random.Random(2)
    block = similarity.Block(names)
    asked = [*rng.sample(names, 25), "SWIGY", "Q", "ZZZZ", "SWIGGY INSTAMART ROY", "TATA TATA", "Y" * 90, "A B C D E F G H I J K L M", "BASKT BIG STORE OF"]
    for q in asked:
        full = [similarity._best(q, n) for n in names]
        kth = sorted(full)[-5]
        at, score = block.top(q, 5)
        assert dict(zip(at.tolist(), score.tolist(), strict=True)) == {i: s for i, s in enumerate(full) if s >= kth}, q
    assert similarity.Block([]).top("A", 5)[0].tolist() == []


def test_bound_leaves_most_names_out():
    rng = random.Random(3)
    names = ["".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(12)) for _ in range(2000)]
    block = similarity.Block(names)
    for n in names[:20]:
        block.top(n[:5] + "X" + n[6:], 5)
    assert block.scored < 0.4 * 20 * len(names)


def test_alike_equals_all_pairs():
    names = made_names(300, 7)
    known = similarity.Alike(names)
    for least in (70, 92):
        for q in [*names[::5], "SWIGY", "TATA FOO", "Y" * 90]:
            at, score = known.of(q, least)
            assert dict(zip(at.tolist(), score.tolist(), strict=True)) == {i: s for i, n in enumerate(names) if (s := similarity.token_set_ratio(q, n)) >= least}


def test_similar_pairs_are_all_found_and_few_are_met(spark):
    """Names with random words of few letters: at 92 and at 70 all pairs, and by the keys few that aren't alike."""
    rng = random.Random(8)
    base = ["".join(rng.choice("ABCDEFGH") for _ in range(rng.randint(3, 14))) + rng.choice(["", " ROY", " BIG STORE"]) for _ in range(60)]
    cut = lambda n: " ".join((n[:i] + rng.choice(["", "A", " "]) + n[i + rng.randint(0, 1) :]).split()) if (i := rng.randrange(len(n))) else n
    names = sorted({*base, *(cut(cut(b)) for b in base for _ in range(3)), "FOO FOO", "X" * 80, "X" * 78} - {""})
    ranked = spark.createDataFrame([(n, n) for n in names], "name string, rank string")
    for least in (92, 70):
        got = {(r.high, r.low): r.score for r in vocabulary.similar_pairs(ranked, least).collect()}
        assert got == {(a, b): s for i, a in enumerate(names) for b in names[i + 1 :] if (s := similarity.token_set_ratio(a, b)) >= least}
    many = spark.createDataFrame([(f"BIG RING {w}",) for w in {"".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(12)) for _ in range(3000)}], "name string")
    keys = vocabulary._letter_keys(many.selectExpr("name", "name AS rank", "true AS fresh", "split(name, ' ') AS words"), 0.92).groupBy("g", "key").pivot("less", [0, 1]).count().na.fill(0)
    met = keys.selectExpr("sum(`0` * (`0` - 1) / 2 + `0` * `1`)").first()[0]
    assert met < 0.02 * 3000 * 3000 / 2


VOCAB = "entity_id string, merchant_norm string, counterparty_kind string, txn_count long, total_credit double"


@pytest.fixture(scope="module")
def dim(spark):
    rng = random.Random(4)
    rows = [(e, n, "merchant", rng.randint(1, 9), 0.0) for e in ("1", "2", "3") for n in made_names(200, int(e)) + [f"ALMOND N{i:03}" for i in range(60)]]
    return rows, spark.createDataFrame(rows, VOCAB).repartition(3)


def asked_names(rows):
    rng = random.Random(5)
    some = [(e, rng.choice([n, n[:4], n.lower(), n[2:7], " ".join(n.split()[:2]), n.split()[-1], n[:3] + "Z" + n[3:]])) for e, n, *_ in rng.sample(rows, 150)]
    return [*some, *some[:20], ("1", "almond"), ("1", "ALMO"), ("2", "almond"), ("1", ""), ("1", None), (None, "FOO"), ("9", "FOO"), ("1", "Bundl Technologies"), ("3", "swigy ltd")]


def test_nearest_names_of_cells(spark, dim, monkeypatch):
    monkeypatch.setattr(resolve, "NAMES", 50)
    monkeypatch.setattr(resolve, "ASKED", 7)
    rows, vocab = dim
    asked = sorted({(e, n.upper()) for e, n in asked_names(rows) if n and e})
    got = {}
    for r in resolve.nearest(spark.createDataFrame(asked, "entity_id string, q string"), vocab, 5).collect():
        got.setdefault((r.entity_id, r.q), {})[r["rank"]] = (r.merchant_norm, r.score)
    for e, q in asked:
        best = sorted((-similarity._best(q, n), -c, n) for own, n, _, c, _ in rows if own == e)[:5]
        assert got.get((e, q), {}) == {i: (n, -s) for i, (s, _, n) in enumerate(best, 1)}


def test_ties_are_counted_and_few_are_shown(spark, dim):
    rows, vocab = dim
    mentions = spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate(asked_names(rows))], "mention_id int, entity_id string, name string")
    by = {}
    for r in resolve.tiered(mentions, vocab).collect():
        by.setdefault(r.mention_id, []).append(r)
    almond = next(i for i, (e, n) in enumerate(asked_names(rows)) if (e, n) == ("1", "almond"))
    assert len(by[almond]) == 5 and {r.n for r in by[almond]} == {60} and {r.tier for r in by[almond]} == {5}
    assert [r.txn_count for r in sorted(by[almond], key=lambda r: r["rank"])] == sorted((c for e, n, _, c, _ in rows if e == "1" and n.startswith("ALMOND ")), reverse=True)[:5]
    assert all(len(v) == min(5, v[0].n) for v in by.values())
    for i, (e, n) in enumerate(asked_names(rows)):
        q = (n or "").upper()
        hold = [m for own, m, *_ in rows if own == e and f" {q} " in f" {m} "]
        if i in by and by[i][0].tier == 5 and q.isalpha():
            assert by[i][0].n == len(hold)


def test_all_names_of_the_best_tier(spark, dim):
    rows, vocab = dim
    mentions = spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate(asked_names(rows))], "mention_id int, entity_id string, name string")
    by = {}
    for r in resolve.tiers(mentions, vocab).collect():
        by.setdefault(r.mention_id, []).append(r)
    almond = next(i for i, (e, n) in enumerate(asked_names(rows)) if (e, n) == ("1", "almond"))
    assert [r.merchant_norm for r in sorted(by[almond], key=lambda r: r["rank"])] == [m for c, m in sorted((-c, m) for e, m, _, c, _ in rows if e == "1" and m.startswith("ALMOND "))]
    first = {(r.mention_id, r["rank"]): r for r in resolve.tiered(mentions, vocab).collect()}
    assert {(i, r["rank"]): r for i, v in by.items() for r in v if r["rank"] <= 5} == first
    assert all(sorted(r["rank"] for r in v) == list(range(1, v[0].n + 1)) for v in by.values())


def test_keys_of_names_are_never_broadcast(spark, dim, monkeypatch):
    """Spark takes the exploded keys of a stored vocabulary for as few bytes as its names; only what is counted is broadcast."""
    rows, vocab = dim
    mentions = spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate(asked_names(rows))], "mention_id int, entity_id string, name string")
    mentions, vocab, real, plans = stored(mentions, "mentions"), stored(vocab, "vocabulary"), resolve.stored, []
    monkeypatch.setattr(resolve, "stored", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), real(df, tag))[1])
    monkeypatch.setattr(resolve, "BROADCAST_ROWS", 40)
    assert resolve.resolved(mentions, vocab).count() == len(asked_names(rows))
    assert sum(tag == "rarest-keys" for tag, _ in plans) == 2 and sum(tag == "nearest" for tag, _ in plans) == 1
    assert not [tag for tag, plan in plans if tag in ("rarest-keys", "asked", "settled") and "BroadcastHashJoin" in plan]
    assert "BroadcastHashJoin" not in next(plan for tag, plan in plans if tag == "hits")
    many = spark.range(1).selectExpr("explode(sequence(1L, 300000L)) as id")
    assert "BroadcastHashJoin" not in spark.range(10).join(small(many), "id")._jdf.queryExecution().executedPlan().toString()


def test_mentions_equal_a_plain_search(spark, dim):
    rows, vocab = dim
    rng = random.Random(6)
    texts = [(i, e, " ".join([rng.choice(["paid", "to", "FOO"]), rng.choice([n, n.lower(), n[1:]]), rng.choice(["-ref", "/x", "roy", ""])])) for i, (e, n, *_) in enumerate(rng.sample(rows, 200))]
    got = {r.text_id: r.merchant_norm for r in resolve.mentioned(spark.createDataFrame(texts, "text_id int, entity_id string, text string"), vocab).collect()}
    want = {}
    for i, e, t in texts:
        clean = " " + " ".join("".join(c if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789&.'-" else " " for c in t.upper()).split()) + " "
        if hits := [n for own, n, *_ in rows if own == e and f" {n} " in clean]:
            want[i] = max(hits, key=lambda n: (len(n), n))
    assert got == want and len(got) > 100


def test_names_after_prepositions(spark):
    cases = {
        "how much did I spend on Oracle last month": "Oracle", "what did I send to Wells Fargo?": "Wells Fargo", "spend on which month I have high expense": None, "how much for Uber Eats in April": "Uber Eats",
        "compare it to the 3 months before": None, "payments from me": None, "spend with O'Neil & Sons, please": "O'Neil & Sons", "balance": None, "spend on ab": None, None: None, "": None,
    }
    vocab = spark.createDataFrame([("1", "UBER EATS", "merchant", 1, 0.0), ("1", "BANK CHARGES", "bank_charge", 1, 0.0)], VOCAB)
    texts = spark.createDataFrame([(i, "1", t) for i, t in enumerate(cases)], "text_id int, entity_id string, text string")
    got = {list(cases)[r.text_id]: (r.name, r.known) for r in resolve.names_asked(texts, vocab).collect()}
    assert got == {t: ("UBER EATS", True) if n == "Uber Eats" else (n, False) for t, n in cases.items()}
