"""From raw counterparty strings to canonical names and kinds, over the distinct vocabulary only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, similarity
from ..plans.storage import dealt, stored
from ..terms import BRANDS, CLUSTER_FROM, CLUSTER_LENGTH, CORPORATE, FEE, FEE_LABEL, PERSON_FROM, PERSON_WORDS, SELF, SELF_LABEL, UNKNOWN


def vocabulary(extracted: DataFrame) -> DataFrame:
    """(merchant_raw, freq, credits, credit_ratio) of each distinct string."""
    credit = F.count_if(F.col("transaction_type") == "credit")
    out = extracted.filter("merchant_raw is not null").groupBy("merchant_raw").agg(F.count("*").alias("freq"), credit.alias("credits"))
    return out.withColumn("credit_ratio", F.col("credits") / F.col("freq"))


def folded(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` with norm, the normalised name, and brand, that name or the brand that it belongs to."""
    sentinel = F.col("merchant_raw").isin(FEE, SELF)
    norm = F.when(sentinel, F.col("merchant_raw")).otherwise(F.coalesce(F.nullif(names.normalised(F.col("merchant_raw")), F.lit("")), F.lit(UNKNOWN)))
    brands = F.create_map(*(F.lit(x) for kv in BRANDS.items() for x in kv))
    return vocabulary.withColumn("norm", norm).withColumn("brand", F.coalesce(F.try_element_at(brands, F.col("norm")), F.col("norm")))


def _rarest(rows: DataFrame, key: str, kept: Column) -> DataFrame:
    """``rows`` (name, rank, size, key, ...) that lie among the ``kept`` rarest keys of their name."""
    often = rows.groupBy(key).agg(F.count("*").alias("often"))
    order = Window.partitionBy("name").orderBy("often", key)
    return rows.join(often, key).withColumn("nth", F.row_number().over(order)).withColumn("past", F.sum(F.length(key)).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(kept)


#: Below this score letters leave too many pairs open, so names meet in cells of two blocks of ``BLOCK``.
CELLS_BELOW, BLOCK = 85.0, 4096


def _letter_keys(rows: DataFrame, t: float) -> DataFrame:
    """``rows`` with g, key, less and bag: keys of their letters of which two names that are alike have one in common.

    Two texts at t differ in k = (1 - t) * (their lengths) letters at most, in whatever order these are. Of g = k // 2 + 1
    groups of the alphabet one holds at most one of them, so there the letters are the same or one name has one more.
    Keys are those of a group's letters and of these without one (less = 1), for each g that a name's partners can ask
    for. ``bag`` counts letters in 16 classes of 4 bits.
    """
    letters = F.sort_array(F.regexp_extract_all(F.array_join("words", " "), F.lit("[^ ]"), F.lit(0)))
    rows = rows.withColumn("letters", letters).withColumn("len", F.length(F.array_join("words", " "))).filter("len > 0")
    least, most = F.col("len") + F.ceil(F.col("len") * t / (2 - t) - 1e-9), F.col("len") + F.floor(F.col("len") * (2 - t) / t + 1e-9)
    groups = lambda total: (F.floor(F.floor((1 - t) * total + 1e-9) / 2) + 1).cast("int")
    count = lambda i: F.least(F.size(F.filter("letters", lambda c: F.ascii(c) % 16 == i)), F.lit(15)).cast("bigint")
    bag = F.lit(0).cast("bigint")
    for i in range(16):
        bag = bag.bitwiseOR(F.shiftleft(count(i), 4 * i))
    # a letter's nth occurrence has a code of its own, so that the codes of a bag are a set
    code = F.transform("letters", lambda c, i: F.struct(c.alias("c"), F.xxhash64(c, i - F.array_position("letters", c)).alias("h"), (F.coalesce(F.get("letters", i + 1), F.lit("")) != c).alias("last")))
    rows = rows.withColumns({"bag": bag, "codes": code, "g": F.explode(F.sequence(groups(least), groups(most)))})
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumn("codes", F.filter("codes", lambda x: F.ascii(x["c"]) % F.col("g") == F.col("i")))
    rows = rows.withColumn("whole", F.aggregate("codes", F.xxhash64("g", "i"), lambda a, x: a.bitwiseXOR(x["h"])))
    fewer = F.transform(F.filter("codes", lambda x: x["last"]), lambda x: F.struct(F.col("whole").bitwiseXOR(x["h"]).alias("key"), F.lit(1).alias("less")))
    keys = F.concat(F.array(F.struct(F.col("whole").alias("key"), F.lit(0).alias("less"))), fewer)
    return rows.withColumn("k", F.explode(keys)).select("name", "rank", "fresh", "len", "bag", "g", "k.key", "k.less")


def _cell(a: pd.DataFrame, b: pd.DataFrame, least: float) -> pd.DataFrame:
    """(x, y, score) of the names of two blocks that are alike; of one block with itself each pair once."""
    rows = []
    if len(a) and len(b):
        names_, own = b["name"].to_list(), a["block"].iloc[0] == a["other"].iloc[0]
        known = similarity.Alike(names_)
        for x in a["name"]:
            at, score = known.of(x, least)
            rows += [(x, names_[i], s) for i, s in zip(at.tolist(), score.tolist(), strict=True) if not own or x < names_[i]]
    return pd.DataFrame(rows, columns=["x", "y", "score"])


def _pairs_of_cells(names_: DataFrame, least: float) -> DataFrame:
    """(high, low, high_rank, low_rank, fresh, score) of all names that are alike: every block of names is compared with every other one."""
    rows = stored(names_, "names")
    n = max(1, -(-rows.count() // BLOCK))
    dealt_ = rows.select("name", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias("own"))
    left = dealt_.select("name", F.col("own").alias("block"), F.explode(F.sequence(F.col("own"), F.lit(n - 1))).alias("other"))
    right = dealt_.select("name", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"), F.col("own").alias("other"))
    key = ["block", "other"]
    found = dealt(left, *key).groupBy(*key).cogroup(dealt(right, *key).groupBy(*key)).applyInPandas(lambda a, b: _cell(a, b, least), "x string, y string, score double")
    side = lambda c: rows.select(F.col("name").alias(c), F.col("rank").alias(f"{c}_rank"), F.col("fresh").alias(f"{c}_fresh"))
    found = stored(found, "alike").join(side("x"), "x").join(side("y"), "y")
    first = F.col("x_rank") < F.col("y_rank")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return found.filter("x_fresh or y_fresh").select(pick("x", "y").alias("high"), pick("y", "x").alias("low"), pick("x_rank", "y_rank").alias("high_rank"), pick("y_rank", "x_rank").alias("low_rank"), "score")


def similar_pairs(names_: DataFrame, least: float = CLUSTER_FROM, fresh: bool = False) -> DataFrame:
    """(high, low, high_rank, low_rank, score) of names that are alike; ``high`` has the smaller rank. Names: (name, rank).

    With ``fresh`` names have a column of that name, and pairs without a fresh name aren't sought.

    At a high threshold pairs are found by keys that few names share, and none is lost:

    * Where the shared words make a pair alike, they hold at least t / (2 - t) of the letters of one name, t being the
      threshold. So one of its rarest words is among them, of which all but less than that share of letters is taken.
    * Else letters that are missing decide, of which there are few (``_letter_keys``).

    Pairs are then scored. At a low one (``CELLS_BELOW``) nearly all names share some letters, and those that are alike
    grow with the square of the names: all are compared, in cells of bounded size, where letters rule most pairs out.
    """
    t = least / 100
    part = t / (2 - t)
    rows = names_ if fresh else names_.withColumn("fresh", F.lit(True))
    if least < CELLS_BELOW:
        return _pairs_of_cells(rows, least)
    rows = rows.withColumn("words", F.array_distinct(F.filter(F.split("name", " "), lambda w: w != ""))).withColumn("size", F.length(F.regexp_replace("name", " ", "")))
    words = rows.select("name", "rank", "fresh", "size", F.explode("words").alias("key"))
    probe = _rarest(words, "key", F.coalesce("past", F.lit(0)) <= (1 - part) * F.col("size") + 1).select("name", "rank", "fresh", "key")
    keyed = stored(_letter_keys(rows, t), "letter-keys")

    def met(one: DataFrame, other: DataFrame, near: Column | None = None) -> DataFrame:
        left, right = (df.select(*(F.col(c).alias(c if c == "key" else f"{side}_{c}" if c not in ("name",) else side) for c in df.columns)) for df, side in ((one, "x"), (other, "y")))
        both, first = left.join(right, "key").filter("x_rank <> y_rank"), F.col("x_rank") < F.col("y_rank")
        both = both if near is None else both.filter(near)
        pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
        return both.select(pick("x", "y").alias("high"), pick("y", "x").alias("low"), pick("x_rank", "y_rank").alias("high_rank"), pick("y_rank", "x_rank").alias("low_rank"))

    k = F.floor((1 - t) * (F.col("x_len") + F.col("y_len")) + 1e-9)
    apart = F.lit(0)
    for i in range(16):
        nibble = lambda c, i=i: F.shiftrightunsigned(c, 4 * i).bitwiseAND(F.lit(15))
        apart = apart + F.abs(nibble("x_bag") - nibble("y_bag"))
    near = (F.col("x_g") == F.col("y_g")) & (F.col("x_g") == F.floor(k / 2) + 1) & (F.abs(F.col("x_len") - F.col("y_len")) <= k) & (apart <= k)
    near = near & (F.col("x_fresh") | F.col("y_fresh")) & ((F.col("y_less") == 1) | (F.col("x_rank") < F.col("y_rank")))
    pairs = met(probe.filter("fresh"), words.drop("size")).unionByName(met(keyed.filter("less = 0"), keyed, near))
    if fresh:
        pairs = pairs.unionByName(met(probe.filter("not fresh"), words.drop("size").filter("fresh")))
    pairs = dealt(pairs, "high", "low").distinct()
    return pairs.withColumn("score", similarity.token_set(least)("high", "low")).filter(F.col("score") >= least)


def clusters(counted: DataFrame, least: float = CLUSTER_FROM, anchors: DataFrame | None = None) -> DataFrame:
    """(name, canonical) from (name, freq): each name goes to the best anchor, as one pass by falling frequency would.

    A name is an anchor if none of the names before it that are like it is one. That is settled in rounds, for all
    names at once, until none is open: the first open name in rank is settled in every round. Short names are anchors always.

    ``anchors`` (name, freq) are there already and come before all others; names are compared with them and with each
    other, but they aren't compared among themselves.
    """
    rank = lambda late: F.struct(F.lit(late).alias("late"), (-F.col("freq")).alias("f"), F.col("name").alias("n"))
    ranked = counted.select("name", "freq")
    if anchors is not None:
        ranked = ranked.join(anchors.select("name"), "name", "left_anti")
    ranked = ranked.select("name", rank(1).alias("rank"), F.lit(True).alias("fresh"))
    if anchors is not None:
        ranked = ranked.unionByName(anchors.select("name", rank(0).alias("rank"), F.lit(False).alias("fresh")))
    ranked = stored(ranked, "names")
    edges = similar_pairs(ranked, least, fresh=True).filter((F.length("low") >= CLUSTER_LENGTH) & (F.col("low_rank.late") == 1))
    edges = stored(edges.select("high", "low", "high_rank", "score"), "name-pairs")
    state = stored(ranked.select("name", F.when(~F.col("fresh"), True).alias("anchor")), "name-state")
    while True:
        before = edges.join(state.withColumnRenamed("name", "high"), "high").groupBy(F.col("low").alias("name"))
        before = before.agg(F.bool_or(F.coalesce("anchor", F.lit(False))).alias("taken"), F.bool_and(F.coalesce(~F.col("anchor"), F.lit(False))).alias("free"))
        new = F.when(F.col("anchor").isNotNull(), F.col("anchor")).when(F.coalesce("taken", F.lit(False)), False).when(F.coalesce("free", F.lit(True)), True)
        state = stored(state.join(before, "name", "left").select("name", new.alias("anchor")), "name-state")
        if state.filter("anchor is null").isEmpty():
            break
    best = edges.join(state.filter("anchor").select(F.col("name").alias("high")), "high").groupBy(F.col("low").alias("name")).agg(F.min_by("high", F.struct(-F.col("score"), F.col("high_rank"))).alias("to"))
    return state.join(best, "name", "left").select("name", F.when(F.col("anchor"), F.col("name")).otherwise(F.col("to")).alias("canonical"))


def aliases(vocabulary: DataFrame, cluster: bool = True, known: DataFrame | None = None) -> DataFrame:
    """(merchant_raw, merchant_norm, counterparty_kind, kind_confidence) of each distinct string.

    ``known`` (merchant_norm, counterparty_kind, kind_confidence, freq) are names that are there already: strings join
    them where they are the same or alike, and their kinds stay.
    """
    # stored, as a filter on the name that a join adds would be pushed below the counting, where it normalises every transaction's string
    rows = stored(folded(vocabulary), "vocabulary")
    if cluster:
        named = rows.filter(~F.col("brand").isin(FEE, SELF, UNKNOWN)).groupBy(F.col("brand").alias("name")).agg(F.sum("freq").alias("freq"))
        anchors = None if known is None else known.filter(~F.col("merchant_norm").isin(FEE_LABEL, SELF_LABEL, UNKNOWN)).select(F.col("merchant_norm").alias("name"), "freq")
        rows = rows.join(clusters(named, anchors=anchors).withColumnRenamed("name", "brand"), "brand", "left").withColumn("canonical", F.coalesce("canonical", "brand"))
    else:
        rows = rows.withColumn("canonical", F.col("brand"))
    rank = F.row_number().over(Window.partitionBy("canonical").orderBy("merchant_raw"))
    first = rows.select("canonical", "merchant_raw").withColumn("k", rank).filter(F.col("k") <= 5)  # no name carries all its strings
    samples = first.groupBy("canonical").agg(F.sort_array(F.collect_list("merchant_raw")).alias("samples"))
    per = rows.groupBy("canonical").agg(F.sum("freq").alias("n"), F.sum("credits").alias("c")).join(samples, "canonical")
    score = names.kind_score(F.col("canonical"), F.col("samples"), F.col("c") / F.col("n"), F.col("n"))
    per = per.select("canonical", score.alias("score"))
    out = rows.join(per, "canonical").select("merchant_raw", label(F.col("canonical")).alias("merchant_norm"), *kinds(F.col("canonical"), F.col("score")))
    if known is None:
        return out
    old = known.select("merchant_norm", F.col("counterparty_kind").alias("old_kind"), F.col("kind_confidence").alias("old_sure"))
    kept = lambda a, b: F.coalesce(F.col(a), F.col(b)).alias(b)
    return out.join(old, "merchant_norm", "left").select("merchant_raw", "merchant_norm", kept("old_kind", "counterparty_kind"), kept("old_sure", "kind_confidence"))


def statistics(vocabulary: DataFrame, aliases: DataFrame, bank: DataFrame) -> DataFrame:
    """One row: distinct raw strings, distinct canonical names, and bank codes kept out of the names."""
    raw = vocabulary.agg(F.count("*").alias("raw_strings"), F.sum("freq").alias("named_transactions"))
    names_ = aliases.agg(F.count_distinct("merchant_norm").alias("canonical_names"))
    return raw.crossJoin(names_).crossJoin(bank.agg(F.count_distinct(F.upper("bank_code")).alias("codes_stopped")))  # one row each


def label(canonical: Column) -> Column:
    return F.when(canonical == FEE, FEE_LABEL).when(canonical == SELF, SELF_LABEL).otherwise(canonical)


def kinds(canonical: Column, score: Column) -> list[Column]:
    """counterparty_kind and kind_confidence."""
    kind = F.when(canonical == FEE, "bank_charge").when(canonical == SELF, "self_transfer").when(canonical == UNKNOWN, "unknown")
    sure = F.when(canonical.isin(FEE, SELF, UNKNOWN), 1.0)
    return [kind.otherwise(names.kind(score)).alias("counterparty_kind"), sure.otherwise(names.kind_confidence(score)).alias("kind_confidence")]


def preserved(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases of an increment: strings that have one keep it."""
    return existing.unionByName(new.join(existing, "merchant_raw", "left_anti"))


_BRAND_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRANDS.items())
_WORDS = "string_split(brand, ' ')"
#: The alias table without clusters for DuckDB, after the extraction.
ORACLE = f"""
vocab AS (SELECT merchant_raw, count(*) AS freq, count(*) FILTER (WHERE transaction_type = 'credit') AS credits FROM extracted WHERE merchant_raw IS NOT NULL GROUP BY merchant_raw),
normed AS (SELECT *, CASE WHEN merchant_raw IN ('{FEE}', '{SELF}') THEN merchant_raw ELSE coalesce(nullif({names.sql_normalised("merchant_raw")}, ''), '{UNKNOWN}') END AS norm FROM vocab),
branded AS (SELECT *, CASE norm {_BRAND_SQL} ELSE norm END AS brand FROM normed),
canon AS (SELECT brand, sum(freq) AS n, sum(credits) AS c, list_sort(list(DISTINCT merchant_raw))[1:5] AS samples FROM branded GROUP BY brand),
scored AS (SELECT brand, n,
   CASE WHEN list_has_any({_WORDS}, [{", ".join(f"'{w}'" for w in CORPORATE)}]) THEN -3 ELSE 0 END
   + CASE WHEN len({_WORDS}) = 1 THEN -2 WHEN len({_WORDS}) BETWEEN 2 AND {PERSON_WORDS} AND len(list_filter({_WORDS}, lambda w: NOT regexp_matches(w, '^\\pL+$'))) = 0 THEN 1 ELSE 0 END
   + CASE WHEN len(list_filter(samples, lambda s: s <> upper(s) AND s <> lower(s))) > 0 THEN 2 ELSE 0 END
   + CASE WHEN c::DOUBLE / n > 0.6 THEN 2 WHEN c::DOUBLE / n < 0.2 THEN -1 ELSE 0 END + CASE WHEN n <= 3 THEN 1 ELSE 0 END AS score FROM canon),
alias AS (SELECT merchant_raw, CASE b.brand WHEN '{FEE}' THEN '{FEE_LABEL}' WHEN '{SELF}' THEN '{SELF_LABEL}' ELSE b.brand END AS merchant_norm,
   CASE WHEN b.brand = '{FEE}' THEN 'bank_charge' WHEN b.brand = '{SELF}' THEN 'self_transfer' WHEN b.brand = '{UNKNOWN}' THEN 'unknown' WHEN score >= {PERSON_FROM} THEN 'person' ELSE 'merchant' END AS counterparty_kind,
   CASE WHEN b.brand IN ('{FEE}', '{SELF}', '{UNKNOWN}') THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 0.5::DOUBLE + abs(score) / 8.0::DOUBLE), 2) END AS kind_confidence
   FROM branded b JOIN scored s ON b.brand = s.brand)
"""
