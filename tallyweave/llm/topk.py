"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of vectors that lie near each other in the dimensions with most energy. Within a block
each dimension has a list of its vectors by falling component (read from its end for negative query weights). A search
reads lists deeper round by round, first those along which the bound falls most; vectors met for the first time are scored in full; and it ends for a
query as soon as the sum of its weights times the next list entries, the most that an unseen vector can score, is below
its kth best score. Equal scores are settled by vec_id, so a search goes on while the bound ties with the kth score.

Each query is first searched in its own block. The kth score found there is where the other blocks start from: a block
whose list heads can't reach it isn't read for that query, and a block that no query of a group can use isn't sent to
the group at all. Which blocks those are is found down a tree of boxes, the highest and lowest components of ``FAN`` blocks,
of ``FAN`` of these, and so on: a group meets the children only of nodes that it can use. Blocks' winners are merged per
query. Queries and candidates meet in (query group, block) cells of bounded size; neither side is broadcast.

How early a search stops depends on the vectors: where few dimensions hold most energy it reads a part of the lists;
where all components are alike and independent, as in random unit vectors, the bound falls so late that all of a block
is met first, and the search is then a full scan in blocks, exact all the same. No block can then be left out for a
group either, so with queries as a share of the rows the rows sent grow with the square of the table, divided by the
queries of a group: that is the price of comparing a share of all rows with all rows.

Defined results: vectors that are null or empty, or hold a null or non-finite component take no part. Vectors may be of
any lengths; a query's candidates are those of its own length. Scaled components beyond +-2^57 count as +-2^57; scores
are exact, and those beyond 64 bits count as +-(2^63 - 1), ties as always. Repeated rows count once: of rows with one
vec_id the smallest vector stands for all. Equal vectors under different ids are candidates of their own. A query with fewer candidates returns them all; without a candidate, none.
Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a block, blocks whose queries make a group, and children of a node of boxes.
BLOCK_ROWS, GROUP_BLOCKS, FAN = 8192, 5, 16
#: List entries read in the first round; each round reads this many times more than the one before.
FIRST_DEPTH, DEEPER = 4, 4
#: Dimensions by which vectors are dealt into blocks, and the width of a step in them.
LEADING, WIDTH = 4, 8
#: Largest component; components whose products doubles add up exactly; the highest score, and what stands for none.
LARGEST, SMALL, HIGHEST, NONE = 1 << 57, 1 << 23, (1 << 63) - 1, -(1 << 63)
#: What rounding may take from a bound, as a share of the sizes that it adds up.
_SLACK = 1e-12

_OUT = "query_id long, vec_id long, score long"
_BOX = "block int, n int, hi array<double>, lo array<double>"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v: array<bigint>) with floor(scale * x), of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select("vec_id", x.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter((F.size("embedding") > 0) & good)
    whole = lambda e: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), e * scale))).cast("bigint")
    rows = rows.select("vec_id", F.transform("embedding", whole).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exactly, those beyond 64 bits as the highest or lowest score."""
    most = lambda a: np.abs(a).max(axis=1, initial=0)
    q_most, x_most = most(q), most(x)
    if max(q_most.max(initial=0), x_most.max(initial=0)) <= SMALL and q.shape[1] <= 64:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    out = np.empty((len(q), len(x)), np.int64)
    for rows, some in ((np.flatnonzero(q_most <= SMALL), q), (np.flatnonzero(q_most > SMALL), q)):
        for columns in (np.flatnonzero(x_most <= SMALL), np.flatnonzero(x_most > SMALL)):
            if len(rows) and len(columns):
                top = int(q_most[rows].max()) * int(x_most[columns].max()) * q.shape[1]
                if top < 1 << 53:
                    part = (some[rows].astype(np.float64) @ x[columns].astype(np.float64).T).astype(np.int64)
                elif top <= HIGHEST:
                    part = some[rows] @ x[columns].T
                else:
                    part = np.clip(some[rows].astype(object) @ x[columns].astype(object).T, -HIGHEST, HIGHEST).astype(np.int64)
                out[np.ix_(rows, columns)] = part
    return out


def search(q: np.ndarray, own: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best candidates ``x`` of each query ``q``, NONE where there are fewer, and the scorings done.

    ``own``: the queries' ids, which aren't their candidates; ``floor``: scores below which nothing is asked for.
    """
    n = len(x)
    order = np.argsort(-x, axis=0, kind="stable")  # the lists by falling component; read from the end for negative weights
    falling = np.take_along_axis(x, order, axis=0).astype(np.float64)
    seen = np.zeros(n, bool)
    best_ids, best = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), NONE)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    exact = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= SMALL and q.shape[1] <= 64
    dims, last, scored = np.arange(x.shape[1]), min(k, n) - 1, 0
    read, active = np.zeros(len(dims), np.int64), np.arange(len(q))  # entries read of each list, from either end
    while not seen.all():
        # no unseen vector can score more than this
        high, low = falling[read, dims], falling[n - 1 - read, dims]
        bound = np.maximum(up[active] @ high + down[active] @ low, -float(HIGHEST))
        needed = np.maximum(best[active, last], floor[active]).astype(np.float64)
        if not exact:
            bound += _SLACK * (up[active] @ np.abs(high) - down[active] @ np.abs(low) + np.abs(needed))
        active = active[bound >= needed]
        if not len(active):
            break
        to = np.minimum(n - 1, np.maximum(FIRST_DEPTH, read * DEEPER))
        drop = up[active].sum(axis=0) * (high - falling[to, dims]) - down[active].sum(axis=0) * (falling[n - 1 - to, dims] - low)
        go = np.flatnonzero((drop >= drop.max() / 2) & (to > read))
        if not len(go):  # lists that have nothing below their heads
            met = np.flatnonzero(~seen)
        else:
            ends = [part for d in go.tolist() for part in (order[read[d] : to[d], d], order[n - to[d] : n - read[d], d])]
            met = np.unique(np.concatenate(ends))
            met = met[~seen[met]]
            read[go] = to[go]
        seen[met] = True
        scored += len(met) * len(active)
        for lo in range(0, len(active), 256):
            some = active[lo : lo + 256]
            scores = np.where(ids[met] == own[some, None], NONE, products(q[some], x[met]))
            best[some], best_ids[some] = _merged(best[some], best_ids[some], scores, ids[met], k)
    return best, best_ids, scored


def _cell(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query of one group that is at home elsewhere, or for its own."""
    if queries.empty or block.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    q, x = np.stack(queries["v"].to_list()).astype(np.int64), np.stack(block["v"].to_list()).astype(np.int64)
    own = queries["vec_id"].to_numpy(np.int64)
    floor = np.array([NONE if pd.isna(f) else int(f) for f in queries["least"].astype(object)], np.int64)
    best, best_ids, _ = search(q, own, floor, x, block["vec_id"].to_numpy(np.int64), k)
    row, col = np.nonzero(best > NONE)
    return pd.DataFrame({"query_id": own[row], "vec_id": best_ids[row, col], "score": best[row, col]})


def _merged(best: np.ndarray, best_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, by falling score, then rising id."""
    if not scores.shape[1]:
        return best, best_ids
    if scores.shape[1] > 4 * k:  # all that reach the kth score, ties included, then only those are sorted
        kth = np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, -k], best[:, -1])
        width = int((scores >= kth[:, None]).sum(axis=1).max())
        if width < scores.shape[1] // 2:
            out, out_ids = best.copy(), best_ids.copy()
            for i in range(len(scores)):
                at = np.flatnonzero(scores[i] >= kth[i])
                s, d = np.concatenate([best[i], scores[i, at]]), np.concatenate([best_ids[i], ids[at]])
                top = np.lexsort((d, ~s))[:k]  # ~ turns the order round
                out[i], out_ids[i] = s[top], d[top]
            return out, out_ids
    s = np.concatenate([best, scores], axis=1)
    d = np.concatenate([best_ids, np.broadcast_to(ids, scores.shape)], axis=1)
    top = np.lexsort((d, ~s), axis=1)[:, :k]
    return np.take_along_axis(s, top, 1), np.take_along_axis(d, top, 1)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, v) with n, the vector's length, and block: ranges over the dimensions with most energy, of about BLOCK_ROWS vectors each."""
    energy = rows.select(F.posexplode("v")).groupBy("pos").agg(F.sum(F.col("col").cast("double") ** 2).alias("e"))
    leading = [r.pos for r in energy.orderBy(F.desc("e"), "pos").limit(LEADING).collect()]
    key = [F.floor(F.get("v", F.lit(d)) / WIDTH) for d in leading]
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("n", F.size("v"))
    return stored(rows.repartitionByRange(blocks, "n", *key, "vec_id").withColumn("block", F.spark_partition_id()), "topk-blocks")


def _ends(part: pd.DataFrame, key: str) -> pd.DataFrame:
    """Highest and lowest components of vectors, or of boxes, of one length."""
    high = np.stack(part["v" if "v" in part else "hi"].to_list()).max(axis=0)
    low = np.stack(part["v" if "v" in part else "lo"].to_list()).min(axis=0)
    return pd.DataFrame({key: part[key].iloc[:1], "n": part["n"].iloc[:1], "hi": [high.astype(np.float64)], "lo": [low.astype(np.float64)]})


def _reach(query: tuple[str, str], node: tuple[str, str]) -> Column:
    """The most that a vector of one box can score with a query of another, and what rounding may have taken from it."""
    both = F.arrays_zip(*(F.col(c) for c in (*query, *node)))
    ends = lambda p: [p[a] * p[b] for a in query for b in node]
    total = lambda f: F.aggregate(F.transform(both, f), F.lit(0.0), lambda a, b: a + b)
    return total(lambda p: F.greatest(*ends(p))) + _SLACK * total(lambda p: F.greatest(*map(F.abs, ends(p))))


def usable(groups: DataFrame, boxes: DataFrame) -> DataFrame:
    """(grp, n, block) of blocks with a box (block, n, hi, lo) that a group (grp, n, qhi, qlo, floor) can use, found down a tree of boxes."""
    levels = [boxes]
    highest = boxes.agg(F.max("block")).first()[0] or 0
    while highest:
        up = levels[-1].withColumn("block", F.floor(F.col("block") / FAN).cast("int"))
        levels.append(stored(up.groupBy("block", "n").applyInPandas(lambda part: _ends(part, "block"), _BOX), "topk-tree"))
        highest //= FAN
    met = None
    for level in reversed(levels):
        nodes = level.withColumn("above", F.floor(F.col("block") / FAN).cast("int"))
        pairs = groups.join(nodes, "n") if met is None else met.join(nodes, ["above", "n"]).join(groups, ["grp", "n"])  # one node of a length at the top
        kept = pairs.filter(_reach(("qhi", "qlo"), ("hi", "lo")) >= F.col("floor")).select("grp", "n", "block")
        met = kept.withColumnRenamed("block", "above")
    return met.withColumnRenamed("above", "block")


def top_k(vectors: DataFrame, is_query: Column, k: int, dims: int | None = None, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query with all other rows of its length.

    With ``dims`` only vectors of that length take part.
    """
    vectors = vectors if dims is None else vectors.filter(F.size("embedding") == dims)
    rows = dealt(stored(quantised(vectors, scale), "topk-vectors"))
    asked = rows.filter(is_query).select(*(F.col(c).alias(c) for c in rows.columns))
    search_cell = lambda queries, block: _cell(queries, block, k)
    home = asked.withColumn("least", F.lit(None).cast("bigint")).groupBy("block", "n").cogroup(rows.groupBy("block", "n")).applyInPandas(search_cell, _OUT)
    home = stored(home, "topk-home")
    least = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    group = F.floor(F.col("block") / GROUP_BLOCKS).cast("int").alias("grp")
    asked = asked.join(least, "vec_id", "left").select("vec_id", "v", "n", "least", F.col("block").alias("home"), group)
    boxes = stored(rows.groupBy("block", "n").applyInPandas(lambda part: _ends(part, "block"), _BOX), "topk-boxes")
    groups = asked.groupBy("grp", "n").applyInPandas(lambda part: _ends(part, "grp"), _BOX.replace("block", "grp")).withColumnsRenamed({"hi": "qhi", "lo": "qlo"})
    floors = asked.groupBy("grp", "n").agg(F.min(F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))).alias("floor"))
    cells = stored(usable(stored(groups.join(floors, ["grp", "n"]), "topk-groups"), boxes), "topk-cells")
    sent = asked.join(cells, ["grp", "n"]).filter("block <> home")
    offered = rows.join(cells, ["block", "n"]).select("vec_id", "v", "n", "grp", "block")
    away = sent.groupBy("grp", "block", "n").cogroup(offered.groupBy("grp", "block", "n")).applyInPandas(search_cell, _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    won = home.unionByName(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return won.select("query_id", "rank", "vec_id", "score")
