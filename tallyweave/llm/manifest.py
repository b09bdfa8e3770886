"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups, and proofs.

Where a row stands in its group follows from bitmaps, without sorting the rows. A word of 64 bits has the ids of a group
that agree in all but their last six bits; words without ids aren't stored, which compresses the bitmap, and those of all
tasks are merged by OR. The directory has the popcount of each word, added up over a tree of at most 4,096 entries a
node, so however the ids lie no task gets more than that of it. A row's rank is what its word's ancestors have before
it, and the bits before its own.

Levels are then reduced by slots: blocks of 1,024 neighbours are keyed by group and rank, each row takes the slot of its
rank, and a task folds a block's ten levels at once, giving every slot its siblings. The roots of blocks are the nodes of
the next round, so a group of n rows takes log(n) / 10 rounds, and a group may be of any size.

A leaf is the hash of the row's columns, null as "-", else the UTF-8 byte count, ":" and the value. Every two consecutive
nodes, the last one alone if their number is odd, become the hash of their digests, until one is left. Hashes are SHA-256,
written as lower-case hex, and it is that text which is hashed again.

Defined results: rows without an id count as having the smallest. Rows of a group with equal ids stand in the order of
their leaves' first 60 bits, and rows alike in these too in any order; each has a place and a proof of its own. Null is a
group of its own and the first. A group of one row has its leaf as its root. An empty table gives no rows. Rows with
repeated ids take bitmaps of their own, so one id may have a third of all rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Columns of a leaf, in order (fixed values).
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels of a block of slots, and bits of a step of the directory.
BITS, STEP = 10, 12
#: Groups up to which their roots are broadcast; beyond that they are joined.
BROADCAST_GROUPS = 50_000

_LEAST = -(1 << 63)


def written(value: Column) -> Column:
    """A value as a leaf has it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*values: Column) -> Column:
    return F.sha2(F.concat(*map(written, values)), 256)


def _grouped(c: Column) -> Column:
    """A group's key: never null, in the order of the groups."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def _directory(words: DataFrame, tag: str) -> DataFrame:
    """``words`` (grp, w, n, ...) with base, the rows of the group before the word's, and total, those of the group."""
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy("grp", *by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    up = F.shiftright("k", STEP)
    levels = [words.select("grp", F.col("w").alias("k"), "n")]
    for depth in range(4):
        level = levels[-1].groupBy("grp", up.alias("k")).agg(F.sum("n").alias("n"))
        levels.append(stored(level, f"{tag}-directory") if depth == 0 else level)
    top = levels.pop()
    base = top.select("grp", "k", before().alias("base"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    for level in reversed(levels):
        rows = level.select("grp", "k", up.alias("up"), before(up).alias("own"))
        above = base.select("grp", F.col("k").alias("up"), "base", "total")
        base = rows.join(above, ["grp", "up"]).select("grp", "k", (F.col("own") + F.col("base")).alias("base"), "total")
    return words.join(base.withColumnRenamed("k", "w"), ["grp", "w"])


def ranked(rows: DataFrame, keys: list[str], tag: str = "manifest") -> DataFrame:
    """``rows`` (grp, keys, ...) with rank, from 0 in each group by ``keys`` (bigint), and total, the group's rows.

    Rows that agree in a key are ranked by the next one, within a group of their own; the last key tells all apart.
    """
    key = F.col(keys[0])
    rows = rows.withColumns({"w": F.shiftright(key, 6), "low": key.bitwiseAND(F.lit(63)).cast("int")})
    merged = rows.groupBy("grp", "w").agg(F.bit_or(F.expr("shiftleft(1L, low)")).alias("bits"), F.count("*").alias("n"))
    merged = stored(merged, f"{tag}-bitmap")
    repeated = not merged.filter(F.col("n") > F.bit_count("bits")).isEmpty()
    none = F.lit(None).cast("array<struct<low:int,more:bigint>>")
    words = _directory(merged, tag).withColumn("again", none)
    if repeated:
        again = rows.groupBy("grp", "w", "low").agg((F.count("*") - 1).alias("more")).filter("more > 0")
        again = again.groupBy("grp", "w").agg(F.collect_list(F.struct("low", "more")).alias("again"))  # 64 at the most
        words = words.drop("again").join(again, ["grp", "w"], "left")
    words = stored(words.select("grp", "w", "bits", "base", "total", "again"), f"{tag}-words")
    out = rows.join(words, ["grp", "w"])
    bits = F.bit_count(F.expr("bits & ~shiftleft(-1L, low)")).cast("bigint")
    more = F.coalesce(F.expr("aggregate(filter(again, a -> a.low < low), 0L, (s, a) -> s + a.more)"), F.lit(0))
    out = out.withColumn("rank", F.col("base") + bits + more)
    if not repeated:
        return out.drop("w", "low", "bits", "base", "again")
    tied = F.coalesce(F.expr("exists(again, a -> a.low = low)"), F.lit(False))
    out = out.withColumn("tied", tied).drop("w", "low", "bits", "base", "again")
    alone = out.filter(~F.col("tied")).drop("tied")
    names, outer = {c: F.col(c) for c in alone.columns}, f"outer{len(keys)}"
    within = out.filter("tied").select(
        *(c.alias(n) for n, c in names.items() if n not in ("grp", "rank", "total")),
        F.struct("grp", "rank", "total").alias(outer), F.concat("grp", F.lit("/"), F.col(keys[0]).cast("string")).alias("grp"),
    )
    within = ranked(stored(within, f"{tag}-tied"), keys[1:], tag)
    place = {"grp": F.col(f"{outer}.grp"), "rank": F.col(f"{outer}.rank") + F.col("rank"), "total": F.col(f"{outer}.total")}
    return alone.unionByName(within.select(*(place.get(n, F.col(n)).alias(n) for n in alone.columns)))


def _parent(a: str, b: str = "") -> str:
    return hashlib.sha256((a + b).encode()).hexdigest()


def folded(digests: list[str], levels: int) -> tuple[list[list[bytes | None]], str]:
    """The siblings of each of a block's nodes, level by level, null where it has none; and the node that they become."""
    rows, siblings = digests, []
    for _ in range(levels):
        siblings.append([bytes.fromhex(rows[i ^ 1]) if i ^ 1 < len(rows) else None for i in range(len(rows))])
        rows = [_parent(*rows[i : i + 2]) for i in range(0, len(rows), 2)]
    return [[level[i >> k] for k, level in enumerate(siblings)] for i in range(len(digests))], rows[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, i, h, levels, ...) sorted by block, with path and, in a block's first slot, its root."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        digests, levels = table.column("h").to_pylist(), table.column("levels").to_pylist()
        paths: list[list[bytes | None]] = []
        roots: list[str | None] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own, root = folded(digests[a:b], min(BITS, levels[a]))
            paths += own
            roots += [root] + [None] * (b - a - 1)
        table = table.append_column("path", pa.array(paths, pa.list_(pa.binary()))).append_column("root", pa.array(roots, pa.string()))
        return table.combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        keys = list(zip(table.column("grp").to_pylist(), table.column("block").to_pylist(), strict=True))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
        if len(starts) > 1:
            yield done(table.slice(0, starts[-1]), starts)
        held = table.slice(starts[-1]).to_batches()  # the last block may go on
    if held:
        table = pa.Table.from_batches(held)
        yield done(table, [0, table.num_rows])


def tree(nodes: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """Each round's nodes (grp, i, levels, path, ...) of ``nodes`` (grp, i, h, total, ...), and the groups' roots (grp, root).

    The first round's keep the columns of ``nodes``.
    """
    n = F.col("total") - 1
    nodes = nodes.withColumn("levels", F.when(n > 0, F.length(F.bin(n))).otherwise(0)).drop("total")
    rounds, roots = [], None
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        rows = nodes.withColumn("block", F.shiftright("i", BITS)).repartition(parts, "grp", "block").sortWithinPartitions("grp", "block", "i")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows = stored(rows.mapInArrow(_blocks, f"{fields}, path array<binary>, root string"), f"{tag}-blocks")
        rounds.append(rows)
        ended = rows.filter(f"root is not null and levels <= {BITS}").select("grp", "root")
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = rows.filter(f"root is not null and levels > {BITS}").select("grp", F.col("block").alias("i"), F.col("root").alias("h"), (F.col("levels") - BITS).alias("levels"))
        if nodes.isEmpty():
            return rounds, roots


def with_paths(rounds: list[DataFrame]) -> DataFrame:
    """The first round's nodes with the siblings of all rounds in path."""
    out = rounds[0].drop("block", "levels", "root")
    for k, more in enumerate(rounds[1:], 1):
        above = more.select("grp", F.col("i").alias("up"), F.col("path").alias("above"))
        out = out.withColumn("up", F.shiftright("i", BITS * k)).join(above, ["grp", "up"], "left")
        out = out.withColumn("path", F.concat("path", F.coalesce("above", F.array().cast("array<binary>")))).drop("up", "above")
    return out


def numbered(names: DataFrame, by: str) -> DataFrame:
    """``names`` with i, from 0 by the column ``by``: sorted in ranges, then numbered range by range."""
    one = stored(names.repartitionByRange(by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()), "manifest-names")
    one = one.withColumn("part", F.shiftright("at", 33))
    ends = one.groupBy("part").agg(F.count("*").alias("n"))
    ends = ends.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    return one.join(ends, "part").withColumn("i", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "n", "start")


def fold(leaf: Column, i: Column, path: Column) -> Column:
    """The root that a node at place ``i`` gives with its siblings."""
    empty = F.struct(leaf.alias("h"), i.cast("bigint").alias("i"))

    def up(s: Column, p: Column) -> Column:
        other = F.lower(F.hex(p))
        pair = F.when(p.isNull(), s["h"]).when(s["i"] % 2 == 1, F.concat(other, s["h"])).otherwise(F.concat(s["h"], other))
        return F.struct(F.sha2(pair, 256).alias("h"), F.shiftright(s["i"], 1).alias("i"))

    return F.aggregate(path, empty, up)["h"]


@dataclass(frozen=True)
class Manifest:
    """rows: (doc_id, leaf, ..., grp, i, path); groups: (grp, subroot, g, top): place and siblings; root: null without rows."""

    rows: DataFrame
    groups: DataFrame
    root: str | None


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", columns: list[str] = COLUMNS, **more: Column) -> Manifest:
    """The trees of ``docs``; ``more``: further columns to keep with each row."""
    leaf = hashed(*map(F.col, columns))
    rows = docs.select(F.col(key), _grouped(F.col(group)).alias("grp"), F.coalesce(F.col(key).cast("bigint"), F.lit(_LEAST)).alias("key"), leaf.alias("leaf"), *(c.alias(n) for n, c in more.items()))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    rows = rows.withColumn("mark", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("bigint"))
    placed = ranked(rows, ["key", "mark", "row"]).drop("key", "mark", "row")
    rounds, roots = tree(placed.withColumnRenamed("rank", "i").withColumn("h", F.col("leaf")), "manifest")
    names = stored(numbered(roots, "grp"), "manifest-groups")
    n = names.count()
    tops, whole = tree(names.select(F.lit("").alias("grp"), "i", F.col("root").alias("h"), F.lit(n).cast("bigint").alias("total"), F.col("grp").alias("name"), F.col("root").alias("subroot")), "manifest-top")
    groups = with_paths(tops).select(F.col("name").alias("grp"), "subroot", F.col("i").alias("g"), F.col("path").alias("top"))
    root = whole.first()
    return Manifest(with_paths(rounds).drop("h"), F.broadcast(groups) if n <= BROADCAST_GROUPS else groups, root.root if root else None)


def audited(docs: DataFrame, tampered: Column, changes: dict[str, Column]) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, and whether it still holds.

    Where ``tampered`` is true the row is hashed again with ``changes`` (column: value) before its proof is folded.
    """
    again = hashed(*(changes.get(c, F.col(c)) for c in COLUMNS))
    m = manifest(docs, now=F.when(tampered, again))
    rows = m.rows.join(m.groups, "grp")
    siblings = F.filter(F.concat("path", "top"), lambda p: p.isNotNull())
    proof = F.sha2(F.array_join(F.transform(siblings, lambda p: F.lower(F.hex(p))), ""), 256)
    reached = fold(fold(F.coalesce("now", "leaf"), F.col("i"), F.col("path")), F.col("g"), F.col("top"))
    root = F.lit(m.root).cast("string")
    out = rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), reached.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
