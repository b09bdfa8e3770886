"""Near-duplicates by SimHash, linked with a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased words, shingles of consecutive words, XXH64 of each; a bit of the fingerprint is 1 if it
is set in over half of the hashes. Two documents link if their fingerprints differ in at most ``most`` bits.

Links are found among distinct fingerprints through a hierarchical index over their Gray order. Sorted by Gray rank,
neighbours differ in few bits. An upper node holds the bit pattern that all below it share and the mask of those bits;
two nodes differ at least in the bits of both masks where their patterns disagree, and a pair of nodes that already
differs in more than ``most`` bits is pruned with all below it. The lowest distributed nodes are blocks of up to
``block_rows`` values, cut from range partitions; pairs of blocks come from joins of node pairs, level by level from the
root, and the values of a surviving pair are compared by the same descent within one task.

Of two fingerprints within 3 bits one of four quarters is equal. So each is entered in four Gray orders, rotated so that
each quarter leads once, and node pairs may not differ in the leading quarter. That keeps the number of block pairs in
proportion to the blocks; in one order alone it would grow with a power of the logarithm of their number. Blocks are
cut by rows, so no node grows with the data, whatever the fingerprints have in common, and none is capped. A pair of
blocks returns a link from each fingerprint to the smallest of its group there, never all pairs.

Components come from alternating large-star and small-star rounds on those links, each round written to the shared
folder.

Defined results: a null text is empty; a text without words has fingerprint zero, with fewer words than a shingle the
hash of them all. Documents with equal fingerprints are one group however many there are. A component is named by its
smallest doc_id; documents without doc_id take part and don't name it unless they are alone (null). Repeated rows are
returned as often as they come. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, fresh, pieces, stored

WORDS, SEED, MOST = 3, 42, 3
#: Gray orders, one for each quarter that leads; values of a block; fan-out of the index's nodes; node pairs of a front.
ORDERS, BLOCK_ROWS, FAN_BITS, FRONT = 4, 16384, 3, 1 << 15
FAN = 1 << FAN_BITS
#: Sets of a hot key, about, with which its others are compared first.
LEADS = 8
#: The leading quarter's bits.
LEADING = np.uint64(0xFFFF << 48)

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    found = text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    n = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.fromiter(map(_hash, shingles), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):  # memory stays bounded for a very long text
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    out = np.packbits((2 * counts > len(hashes)).astype(np.uint8))
    return int.from_bytes(out.tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values = [fingerprint(shingle_hashes(t, words)) for t in byte_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), batch.column(2)], names=["doc_id", "fp", "mark"])


def fingerprints(docs: DataFrame, words: int = WORDS, marked: bool = False) -> DataFrame:
    """(doc_id, fp: the 64 bits as a long) of each document, and if ``marked`` its text's hash."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    out = rows.mapInArrow(lambda batches: _fingerprints(batches, words), "doc_id long, fp long, mark long")
    return out if marked else out.drop("mark")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray code: neighbours in this order differ in few bits."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _levels(x: np.ndarray, fan: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask of shared bits, their pattern) of the nodes, from the leaves, which are the values, up to one root."""
    low, high = x, x
    out = [(np.full(len(x), 0xFFFFFFFFFFFFFFFF, np.uint64), x)]
    while len(low) > 1:
        at = np.arange(0, len(low), fan)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
        out.append((~(low ^ high), low))
    return out


def near_pairs(x: np.ndarray, y: np.ndarray | None = None, most: int = MOST, quarter: np.uint64 = np.uint64(0), fan: int = FAN) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j) of values of ``x`` and ``y``, each sorted by Gray rank, that differ in at most ``most`` bits.

    Without ``y`` the pairs are those of x, i < j. Bits of ``quarter`` must not differ. Node pairs are taken from the roots
    down; one whose shared bits differ too much already is pruned with all below it. The third result counts the pairs
    of nodes and values that were compared. Memory is bounded: a wide front of node pairs is cut into parts.
    """
    same = y is None
    left = _levels(x, fan)
    right = left if same else _levels(y, fan)
    while len(left) < len(right):
        left.append(left[-1])
    while len(right) < len(left):
        right.append(right[-1])
    step, compared, found = np.arange(fan), 0, [(np.empty(0, np.int64), np.empty(0, np.int64))]
    todo = [(len(left) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(x) and (same or len(y)) else []
    while todo:
        level, a, b = todo.pop()
        if len(a) > FRONT:
            todo += [(level, a[i : i + FRONT], b[i : i + FRONT]) for i in range(0, len(a), FRONT)]
            continue
        (am, ap), (bm, bp) = left[level], right[level]
        compared += len(a)
        shared = (ap[a] ^ bp[b]) & am[a] & bm[b]
        keep = (np.bitwise_count(shared) <= most) & (shared & quarter == 0)
        a, b = a[keep], b[keep]
        if not level:
            keep = a < b if same else slice(None)
            found.append((a[keep], b[keep]))
            continue
        (m, n), (up_a, up_b) = (len(left[level - 1][0]), len(right[level - 1][0])), (left[level - 1] is left[level], right[level - 1] is right[level])
        ca = a[:, None] if up_a else a[:, None] * fan + step
        cb = b[:, None] if up_b else b[:, None] * fan + step
        i, j = np.broadcast_arrays(ca[:, :, None], cb[:, None, :])
        i, j = i.ravel(), j.ravel()
        keep = (i < m) & (j < n)
        if same:
            keep &= i <= j
        if keep.any():
            todo.append((level - 1, i[keep], j[keep]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), compared


def _smallest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the smallest index of each item's component, after joining the pairs."""
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while True:
            nxt = new[new]
            if (nxt == new).all():
                break
            new = nxt
        if (new == label).all():
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def runs(batches: Iterator[pa.RecordBatch], keys: int, columns: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal first ``keys`` columns; a run may go on from one batch to the next."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        new = np.concatenate([[True], np.any([rows[k][1:] != rows[k][:-1] for k in range(keys)], axis=0)])
        if held:
            new[0] = any(rows[k][0] != held[0][k][0] for k in range(keys))
        cuts = np.flatnonzero(new).tolist()
        if not cuts:
            held.append(rows)
            continue
        if held:
            yield [np.concatenate([h[i] for h in held] + [rows[i][: cuts[0]]]) for i in range(columns)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield [c[i:j] for c in rows]
        held = [[c[cuts[-1] :] for c in rows]]
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(columns)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    """Values rotated to the right."""
    return x if not bits else (x >> np.uint64(bits)) | (x << np.uint64(64 - bits))


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (node, smallest node of its group there) from (a, b, side, q, y), run by run of one block pair (a, b)."""
    for _, _, side, q, y in runs(batches, 2, 5):
        y = y.view(np.uint64)
        for turn in np.unique(q).tolist():
            x = [y[(q == turn) & (side == k)] for k in (0, 1)]
            x = [v[np.argsort(gray_rank(v), kind="stable")] for v in x]
            across = bool((side == 1).any())
            if across and not (len(x[0]) and len(x[1])):
                continue
            i, j, _ = near_pairs(x[0], x[1] if across else None, most, LEADING)
            if not len(i):
                continue
            node = _turned(np.concatenate(x), 64 // ORDERS * turn).view(np.int64)
            label = _smallest(np.arange(len(node)), i, j + len(x[0]) if across else j)
            low = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(low, label, node)
            moved = low[label] != node
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(low[label][moved])], names=["a", "b"])


def _shifted(kind: str, x: Column, bits: Column | int) -> Column:
    return F.call_function(kind, x, F.lit(bits) if isinstance(bits, int) else bits)


def _rank(x: Column) -> Column:
    """Gray rank of a long's 64 bits, as a long that sorts like the unsigned rank."""
    for bits in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(_shifted("shiftrightunsigned", x, bits))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def blocks(values: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, q, y): every value of ``values`` (fp) in each of the Gray orders, cut into blocks of up to ``block_rows``.

    Order q is that of the values rotated by q quarters. Range partitioning by Gray rank deals them evenly, however alike
    they are; block numbers follow the order.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = values.select("fp", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("q"))
    turn = F.col("q") * (64 // ORDERS)
    rows = rows.select("q", _shifted("shiftleft", F.col("fp"), turn).bitwiseOR(_shifted("shiftrightunsigned", F.col("fp"), 64 - turn)).alias("y"))
    rows = rows.withColumn("rank", _rank(F.col("y"))).repartitionByRange(n, "q", "rank").sortWithinPartitions("q", "rank")
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's number in it
    part, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    return stored(rows.select(F.shiftleft(part, 33).bitwiseOR(F.floor(row / block_rows)).alias("block"), "q", "y"), "simhash-blocks")


def block_pairs(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that can hold values within ``most`` bits of each other.

    Blocks are nodes with the bits that all their values share and a mask of these bits; FAN neighbours make a node of
    the next level. From the root down, the children of each pair of nodes are joined, and pairs whose shared bits
    differ in more than ``most`` places, or in their leading quarter, are dropped with all below them.
    """
    leaves = rows.groupBy("block").agg(F.bit_and("y").alias("lo"), F.bit_or("y").alias("hi"), F.min("q").alias("q0"), F.max("q").alias("q1"))
    leaves = stored(leaves, "simhash-nodes")
    part, row = F.shiftright("block", 33), F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    top = leaves.agg(F.max(part).alias("part"), F.max(row).alias("row")).first()
    spark = rows.sparkSession
    if top["part"] is None:
        return spark.createDataFrame([], "a long, b long")
    width = int(top["row"]).bit_length()
    leaves = leaves.withColumn("code", F.shiftleft(part, width).bitwiseOR(row))
    levels = -(-max(1, (int(top["part"]) << width | int(top["row"])).bit_length()) // FAN_BITS)
    pairs = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in range(levels - 1, -1, -1):
        nodes = leaves.groupBy(F.shiftright("code", FAN_BITS * level).alias("code"))
        nodes = nodes.agg(F.bit_and("lo").alias("lo"), F.bit_or("hi").alias("hi"), F.min("q0").alias("q0"), F.max("q1").alias("q1"), F.min("block").alias("block"))
        nodes = nodes.withColumn("mask", F.bitwise_not(F.col("lo").bitwiseXOR(F.col("hi"))))
        left, right = (nodes.select(*(F.col(c).alias(f"{side}_{c}") for c in nodes.columns)) for side in "ab")
        both = pairs.join(left, F.col("a") == F.shiftright("a_code", FAN_BITS)).join(right, F.col("b") == F.shiftright("b_code", FAN_BITS))
        shared = F.col("a_lo").bitwiseXOR(F.col("b_lo")).bitwiseAND(F.col("a_mask")).bitwiseAND(F.col("b_mask"))
        leading = shared.bitwiseAND(F.lit(int(LEADING) - (1 << 64)))
        near = (F.bit_count(shared) <= most) & (leading == 0) & (F.col("a_q1") >= F.col("b_q0")) & (F.col("a_code") <= F.col("b_code"))
        number = "block" if level == 0 else "code"
        pairs = both.filter(near | (F.col("a_code") == F.col("b_code"))).select(F.col(f"a_{number}").alias("a"), F.col(f"b_{number}").alias("b"))
    return stored(pairs, "simhash-block-pairs")


def links(values: DataFrame, most: int = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links between the distinct longs ``fp`` whose components are those of all pairs within ``most`` bits."""
    if most >= ORDERS:
        raise ValueError("four orders find pairs that differ in at most 3 bits")
    rows = blocks(values, block_rows)
    pairs = block_pairs(rows, most)
    first = pairs.join(rows, F.col("a") == F.col("block")).select("a", "b", F.lit(0).alias("side"), "q", "y")
    second = pairs.filter("a < b").join(rows, F.col("b") == F.col("block")).select("a", "b", F.lit(1).alias("side"), "q", "y")
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = first.unionByName(second).repartition(n, "a", "b").sortWithinPartitions("a", "b")
    return both.mapInArrow(lambda b: _links(b, most), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each linked node and the smallest node of its component, from links (a, b).

    Large-star links a node's larger neighbours to its smallest one, small-star the node and its smaller neighbours;
    each round is written out, until a round changes nothing. Hot nodes are pre-aggregated, and only equal keys are joined.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written out, so that both sides of the join are shuffled for it and hot nodes can be split
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links-low")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "links-large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "links-low")
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(low.select("a", F.col("m").alias("b")).unionByName(small).filter("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == now[1] and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        before = now
    return edges


def grouped(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root, component_id) of each of the stored ``nodes`` (node, first: its smallest doc_id); root is a node."""
    roots = components(edges).select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = stored(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "simhash-roots")
    names = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-names")
    return stored(named.join(names, "root").select("node", "root", "component_id"), "simhash-groups")


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = stored(fingerprints(docs, words), "simhash-prints")
    nodes = stored(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("first")), "simhash-distinct")
    groups = grouped(links(nodes.select(F.col("node").alias("fp")), most, block_rows), nodes).withColumnRenamed("node", "fp")
    # groups have a row per fingerprint; adaptive execution splits the documents of one that very many share
    out = prints.join(groups, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _salts(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, the second ones odd, that turn a hash into ``rows`` for each of ``bands``."""
    x = np.arange(1, 2 * rows * bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x[: rows * bands], x[rows * bands :] | np.uint64(1)


def band_keys(shingles: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """``bands`` keys of a set of shingles, each of ``rows`` min-hashes; sets agree on a key with their similarity to the power of ``rows``."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    flip, odd = _salts(rows, bands)
    low = np.full(rows * bands, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for lo in range(0, len(shingles), 1 << 12):  # memory stays bounded for a very long text
        np.minimum(low, ((shingles[lo : lo + (1 << 12), None] ^ flip) * odd).min(axis=0), out=low)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        key = (key ^ column) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key


def _banded(batches: Iterator[pa.RecordBatch], words: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, row, node, size, keys, fp): the hash, size and band keys of the set of a text's shingles, and its fingerprint."""
    for batch in pieces(batches):
        texts = list(byte_texts(batch.column(1)))
        fp = pa.array(np.array([fingerprint(shingle_hashes(t)) for t in texts], np.uint64).view(np.int64))
        sets = [np.unique(shingle_hashes(t, words)) for t in texts]
        node = pa.array(np.array([_hash(x.tobytes()) for x in sets], np.uint64).view(np.int64))
        keys = pa.array([band_keys(x, rows, bands).view(np.int64) for x in sets], pa.list_(pa.int64()))
        arrays = [batch.column(0), batch.column(2), batch.column(3), node, pa.array([len(x) for x in sets], pa.int64()), keys, fp]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "row", "node", "size", "keys", "fp"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of rows (row, text)."""
    for batch in pieces(batches):
        sets = [np.unique(shingle_hashes(t, words)) for t in byte_texts(batch.column(1))]
        node = pa.array(np.array([_hash(x.tobytes()) for x in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([node, pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])


def shared_counts(of: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of ``n`` sets have in common; ``shingles`` belong to the sets ``of``, each at most once."""
    _, column, count = np.unique(shingles, return_inverse=True, return_counts=True)
    several = count > 1
    keep = several[column]
    row, column = of[keep], (np.cumsum(several) - 1)[column[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(several.sum()), 4096):  # so many shingles at a time
        i, j = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        out += part @ part.T
    return out


def _similar(batches: Iterator[pa.RecordBatch], tenths: int) -> Iterator[pa.RecordBatch]:
    """Links (node, smallest node of its group there) of units, from (a, b, node, side, keys, shingles) sorted by unit.

    A unit's sets are compared if they share a key, or their sides are from 2 on, and, where it has two sides, lie on
    different ones. Rows of one node follow one another, its shingles dealt over them.
    """
    held: list[tuple] = []

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = sorted({r[1] for r in rows})
        if len(names) < 2:
            return
        place, n = {x: i for i, x in enumerate(names)}, len(names)
        of = np.concatenate([np.full(len(r[4]), place[r[1]]) for r in rows])
        size = np.bincount(of, minlength=n)
        side = np.zeros(n, np.int64)
        near, members = np.zeros((n, n), bool), {}
        for _, node, s, keys, _ in rows:
            side[place[node]] = s
            for k in () if keys is None else keys:
                members.setdefault(k, set()).add(place[node])
        if (side > 1).any():
            near[:] = True
        else:
            for group in members.values():
                if len(group) > 1:
                    near[np.ix_(list(group), list(group))] = True
        near &= 10 * np.minimum(size[:, None], size) >= tenths * np.maximum(size[:, None], size)
        if (side & 1).any():
            near &= side[:, None] != side
        near &= np.triu(np.ones((n, n), bool), 1)
        if not near.any():
            return
        shared = shared_counts(of, np.concatenate([r[4] for r in rows]), n)
        i, j = np.nonzero(near & ((10 + tenths) * shared >= tenths * (size[:, None] + size)))
        label = _smallest(np.arange(n), i, j)
        node = np.array(names, np.int64)
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, label, node)
        moved = low[label] != node
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(low[label][moved])], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        keys, sets = batch.column(4).to_pylist(), batch.column(5)
        for i, (a, b, node, side) in enumerate(zip(*columns, strict=True)):
            if held and held[0][0] != (a, b):
                yield from found(held)
                held = []
            held.append(((a, b), node, side, keys[i], sets[i].values.to_numpy()))
    if held:
        yield from found(held)


def _home(members: DataFrame) -> DataFrame:
    """(node, home, m): the most frequent key of each set of ``members`` (key, n, node), at home to m sets."""
    home = members.groupBy("node").agg(F.max_by("key", F.struct("n", "key")).alias("home"))
    return stored(home.join(home.groupBy("home").agg(F.count("*").alias("m")), "home").select("node", "home", "m"), "near-homes")


def homes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, node) of keys that several sets share, and (node, home, m): its most frequent key, at home to m sets."""
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(rows.join(shared, "key"), "near-members")
    return members, _home(members)


def first_units(home: DataFrame, block: int) -> DataFrame:
    """(a, b, node, side): the sets at home in a key that has more than a block of them, each with about LEADS of these.

    Leads go to each part of their home, so the rows are m and LEADS * m / block.
    """
    hot = home.filter(F.col("m") > block).withColumn("parts", F.ceil(F.col("m") / block))
    lead = F.pmod(F.xxhash64("node", F.lit("lead")), F.ceil(F.col("m") / LEADS)) == 0
    others = hot.filter(~lead).select(F.col("home").alias("a"), F.pmod(F.xxhash64("node"), "parts").alias("b"), "node", F.lit(0).alias("side"))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    return others.unionByName(hot.filter(lead).select(F.col("home").alias("a"), part.alias("b"), "node", F.lit(1).alias("side")))


def units(members: DataFrame, home: DataFrame, roots: DataFrame | None, block: int) -> DataFrame:
    """(a, b, node, side): which sets are compared with which, so that any two that share a key meet or have one root.

    Homes are cut into blocks of about ``block`` sets. Unit (a, a) has a block's own sets, unit (a, b) those of two blocks
    with a key in common that have it. ``roots`` (a, b): components known so far. Where a block or more of all sets have one
    root, they lie in blocks of their own, whatever their homes, which don't meet themselves or others of that root.
    Sets of keys that more than a block of them share are sent by pairs of blocks: once to each, however many keys they share.
    """
    if roots is None:
        home = home.withColumn("label", F.lit(None).cast("bigint"))
    else:
        known = roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = known.unionByName(known.select(F.col("root").alias("node"), "root").distinct())
        home = home.join(known, "node", "left")
        home = stored(home.select("node", "home", "root"), "near-rooted")  # both sides shuffled, so that a large root is split
        large = stored(home.filter("root is not null").groupBy("root").agg(F.count("*").alias("g")).filter(F.col("g") >= block), "near-large")
        home = home.join(large, "root", "left").withColumn("label", F.when(F.col("g").isNotNull(), F.col("root")))
        home = home.withColumn("home", F.coalesce("label", "home"))
    home = stored(home.select("node", "home", "label"), "near-labels")
    sizes = home.groupBy(F.col("home").alias("of"), F.col("label").alias("as")).agg(F.count("*").alias("m"))
    home = home.join(sizes, (F.col("home") == F.col("of")) & F.col("label").eqNullSafe(F.col("as")))
    home = home.select("node", "label", F.xxhash64("home", "label", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / block))).alias("block"))
    members = stored(members.join(home, "node").select("key", "n", "node", "block", "label"), "near-blocks")
    met = members.select("key", "n", "block", "label").distinct()
    several = met.groupBy("key").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("key")
    met = stored(met.join(several, "key"), "near-met")
    other = met.select("key", F.col("block").alias("other"), F.col("label").alias("as"))
    apart, hot = (F.col("block") != F.col("other")) & F.coalesce(F.col("label") != F.col("as"), F.lit(True)), F.col("n") > block
    across = members.filter(~hot).join(other, "key").filter(apart).select("block", "other", "node")
    pairs = met.filter(hot).join(other, "key").filter(apart).select("block", "other").distinct()
    across = across.unionByName(members.filter(hot).select("block", "node").distinct().join(pairs, "block").select("block", "other", "node"))
    across = across.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", (F.col("block") > F.col("other")).cast("int").alias("side")).distinct()
    own = members.filter("label is null").select(F.col("block").alias("a"), F.col("block").alias("b"), "node", F.lit(0).alias("side"))
    return own.distinct().unionByName(across)


def print_homes(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(node, home, m): each set whose fingerprint ``fp`` the index links with others', its component of these, and how many sets that has.

    A set can have several fingerprints, and then is in the component of each.
    """
    prints = stored(prints.select("node", "fp").distinct(), "near-fingerprints")
    roots = components(links(prints.select("fp").distinct(), most)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rows = stored(prints.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("home")).distinct(), "near-rooted")
    sizes = stored(rows.groupBy("home").agg(F.count("*").alias("m")).filter("m > 1"), "near-sizes")
    return stored(rows.join(sizes, "home").select("node", "home", "m"), "near-print-homes")


def print_units(home: DataFrame, block: int) -> DataFrame:
    """(a, b, node, side): the sets of each component of fingerprints, all with each other up to a block, else with leads; sides from 2 on.

    What the leads leave of a larger component meets the rest of it through its key (``print_keys``).
    """
    small = home.filter(F.col("m") <= block).select(F.col("home").alias("a"), F.lit(-1).cast("bigint").alias("b"), "node", F.lit(2).alias("side"))
    return small.unionByName(first_units(home, block).withColumn("side", F.col("side") + 2))


def print_keys(home: DataFrame, block: int) -> DataFrame:
    """(key, n, node): components of fingerprints that have more than a block of sets, as a key that these share."""
    return home.filter(F.col("m") > block).select(F.xxhash64("home", F.lit("print")).alias("key"), F.col("m").alias("n"), "node")


def similar_links(texts: DataFrame, nodes: DataFrame, tenths: int, block: int = 512, words: int = 5, chunk: int = 1024, prints: DataFrame | None = None) -> DataFrame:
    """(a, b): links whose components are those of all pairs that share a band key and are similar enough.

    ``texts``: (row, text); ``nodes``: (node, row, keys, size), row being that of one of its texts. Only texts of nodes
    that share a key are read for their sets, and a set goes to each of its units once, however many keys it shares
    there; long sets in rows of ``chunk`` shingles. Where more than a block of sets are at home in a key, they are compared
    with a few of them first; those that these connect needn't meet again, so the rows of a group of copies grow with the
    group. Sets that share a key and stay unlike the few meet all others of the key in blocks. ``prints`` (node, fp): what the index
    of fingerprints puts together is compared before that, whether it shares a band key or not: a component of up to a block
    at once, a larger one with a few of its sets and then as a key that its sets share, so no two of it are left out.
    """
    members, home = homes(nodes)
    asked, near, keyed = members.select("node"), None, nodes.select("node", "keys")
    again, at_home = members, home
    if prints is not None:
        near = print_homes(prints)
        asked = asked.unionByName(near.select("node"))
        if not (large := print_keys(near, block)).isEmpty():
            again = members.unionByName(large)
            at_home = _home(again)
            own = large.groupBy("node").agg(F.collect_set("key").alias("own"))
            keyed = keyed.join(own, "node", "left").select("node", F.concat("keys", F.coalesce("own", F.array().cast("array<bigint>"))).alias("keys"))
    asked = nodes.join(asked.distinct(), "node", "left_semi").select("row")
    sets = texts.join(asked, "row", "left_semi").dropDuplicates(["row"]).select("row", "text")
    sets = stored(sets.mapInArrow(lambda b: _sets(b, words), "node long, shingles array<long>"), "near-sets")
    sets = sets.join(keyed, "node")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("shingles")), F.lit(chunk)))
    sets = sets.select("node", "keys", "shingles", start.alias("s"))
    sets = sets.select("node", F.when(F.col("s") == 1, F.col("keys")).alias("keys"), F.slice("shingles", F.col("s"), F.lit(chunk)).alias("shingles"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(where: DataFrame) -> DataFrame:
        rows = where.join(sets, "node").select("a", "b", "node", "side", "keys", "shingles").repartition(n, "a", "b").sortWithinPartitions("a", "b", "node")
        return rows.mapInArrow(lambda b: _similar(b, tenths), "a long, b long")

    where = None if near is None else print_units(near, block)
    if not home.filter(F.col("m") > block).isEmpty():
        led = first_units(home, block)
        where = led if where is None else where.unionByName(led)
    if where is None:
        return compared(stored(units(again, at_home, None, block), "near-units"))
    first = stored(compared(stored(where, "near-first")), "near-led")
    return first.unionByName(compared(stored(units(again, at_home, components(first), block), "near-units")))


def one_of_each(docs: DataFrame, words: int = 5, tenths: int = 8, rows: int = 5, bands: int = 20) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest doc_id stays, once.

    Documents link if the Jaccard similarity of their sets of ``words``-word shingles is at least ``tenths`` tenths, which is
    counted. Pairs are found through SimHash fingerprints that the Gray-order index links, first, all of each component; as
    these are near at a far higher similarity only, also by ``bands`` keys of ``rows`` min-hashes, of which two at 0.8 share one but for one
    pair in 2,800, and fewer are missed above it. Texts without words are alike. Of rows with the smallest
    doc_id and different texts the one whose text has the smallest hash stays.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "mark"))
    schema = "doc_id long, mark long, row long, node long, size long, keys array<long>, fp long"
    prints = stored(texts.mapInArrow(lambda b: _banded(b, words, rows, bands), schema), "near-prints")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.min("keys").alias("keys"), F.min("size").alias("size"))
    nodes = stored(nodes, "near-nodes")
    found = similar_links(texts.select("row", "text"), nodes, tenths, words=words, prints=prints.select("node", "fp"))
    groups = grouped(found, nodes.select("node", "first"))
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")
    keep = prints.select("doc_id", "mark", "node").join(groups, "node").groupBy("root").agg(F.min(key).alias("k"))
    kept_id, kept_mark = (fresh(n, docs.columns) for n in ("kept_id", "kept_mark"))
    keep = stored(keep.select(F.col("k.doc_id").alias(kept_id), F.col("k.mark").alias(kept_mark)), "simhash-kept")
    repeated = prints.groupBy(F.col("doc_id").alias(kept_id), F.col("mark").alias(kept_mark)).count().filter("count > 1").select(kept_id, kept_mark)
    again = stored(repeated.intersect(keep), "simhash-again")
    here = F.col("doc_id").eqNullSafe(F.col(kept_id)) & F.xxhash64("text").eqNullSafe(F.col(kept_mark))
    out = docs.join(keep, here, "left_semi")
    if again.isEmpty():
        return out
    return out.join(again, here, "left_anti").unionByName(out.join(again, here, "left_semi").dropDuplicates(["doc_id", "text"]))
