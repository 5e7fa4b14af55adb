"""SimHash near-dedup with vantage-point trees.

A document's fingerprint has 256 bits: every distinct lower-cased word votes on each bit by its
hash. Two documents are near duplicates if their fingerprints differ in at most RADIUS of the first 128 bits and 2 RADIUS
of all (the second half keeps chance likenesses of short texts out). Of equal fingerprints one point, with their number for
its weight, stands for all in the search. The search is exact: every pair of points that fits is found, and counted where it
is found; what a task returns is a row for each point with partners (their weight, and the group that the task saw it in),
so results grow with the documents, not with the pairs.

A vantage-point tree splits points by their Hamming distance to a vantage point, at a distance that leaves few points near the boundary. A query
of some radius is kept out of a child where the triangle inequality bounds rule it out, else it
visits both. The top of the tree, built on the driver from a bounded sample that steers balance
only, deals points to shards: each point has a home, and visits the shards of higher number that
its ball overlaps. Big shards are cut into cells of blocks against blocks, one task each; a task builds
the tree below for its block and sends its queries down it.

At a radius this wide against the spread of distances (about 64 +- 6 bits between unrelated texts)
bounds seldom prune, so time grows with the square of the number of distinct fingerprints; see the README for figures.

Defined cases. A null text, or one without words (empty, white space, punctuation), has no fingerprint: it is a class of its own, without links, and
always stays. Texts of any length are taken whole. Ids may be of any type that has an order; ids are compared as they are. Null ids:
such rows count like others, and come last among their class. Repeated rows
are duplicates of each other: in near_classes each is listed and counts as a link; in without_near_duplicates one stays, and of
rows alike in id and text that with the least hash of the other columns (rows alike in all: any). Ties: a class is named by its least id.
An empty table gives an empty result. Columns of any name are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import col, fresh, read, rest_hash, ship, small, stored
from .components import Links, classes

RADIUS = 24
BITS = 256
_SALTS = np.array([0, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]  # the bits of a byte, a byte each
#: Points of a block: so many that a point goes to COPIES cells, but within these bounds.
CELL = (1 << 15, 1 << 20)
COPIES = 16
STRETCH = 1 << 14
SAMPLE = 20_000
BROADCAST_BYTES = 32 << 20


_F = tuple(f"f{k}" for k in range(BITS // 64))


# Fingerprints -----------------------------------------------------------------------------------


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four words of 64 bits for each text, and its number of distinct words (0: no fingerprint)."""
    out, size = np.zeros((len(texts), BITS // 64), np.uint64), np.zeros(len(texts), np.int64)
    texts = pc.utf8_lower(texts)
    for i, j in textops.slices(texts, 1 << 18):
        buf, offsets = textops.raw(texts.slice(i, j - i))
        starts, ends, first = textops.words(buf, offsets, punctuation=False)
        if not len(starts):
            continue
        h = textops.hashes(buf, starts, ends)
        row = np.repeat(np.arange(j - i), np.diff(first))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        n = np.bincount(row, minlength=j - i)
        have = np.flatnonzero(n)
        doc = np.repeat(np.arange(len(have)), n[have])
        begin = np.repeat(np.cumsum(n[have]) - n[have], n[have])
        ones = np.zeros((len(have), BITS), np.int64)
        block = 1 << 14  # words whose bits are spread at once
        for a in range(0, len(h), block):
            d = doc[a : a + block]
            k = (np.arange(a, a + len(d)) - begin[a : a + len(d)]) // 255  # a lane of eight bits holds as many
            at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
            lanes = _LANES[textops.mix(h[a : a + len(d), None] ^ _SALTS).view(np.uint8)]
            np.add.at(ones, d[at], np.add.reduceat(lanes, at, axis=0).view(np.uint8))
        packed = np.packbits(2 * ones > n[have, None], axis=1, bitorder="little").view(np.uint64)
        out[i + have], size[i + have] = packed, n[have]
    return out, size


def _fingerprint(texts: pa.Array) -> pa.Array:
    f, n = fingerprints(texts)
    f = f.view(np.int64)
    return pa.StructArray.from_arrays([*(pa.array(f[:, k]) for k in range(BITS // 64)), pa.array(n, pa.int64())], [*_F, "n"])


def fingerprint(text: Column) -> Column:
    return F.arrow_udf(_fingerprint, ", ".join(f"{c} long" for c in _F) + ", n long")(text)


# The tree ---------------------------------------------------------------------------------------


@dataclass
class Node:
    """A leaf with its number and points, or a split at mid by Hamming distance to vantage."""

    leaf: int = -1
    points: np.ndarray | None = None
    vantage: np.ndarray | None = None
    mid: float = 0.0
    low: Node | None = None
    high: Node | None = None


def hamming(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Over the first half."""
    x = f[:, :2] ^ g[:2]
    return np.bitwise_count(x[:, 0]).astype(np.int16) + np.bitwise_count(x[:, 1])


def build(f: np.ndarray, leaf: int, radius: int = RADIUS, most: float = 0.9, seed: int = 5) -> tuple[Node, int]:
    """The tree over fingerprints, and its number of leaves. A node whose best split leaves more than the share `most` near the boundary is a leaf."""
    rng = np.random.default_rng(seed)
    count = 0

    def grow(idx: np.ndarray) -> Node:
        nonlocal count
        if len(idx) > leaf:
            best, some = None, f[idx if len(idx) <= 2000 else rng.choice(idx, 2000, replace=False)]
            for vantage in f[rng.choice(idx, 6, replace=False)] if len(idx) >= 6 else f[idx]:
                d = hamming(some, vantage)
                for mid in np.unique(np.quantile(d, [0.1, 0.2, 0.35, 0.5, 0.65])) + 0.5:  # a low one may cut off a crowd about the vantage point
                    near, under = float((np.abs(d - mid) <= radius).mean()), float((d < mid).mean())
                    if 0.05 <= under <= 0.95 and (best is None or near < best[0]):
                        best = (near, vantage, float(mid))
            if best is not None and best[0] <= most:
                under = hamming(f[idx], best[1]) < best[2]
                if 0 < under.sum() < len(idx):
                    return Node(vantage=best[1], mid=best[2], low=grow(idx[under]), high=grow(idx[~under]))
        count += 1
        return Node(leaf=count - 1, points=idx)

    return grow(np.arange(len(f))), count


def visit(node: Node, f: np.ndarray, idx: np.ndarray, radius: int):
    """(leaf, queries that its region may answer), by triangle bounds."""
    if node.leaf >= 0:
        yield node, idx
        return
    d = hamming(f[idx], node.vantage)
    for child, take in ((node.low, d - radius < node.mid), (node.high, d + radius >= node.mid)):
        if take.any():
            yield from visit(child, f, idx[take], radius)


def homes(node: Node, f: np.ndarray, idx: np.ndarray, out: np.ndarray) -> None:
    if node.leaf >= 0:
        out[idx] = node.leaf
        return
    under = hamming(f[idx], node.vantage) < node.mid
    homes(node.low, f, idx[under], out)
    homes(node.high, f, idx[~under], out)


def search(queries: np.ndarray, points: np.ndarray | None = None, radius: int = RADIUS, leaf: int = STRETCH):
    """(query, points, distances over all bits) for every query that has points within both radii; without points, each pair of queries once."""
    own = points is None
    points = queries if own else points
    if not len(queries) or not len(points):
        return
    tree, _ = build(points, leaf, radius)
    x, d, e = np.empty(STRETCH, np.uint64), np.empty(STRETCH, np.uint8), np.empty(STRETCH, np.uint8)
    for node, q in visit(tree, queries, np.arange(len(queries)), radius):
        idx = np.sort(node.points)
        f0, f1 = points[idx, 0].copy(), points[idx, 1].copy()
        for at in range(0, len(idx), STRETCH):  # a stretch of points stays in the CPU's cache for all queries
            stop = min(len(idx), at + STRETCH)
            first = np.maximum(np.searchsorted(idx, q, "right"), at) if own else np.full(len(q), at)
            for k in np.flatnonzero(first < stop):
                a, i = int(first[k]), int(q[k])
                n = stop - a
                y, u, v = x[:n], d[:n], e[:n]
                np.bitwise_xor(f0[a:stop], queries[i, 0], out=y)
                np.bitwise_count(y, out=u)
                np.bitwise_xor(f1[a:stop], queries[i, 1], out=y)
                np.bitwise_count(y, out=v)
                np.add(u, v, out=u)
                if u.min() <= radius:
                    c = np.flatnonzero(u <= radius)
                    far = u[c].astype(np.int64) + np.bitwise_count(points[idx[a + c], 2:] ^ queries[i, 2:]).sum(1)
                    ok = far <= 2 * radius
                    if ok.any():
                        yield i, idx[a + c[ok]], far[ok]


# Distributed search -----------------------------------------------------------------------------


def _prints_of(t) -> np.ndarray:
    return np.stack([np.asarray(t[c]) for c in _F], 1).astype(np.int64).view(np.uint64)


def _routed(points: DataFrame, n: int, radius: int, shard_points: int) -> tuple[DataFrame, dict[tuple[int, bool], int]]:
    """node, f0 to f3, w, shard, home: a row for the home shard and each visit; and the rows of each."""
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64(*_F), *_F).limit(SAMPLE).select(*_F).toPandas()
    tree, _ = build(_prints_of(sample), max(64, int(len(sample) * shard_points / max(n, 1))), radius, most=0.5)
    sent = spark.sparkContext.broadcast(tree)

    def route(frames):
        for f in frames:
            if not len(f):
                continue
            p, home = _prints_of(f), np.zeros(len(f), np.int64)
            homes(sent.value, p, np.arange(len(f)), home)
            yield f.assign(shard=home.astype(np.int32), home=True)
            for node, q in visit(sent.value, p, np.arange(len(f)), radius):
                q = q[home[q] < node.leaf]
                if len(q):
                    yield f.iloc[q].assign(shard=np.int32(node.leaf), home=False)

    some = points.select("node", *_F, "w")
    out = stored(some.mapInPandas(route, "node long, " + ", ".join(f"{c} long" for c in _F) + ", w long, shard int, home boolean"), "vp-shards")
    return out, {(r[0], r[1]): r[2] for r in out.groupBy("shard", "home").count().collect()}


def near_points(points: DataFrame, radius: int = RADIUS, cell: int | None = None) -> DataFrame:
    """(a, b, n) of points (node, f0 to f3, w) that have others within both radii: b is in a's group, n the weight of the partners that a task saw."""
    spark, n = points.sparkSession, points.count()
    cell = cell or min(max(CELL[0], -(-n // COPIES)), CELL[1])
    routed, counts = _routed(points, n, radius, cell)
    shards, base = [], 0
    for s in sorted({s for s, _ in counts}):
        m, v = max(1, -(-counts.get((s, True), 0) // cell)), -(-counts.get((s, False), 0) // cell)
        shards.append((s, m, v, base))
        base += m * (m + 1) // 2 + v * m
    if not shards:
        return spark.createDataFrame([], "a long, b long, n long")
    home = F.col("home")
    r = routed.join(F.broadcast(spark.createDataFrame(shards, "shard int, m int, v int, base int")), "shard")  # a row for each shard
    r = r.withColumn("c", F.pmod(F.xxhash64("node"), F.when(home, F.col("m")).otherwise(F.col("v"))).cast("int"))
    # home blocks i <= j meet in a cell, and each block of guests meets each home block in one
    pair = lambda i, j: (F.col("base") + i * F.col("m") - (i * (i - 1) / 2).cast("int") + (j - i)).cast("int")
    guest = lambda i, j: (F.col("base") + (F.col("m") * (F.col("m") + 1) / 2).cast("int") + i * F.col("m") + j).cast("int")
    side = lambda at, left, own: F.struct(at.alias("cell"), left.alias("left"), F.lit(own).alias("own"))
    c, blocks = F.col("c"), F.sequence(F.lit(0), F.col("m") - 1)
    own = F.transform(blocks, lambda j: side(pair(F.least(c, j), F.greatest(c, j)), c <= j, True))
    met = F.transform(F.sequence(F.lit(0), F.greatest(F.col("v") - 1, F.lit(0))), lambda i: side(guest(i, c), F.lit(False), False))
    out = F.transform(blocks, lambda j: side(guest(c, j), F.lit(True), False))
    cells = F.when(home & (F.col("v") > 0), F.concat(own, met)).when(home, own).otherwise(out)
    r = r.select(F.explode(cells).alias("x"), "node", *_F, "w").select("x.cell", "x.left", "x.own", "node", *_F, "w")

    def meet(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        left, node, f = t["left"].to_numpy(zero_copy_only=False), t["node"].to_numpy(), _prints_of(t)
        links = Links(t["w"].to_numpy())
        if left.all() and t["own"][0].as_py():  # a block and itself
            for i, c, _ in search(f, None, radius):
                links.add(i, c)
        else:
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            for i, c, _ in search(f[a], f[b], radius):
                links.add(int(a[i]), b[c])
        at, group, n = links.found()
        yield pa.record_batch({"a": node[at], "b": node[group], "n": n})

    return r.repartitionById(base, F.col("cell")).mapInArrow(meet, "a long, b long, n long")  # a partition is a cell


def _prints(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, h (of the text), f0 to f3 and n (0: no fingerprint) of every row, in the shared folder."""
    ship(docs.sparkSession)
    some = docs.select(col(id).alias("id"), F.xxhash64(col(text).cast("string")).alias("h"), fingerprint(col(text).cast("string")).alias("f"))
    return stored(some.select("id", "h", "f.*"), "simhash")


def _classed(prints: DataFrame, radius: int, cell: int | None) -> DataFrame:
    """f0 to f3, class (the least of no id, id, h among rows alike or near) and links of every fingerprint that has two rows or a partner."""
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h")).alias("best")
    points = prints.where("n > 0").groupBy(*_F).agg(least, F.count("*").alias("w"))
    points = stored(points.withColumn("node", F.monotonically_increasing_id()), "simhash-points")
    return stored(classes(points, near_points(points, radius, cell)).where("links > 0").select(*_F, "class", "links"), "simhash-classes")


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, cell: int | None = None) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the least id of the class of near duplicates it is in (those that chains of near pairs connect),
    and the number of other rows within the radius of this one, copies among them."""
    prints = _prints(docs, id, text)
    found = _classed(prints, radius, cell)
    rows = prints.join(small(found, found.count(), 96, BROADCAST_BYTES), list(_F), "left")
    return rows.select(F.col("id").alias("doc_id"), F.when(F.col("links") > 0, F.col("class.id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, cell: int | None = None) -> DataFrame:
    """docs with one row of each class of near duplicates: that of the least id."""
    prints = _prints(docs, id, text)
    found = _classed(prints, radius, cell)
    i, h, stays, again, one = fresh(docs.columns, "id", "h", "stays", "again", "one")
    rows = prints.where("n > 0").join(small(found, found.count(), 96, BROADCAST_BYTES), list(_F))
    own = F.col("id").eqNullSafe(F.col("class.id")) & (F.col("h") == F.col("class.h"))
    verdict = rows.groupBy(F.col("id").alias(i), F.col("h").alias(h)).agg(F.max(own).alias(stays), (F.count("*") > 1).alias(again)).where(~col(stays) | col(again))
    verdict = stored(verdict, "simhash-verdict")
    keyed = docs.withColumn(h, F.xxhash64(col(text).cast("string"))).alias("d")
    v = small(verdict, verdict.count(), 48, BROADCAST_BYTES).alias("v")
    same = col_of("d", id).eqNullSafe(col_of("v", i)) & (col_of("d", h) == col_of("v", h)) & col_of("d", text).isNotNull()
    judged = keyed.join(v, same, "left").select(*(col_of("d", c) for c in docs.columns), col_of("v", h), col(stays))
    kept = judged.where(col(stays).isNull()).select(*map(col, docs.columns))
    # rows alike in id and text: one stays, by an aggregate that is combined before the shuffle
    most = judged.where(col(stays))
    picked = most.groupBy(col(id).alias(i), col(h)).agg(F.min_by(F.struct(*map(col, docs.columns)), rest_hash(docs, id, text)).alias(one))
    return kept.unionByName(picked.select(*(col(one)[c].alias(c) for c in docs.columns)))


def col_of(table: str, name: str) -> Column:
    return F.col(f"{table}.`" + name.replace("`", "``") + "`")


def op10_simhash_vp(spark, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))
