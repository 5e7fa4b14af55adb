"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Quotas. Of n_s rows a source gives q_s = min(n_s, level * w_s), the level being such that the
   quotas sum to share * rows exactly (largest remainders): without repeats, in the proportion of
   the weights but for sources that are used up.
2. Tree. The quotas are halved again and again among the output shards: a node draws how much of
   each source goes to its left half from the multivariate hypergeometric distribution, as if all
   chosen rows had been shuffled. Row counts of every shard and source are exact.
3. Blocks. Rows fall into blocks of about BLOCK by the hash of their id. A source's blocks, in an
   order permuted by a keyed hash, are laid end to end, and the shards draw disjoint runs of them;
   rows within a block are permuted too. Blocks beyond the quota are dropped before anything moves.
4. Each shard is shuffled locally.

The tree is on the driver, sources times shards in size, and at most TREE numbers: beyond, and beyond SHARDS shards, shards have more rows.
There are at most about 2**20 blocks, so no window or table grows beyond that but in proportion to sources. Draws are exact for populations of any size.

Defined cases. A null source is a source of its own, and takes part like any other. A weight that is
missing from given weights is 0; without positive weights the result is empty. Rows fall into blocks by id and a hash of the other columns, so
null ids and repeated ids don't crowd one; rows alike in id fall in order of that hash, and rows alike in all may change places. Empty, null and very long texts are rows
like others, and no text is looked at. Ids are of any type. Repeated rows count as rows. Columns of any name are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, read, rest_hash, ship, small

SHARE = 0.8
BLOCK = 256
SHARD_ROWS = 8192
SEED = 42
BROADCAST_BYTES = 32 << 20
SHARDS = 1 << 16
TREE = 1 << 22
#: numpy draws from populations of less than this.
_NUMPY = 10**9


def quotas(counts: np.ndarray, weights: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers q <= counts in proportion to weights but where a source is used up; their sum is total if that can be."""
    counts, weights = np.asarray(counts, np.int64), np.asarray(weights, float)
    total = min(int(total), int(counts[weights > 0].sum()))
    ideal, free, left = np.zeros(len(counts)), weights > 0, float(total)
    while free.any():
        level = left / weights[free].sum()
        full = free & (level * weights >= counts)
        if not full.any():
            ideal[free] = level * weights[free]
            break
        ideal[full] = counts[full]
        left -= counts[full].sum()
        free &= ~full
    q = np.minimum(np.floor(ideal + 1e-9).astype(np.int64), counts)
    for i in sorted(range(len(q)), key=lambda i: (q[i] - ideal[i], i)):
        if q.sum() >= total:
            break
        q[i] += int(q[i] < counts[i] and weights[i] > 0)
    return q


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows, drawn from good + bad without putting any back, are good."""
    if good + bad < _NUMPY:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(good, n)
    mode = min(high, max(low, (good + 1) * (n + 1) // (good + bad + 2)))
    sd = math.sqrt(max(1.0, n * (good / (good + bad)) * (bad / (good + bad)) * max(1, good + bad - n) / (good + bad)))
    a, b = max(low, int(mode - 12 * sd - 20)), min(high, int(mode + 12 * sd + 20))  # beyond, less than 1e-30 of the weight
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))  # log p(k + 1) / p(k)
    p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(p - p.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def split(q: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """How many rows of each source (column) go to each shard (row); rows sum to sizes, columns to q."""
    out = np.zeros((len(sizes), len(q)), np.int64)
    ahead = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    todo = [(0, len(sizes), np.asarray(q, np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        m = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        draw, rest = int(ahead[m] - ahead[a]), int(have.sum())
        if rest < _NUMPY:
            left = rng.multivariate_hypergeometric(have, draw, method="marginals") if len(have) else have
        else:
            left = np.zeros_like(have)
            for s, n in enumerate(have.tolist()):
                rest -= n
                left[s] = hypergeometric(rng, n, rest, draw)
                draw -= int(left[s])
        todo += [(a, m, left), (m, b, have - left)]
    return out


def _key(source: str) -> Column:
    return F.when(col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col(source).cast("string")))


def placed(docs: DataFrame, id: str = "doc_id", source: str = "source", weights: dict | None = None, share: float = SHARE, shard_rows: int = SHARD_ROWS, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, str, str, int]:
    """The chosen rows with their shard and their order in it, the names of these columns, and the number of shards."""
    spark = docs.sparkSession
    ship(spark)
    key, blk, start, shard, cuts, order, rank, n, one, limit, blocks_ = fresh(docs.columns, "key", "block", "start", "shard", "cuts", "order", "rank", "n", "one", "limit", "blocks")
    keyed = docs.withColumn(key, _key(source))
    counts = sorted((r[0], r[1]) for r in keyed.groupBy(key).count().collect())
    names, have = [k for k, _ in counts], np.array([c for _, c in counts], np.int64)
    given = None if weights is None else {"-" if k is None else f"+{k}": w for k, w in weights.items()}
    w = np.array([1.0 if given is None else max(0.0, float(given.get(k, 0))) for k in names])
    q = quotas(have, w, int(have.sum() * share))
    total = int(q.sum())
    shards = max(1, min(-(-total // shard_rows), SHARDS, TREE // max(1, len(names))))
    sizes = np.diff(np.arange(shards + 1) * total // shards)
    tree = split(q, sizes, seed)
    bounds = {k: np.concatenate([[0], np.cumsum(tree[:, i])]) for i, k in enumerate(names)}
    per = max(block, int(have.sum()) >> 20)
    plan = spark.createDataFrame([(k, int(q[i]), max(1, int(-(-have[i] // per)))) for i, k in enumerate(names)], f"`{key}` string, `{limit}` long, `{blocks_}` long")
    plan = small(plan, len(names), 64, BROADCAST_BYTES)
    rest = rest_hash(docs, id, source)
    u = F.xxhash64(F.lit(seed), col(id), rest)
    rows = keyed.join(plan.where(col(limit) > 0), key).withColumn(blk, F.pmod(F.xxhash64(F.lit(seed + 1), u), col(blocks_)))
    ahead = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), col(key), col(blk)), blk).rowsBetween(Window.unboundedPreceding, -1)
    table = rows.groupBy(key, blk, limit).agg(F.count("*").alias(n)).withColumn(start, F.coalesce(F.sum(n).over(ahead), F.lit(0))).where(col(start) < col(limit))
    sent = spark.sparkContext.broadcast(bounds)

    def draw(frames):
        for f in frames:
            first, inner = [], []
            for k, a, m in zip(f[key], f[start], f[n]):
                b = sent.value[k]
                i = int(np.searchsorted(b, a, "right")) - 1
                first.append(i)
                inner.append(b[i + 1 : int(np.searchsorted(b, a + m, "left"))])
            yield pd.DataFrame({key: f[key], blk: f[blk], start: f[start], shard: first, cuts: inner})

    table = table.select(key, blk, start, n).mapInPandas(draw, f"`{key}` string, `{blk}` long, `{start}` long, `{shard}` int, `{cuts}` array<long>")
    table = small(table, sum(-(-int(h) // per) for h in have), 64, BROADCAST_BYTES)
    within = Window.partitionBy(key, blk).orderBy(u, col(id), rest)
    out = rows.join(table, [key, blk]).withColumn(rank, col(start) + F.row_number().over(within) - 1).where(col(rank) < col(limit))
    out = out.withColumn(shard, col(shard) + F.size(F.filter(col(cuts), lambda c: c <= col(rank))))
    out = out.withColumn(order, F.xxhash64(F.lit(seed + 2), col(key), col(rank)))
    return out.select(*map(col, docs.columns), shard, order), shard, order, shards


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """(doc_id, source, shard, position) of the chosen rows."""
    out, shard, order, _ = placed(docs.select(col(id).alias("doc_id"), col(source).alias("source")), "doc_id", "source", **how)
    at = F.row_number().over(Window.partitionBy(shard).orderBy(order)) - 1
    return out.select("doc_id", "source", col(shard).alias("shard"), at.alias("position"))


def mixed(docs: DataFrame, id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The chosen rows, columns as they were: a partition for each shard, shuffled within it."""
    out, shard, order, shards = placed(docs, id, source, **how)
    return out.repartitionById(shards, col(shard)).sortWithinPartitions(order).drop(shard, order)


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
