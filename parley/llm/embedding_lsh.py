"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length 1; each of several tables hashes them by quantised random projections
floor((a.v + b) / WIDTH), so that two vectors of cosine t, at distance sqrt(2 - 2t), share a bucket
the more often the closer they are. Vectors that share a bucket in some table are compared exactly, in doubles.
The number of projections follows the logarithm of the number of vectors and that of tables its
power rho < 1, so that a bucket holds few strangers at any size and a pair at the very
threshold is found with probability RECALL, closer ones more surely.

Equal vectors are one point, with their number for its weight. Points are sent only where their bucket has company; big buckets are cut into cells of blocks
against blocks. A pair counts in the first table in which it meets, so none counts twice. What a task returns is a row for each
point with partners (their weight, and the group that the task saw it in), so results grow with the vectors, not with the pairs.

Defined cases. Vectors that are null, empty, of length 0 or not finite, or hold a null, match nothing, equal ones neither: each is a class of its own. Vectors of
different dimension never match. Ids may be of any type that has an order. Rows with null ids count like others, and never name a class that another row could name. Repeated rows
are listed each, and count as links of each other. Ties: a class is named by its least id. Other columns, of whatever name, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import col, partitions, read, ship, small, stored, whole_groups
from .components import Links, classes

THRESHOLD = 0.95
WIDTH = 2.0
RECALL = 0.99
BLOCK = 2048
SEED = 11
BROADCAST_BYTES = 32 << 20


def collision(distance: float, width: float = WIDTH) -> float:
    """The probability that one projection puts two vectors at this distance into one bin."""
    if distance <= 0:
        return 1.0
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def shape(n: int, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Projections in a table, and tables, for n vectors: strangers are taken to be orthogonal."""
    near, far = collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2)) / math.log(1 / far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(near**k, 1 - 1e-9))))


def signatures(x: np.ndarray, k: int, tables: int, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """The bucket, as 32 bits, of each unit vector in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.normal(size=(x.shape[1], tables * k)), rng.uniform(0, width, tables * k)
    q = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    h = np.full((len(x), tables), x.shape[1], np.uint64)
    for i in range(k):
        h = textops.mix(h * np.uint64(0x9E3779B97F4A7C15) + q[:, :, i])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _usable(v: str) -> str:
    """SQL: a vector that can match others."""
    return f"coalesce(size({v}) > 0 and not exists({v}, e -> e is null or isnan(e) or abs(e) = double('infinity')) and exists({v}, e -> e <> 0), false)"


def near_points(points: DataFrame, n: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, n) of points (node, v, w) with partners of cosine threshold and more: b is in a's group, n the weight of the partners that a task saw."""
    spark = points.sparkSession
    k, tables = shape(n, threshold)

    def sign(batches):
        for b in batches:
            dims = np.diff(b["v"].offsets.to_numpy())
            for d in np.unique(dims):
                pick = np.flatnonzero(dims == d)
                x = b["v"].take(pa.array(pick)).flatten().to_numpy().reshape(len(pick), d)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for at in range(0, len(pick), 2048):  # bounds the matrix of projections
                    y, p = x[at : at + 2048], pa.array(pick[at : at + 2048])
                    yield pa.record_batch({"node": b["node"].take(p), "w": b["w"].take(p), "v": _lists(y), "sig": _lists(signatures(y, k, tables))})

    signed = stored(points.select("node", "w", "v").mapInArrow(sign, "node long, w long, v array<double>, sig array<int>"), "vectors")
    places = signed.select("node", F.posexplode("sig").alias("t", "bucket"))
    company = places.groupBy("t", "bucket").count().where("count > 1").withColumn("m", F.ceil(F.col("count") / block).cast("int")).drop("count")
    members = places.join(company, ["t", "bucket"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j"), (F.col("c") <= j).alias("a")))
    members = members.select("node", "t", "bucket", F.explode(cells).alias("x")).select("node", "t", "bucket", "x.i", "x.j", "x.a")
    keys = ["t", "bucket", "i", "j"]
    met = members.join(signed, "node").repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def compare(batches):
        for t, starts in whole_groups(batches, keys):
            ends = np.append(starts[1:], t.num_rows)
            node, w, table = t["node"].to_numpy(), t["w"].to_numpy(), t["t"].to_numpy()
            is_a, i, j = t["a"].to_numpy(zero_copy_only=False), t["i"].to_numpy(), t["j"].to_numpy()
            dim = np.diff(t["v"].combine_chunks().offsets.to_numpy())
            sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            flat, offs = t["v"].combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(dim)])
            links = Links(w)  # by rows of t: a point has a row in each cell
            for a, b in zip(starts.tolist(), ends.tolist()):
                for d in np.unique(dim[a:b]):  # vectors of different dimensions meet by chance only
                    own = a + np.flatnonzero(dim[a:b] == d)
                    same = i[a] == j[a]
                    p, q = (own, own) if same else (own[is_a[own]], own[~is_a[own]])
                    if not len(p) or not len(q):
                        continue
                    right = flat[offs[q][:, None] + np.arange(d)].T
                    for at in range(0, len(p), 256):  # bounds what is held of a crowded bucket
                        some = p[at : at + 256]
                        hits = flat[offs[some][:, None] + np.arange(d)] @ right >= threshold
                        for r in np.flatnonzero(hits.any(1)):
                            u, z = int(some[r]), q[hits[r]]
                            z = z[z > u] if same else z
                            z = z[(sig[z] == sig[u]).argmax(1) == table[u]]
                            if len(z):
                                links.add(u, z)
            at, group, n = links.found()
            yield pa.record_batch({"a": node[at], "b": node[group], "n": n})

    return met.mapInArrow(compare, "a long, b long, n long")


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, n_links) of every row: the least id of the class it is in (those that chains of near pairs connect), and the number of
    other rows whose cosine with it is at least threshold."""
    ship(vectors.sparkSession)
    v = F.transform(col(vector), lambda e: e.cast("double"))
    rows = stored(vectors.select(col(id).alias("id"), v.alias("v")).withColumn("ok", F.expr(_usable("v"))).withColumn("h", F.xxhash64("v")), "vectors-in")
    points = rows.where("ok").groupBy("v").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("best"), F.count("*").alias("w"), F.first("h").alias("h"))
    points = stored(points.withColumn("node", F.monotonically_increasing_id()), "vectors-distinct")
    found = stored(classes(points, near_points(points, points.count(), threshold, block)).where("links > 0").select("h", "v", "class", "links"), "vectors-classes")
    found = found.withColumn("ok", F.lit(True))
    clash = found.groupBy("h").count().where("count > 1").limit(1).count()  # hashes join, and vectors too where two share one
    keys = ["ok", "h", "v"] if clash else ["ok", "h"]
    out = rows.drop(*([] if clash else ["v"])).join(small(found.select(*keys, "class", "links"), 1 if clash else found.count(), (1 << 40) if clash else 64, BROADCAST_BYTES), keys, "left")
    return out.select(F.col("id").alias("vec_id"), F.when(F.col("links") > 0, F.col("class.id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
c AS (SELECT DISTINCT a AS r, a AS root FROM p UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.r),
g AS (SELECT c.r, min(v.vec_id) AS class_id FROM c JOIN v ON v.r = c.root GROUP BY c.r),
l AS (SELECT a AS r, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CASE WHEN l.n > 0 THEN g.class_id ELSE v.vec_id END AS class_id, coalesce(l.n, 0) AS n_links FROM v LEFT JOIN g USING (r) LEFT JOIN l USING (r)
"""


def op4_embedding_lsh(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
