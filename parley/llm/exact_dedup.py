"""Exact dedup by an extendible-hash index on shared files.

Every text has a 64-bit hash; its leading bits address a directory of buckets. A bucket that
holds more than its share of entries is split on its next bit, and where that needs a bit more
than the directory has, the directory doubles. The index has an entry for each distinct hash, with the length of its chain. The directory is built on the driver from counts of entries
by 16-bit prefix (at most 65,536 rows at any input size; entries that share 16 bits share a bucket, however many); buckets are dealt to owner tasks as
contiguous key ranges of like weight. The index is written to the shared folder; only the texts of chains of two and more
travel to their owners, each once from every task that has it, and owners compare them byte by byte.

Defined cases. Null text: equal to nothing, always kept. Empty texts equal each other. Texts of any length are compared whole. Ids may be of any type that has an order. Of equal
texts the row with the least id stays (null ids last; then by a hash of the other columns, maps and variants by their JSON), and
exactly one row of rows that are alike in everything; repeated rows are listed as duplicates of their own id. An empty table gives an empty result.
Columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, partitions, read, rest_hash, ship, small, stored

PREFIX_BITS = 16
#: Bytes of chain keys that may be broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Entries of the index for an owner, beyond what the session's number of partitions gives.
OWNED = 4 << 20


class Directory:
    """An extendible-hash directory over prefixes of known counts.

    >>> d = Directory({0: 3, 1: 5, 3: 2}, bits=2, capacity=5)
    >>> d.depth, d.slots
    (2, [0, 1, 2, 2])
    """

    def __init__(self, counts: dict[int, int], bits: int, capacity: int) -> None:
        self.bits, self.capacity, self.depth = bits, capacity, 0
        weight = [0] * ((1 << bits) + 1)
        for p, n in counts.items():
            weight[p + 1] = n
        for i in range(1 << bits):
            weight[i + 1] += weight[i]
        self._sum = weight
        buckets, todo = [], [(0, 0)]  # (prefix, local depth)
        while todo:
            prefix, local = todo.pop()
            if self._load(prefix, local) > capacity and local < bits:
                if local == self.depth:
                    self.depth += 1  # the directory doubles
                todo += [(prefix << 1 | 1, local + 1), (prefix << 1, local + 1)]
            else:
                buckets.append((prefix, local))
        self.buckets = buckets  # in key order
        self.slots = [b for b, (_, local) in enumerate(buckets) for _ in range(1 << (self.depth - local))]

    def _load(self, prefix: int, local: int) -> int:
        w = self.bits - local
        return self._sum[(prefix + 1) << w] - self._sum[prefix << w]

    def owners(self, n: int) -> list[int]:
        """The owner of each bucket: contiguous key ranges of about equal load."""
        total, out, seen = max(1, self._sum[-1]), [], 0
        for prefix, local in self.buckets:
            load = self._load(prefix, local)
            out.append(min(n - 1, (2 * seen + load) * n // (2 * total)))
            seen += load
        return out


def _hash(text: str) -> Column:
    return F.when(col(text).isNotNull(), F.xxhash64(col(text)))


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def chains(docs: DataFrame, text: str = "text", hash_with=_hash, prefix_bits: int = PREFIX_BITS) -> tuple[DataFrame, int, int]:
    """(h, owner) of every chain of two and more entries, from the index on shared files; their number; the number of owners."""
    spark = docs.sparkSession
    keys = stored(docs.select(hash_with(text).alias("h")).where("h is not null").groupBy("h").agg(F.count("*").alias("entries")), "exact-keys")
    counts = {r[0]: r[1] for r in keys.groupBy(_prefix(F.col("h"), prefix_bits).alias("p")).count().collect()}
    total = sum(counts.values())
    owners = max(partitions(spark), -(-total // OWNED))
    directory = Directory(counts, prefix_bits, max(4096, total // 32768))
    of = directory.owners(owners)
    wide = prefix_bits - directory.depth
    table = spark.createDataFrame([(slot, b, of[b]) for slot, b in enumerate(directory.slots)], "slot int, bucket int, owner int")
    slot = F.shiftright(_prefix(F.col("h"), prefix_bits), wide)
    entries = keys.withColumn("slot", slot).join(F.broadcast(table), "slot").drop("slot")  # 2**16 rows at most
    index = stored(entries.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "h"), "exact-index")
    long = index.where("entries > 1").select("h", "owner")
    return long, long.count(), owners


def _judged(docs: DataFrame, id: str, text: str, hash_with, prefix_bits: int, whole: bool) -> tuple[DataFrame, str, str, str]:
    """docs (or of them id alone) with, for texts that stand several times, the hash, the row's place in the order among its equals and the first of these places."""
    h, own, first, t, texts = fresh(docs.columns, "h", "own", "first", "t", "texts")
    place = F.struct(col(id).isNull().alias("no"), col(id).alias("id"), rest_hash(docs, id, text).alias("rest"))
    keys, n, owners = chains(docs, text, hash_with, prefix_bits)
    rows = docs.select(hash_with(text).alias("h"), col(text).cast("string").alias("text"), place.alias("place"))
    # each text once from every task (the aggregate is combined before the shuffle), then to its owner
    distinct = rows.join(small(keys, n, 24, BROADCAST_BYTES), "h").groupBy("owner", "h", "text").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    owned = distinct.repartitionById(owners, F.col("owner"))
    several = F.count("*").over(Window.partitionBy("owner", "h"))  # texts that share all 64 bits
    firsts = owned.withColumn("texts", several).where("n > 1 or texts > 1")
    firsts = stored(firsts.select(F.col("h").alias(h), F.when(F.col("texts") > 1, F.col("text")).alias(t), F.col("place").alias(first), F.col("texts").alias(texts)), "exact-firsts")
    clash = firsts.where(col(texts) > 1).limit(1).count()
    here = docs.withColumn(h, hash_with(text)).withColumn(own, place)
    if not whole:
        here = here.select(col(id), h, own, *([col(text)] if clash else []))
    firsts = small(firsts, 1 if clash else firsts.count(), (1 << 40) if clash else 64, BROADCAST_BYTES)
    if clash:
        (other,) = fresh([*docs.columns, h, own, first, t, texts], "other")
        firsts = firsts.withColumnRenamed(h, other)
        found = here.join(firsts, (col(h) == col(other)) & ((col(texts) == 1) | (col(text).cast("string") == col(t))), "left")
    else:
        found = here.join(firsts.drop(t, texts), h, "left")
    return found, h, own, first


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", hash_with=_hash, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(doc_id, duplicate_of) of every row whose text an earlier row has, byte for byte."""
    ship(docs.sparkSession)
    found, h, own, first = _judged(docs.select(col(id), col(text)), id, text, hash_with, prefix_bits, False)
    found = found.where(col(first).isNotNull()).select(col(own).alias("own"), col(first).alias("first"))
    later = found.where("own <> first").select(F.col("own.id").alias("doc_id"), F.col("first.id").alias("duplicate_of"))
    # rows alike in all: one of them is the first
    tied = found.where("own = first").groupBy("first").agg(F.count("*").alias("n")).where("n > 1")
    return later.unionByName(tied.select(F.explode(F.array_repeat("first.id", F.col("n").cast("int") - 1)).alias("doc_id")).withColumn("duplicate_of", F.col("doc_id")))


def without_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", hash_with=_hash, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """docs with one row of each text, columns as they were."""
    found, h, own, first = _judged(docs, id, text, hash_with, prefix_bits, True)
    kept = found.where(col(first).isNull()).select(*map(col, docs.columns))
    (row,) = fresh(docs.columns, "row")
    same = found.where(col(own) == col(first)).groupBy(h, own).agg(F.any_value(F.struct(*map(col, docs.columns))).alias(row))  # rows alike in all
    return kept.unionByName(same.select(*(col(row)[c].alias(c) for c in docs.columns)))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k
  FROM documents WHERE text IS NOT NULL)
WHERE k > 1
"""
