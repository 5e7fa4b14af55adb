"""Suffix-array dedup: passages of at least LENGTH words that stand in several documents.

A word is a run of characters other than ASCII white space; passages are compared word by word.

1. Every suffix (a place in a document with at least LENGTH words to its right) has a key: the
   least hash of the 8-word grams within its first LENGTH words. Suffixes that begin with the same LENGTH words
   have the same key, and neighbours in a document mostly share theirs, so keys stand for runs of
   some 20 suffixes. Only runs whose key another document has too go on, which loses nothing.
2. A run with its words is a record. Equal records (by key, length and a 64-bit hash of their words) are kept once, with the two least ids that have them; one document
   of each sends its words to the task that owns the key. There a suffix array is built over the distinct records by two-stage sorting: suffixes smaller than
   their successors are sorted directly, and one scan of the buckets induces the rest.
3. Common prefixes of adjacent suffixes are computed; where one is shorter than LENGTH a class of
   suffixes with equal beginnings ends. Suffixes of classes with two and more documents are repeats.
4. Stretches of repeats are given to all rows that have the record. Neighbouring stretches of a document with the same partner are joined into passages.

The partner named with a passage is the least doc_id among the other documents that have it.

Defined cases. Null, empty or short texts have no suffixes; null ids are left out. Texts of any length are taken whole. Ids may be of any type that has an order. A passage that repeats
within one document only is no repeat. Repeated rows (one id) are one document. Ties: of partners the least id is named. Other columns, of whatever name, are not looked at. An empty table gives
an empty result. All counting by key and record is combined before the shuffle, so a passage that very many documents share is a few narrow rows; work and memory of a task follow the distinct records of its keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .common import col, partitions, read, ship, small, stored, whole_groups

LENGTH = 50
GRAM = 8
BROADCAST_BYTES = 32 << 20


def runs(h: np.ndarray, first: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' hashes h, document d having h[first[d]:first[d + 1]]: row, start, suffixes and key of each run of suffixes with one key."""
    gram = min(gram, length)
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none, none, none.astype(np.uint64)
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - gram + 1 + j]
    g = textops.mix(g)
    window, m, w = length - gram + 1, g, 1
    while 2 * w <= window:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    if window > w:
        m = np.minimum(m[: len(m) - (window - w)], m[window - w :])  # m[s]: least of g[s:s + window]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(m)]
    at = np.arange(len(m)) - first[row]
    valid = at + length <= np.diff(first)[row]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new & valid)
    ahead = np.concatenate([[0], np.cumsum(valid)])
    end = np.append(np.flatnonzero(new), len(m))
    stop = end[np.searchsorted(end, begin, "right")]
    return row[begin], at[begin], ahead[stop] - ahead[begin], m[begin]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of symbols t (dense ranks, the last one unique), by two-stage sorting."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    where = np.searchsorted(change, np.arange(n - 1))
    smaller = np.ones(n, bool)  # than its successor; the last counts as such
    smaller[:-1] = where == len(change)
    inner = where < len(change)
    at = change[where[inner]]
    smaller[:-1][inner] = t[at] < t[at + 1]
    direct = _sorted(t, np.flatnonzero(smaller))
    size = np.bincount(t)
    tail = np.cumsum(size)
    head = tail - size
    own = np.bincount(t[direct], minlength=len(size))  # they close their buckets
    sa = np.full(n, -1, np.int64)
    before = np.cumsum(own) - own
    sa[(tail - own)[t[direct]] + np.arange(len(direct)) - before[t[direct]]] = direct
    out, heads, sym, rest = sa.tolist(), head.tolist(), t.tolist(), (~smaller).tolist()
    for p in range(n):  # a scan of the buckets in order: what precedes a placed suffix and is greater is next in its own bucket
        i = out[p] - 1
        if i >= 0 and rest[i]:
            c = sym[i]
            out[heads[c]] = i
            heads[c] += 1
    return np.array(out, np.int64)


def _sorted(t: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Suffixes idx of t in order: by as many symbols at once as fit 62 bits, ties by those that follow."""
    bits = max(1, int(t.max()).bit_length() + 1)
    step = max(1, 62 // bits)
    padded = np.concatenate([t + 1, np.zeros(step, np.int64)])

    def key(at: np.ndarray) -> np.ndarray:
        k = np.zeros(len(at), np.int64)
        for j in range(step):
            k = k << bits | padded[np.minimum(at + j, len(padded) - 1)]
        return k

    k = key(idx)
    order = np.argsort(k, kind="stable")
    idx, k = idx[order], k[order]
    depth, todo = step, None
    group = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) if len(k) else k
    todo = np.arange(len(idx))
    while len(todo):
        size = np.bincount(group[todo], minlength=1)
        todo = todo[size[group[todo]] > 1]
        if not len(todo):
            break
        k = key(idx[todo] + depth)
        order = np.lexsort((k, group[todo]))
        moved, k, g = idx[todo][order], k[order], group[todo]
        idx[todo] = moved
        new = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (g[1:] != g[:-1]))])
        group[todo] = new  # numbers need to differ among ties only
        depth += step
    return idx


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix, up to most, of each suffix of order and the one before it."""
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    a, b = order[:-1], order[1:]
    for j in range(most):
        inside = (a + j < len(t)) & (b + j < len(t))
        live, a, b = live[inside], a[inside], b[inside]
        same = t[a + j] == t[b + j]
        live, a, b = live[same], a[same], b[same]
        if not len(live):
            break
        lcp[live] = j + 1
    return lcp


def hashed_runs(h: np.ndarray, first: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of the words of each run, by prefix sums."""
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * textops._powers(textops._R, len(h)), out=p[1:])
    a = first[row] + start
    back = textops._powers(textops._RINV, len(h) + 1)[a]
    return textops.mix((p[a + n + length - 1] - p[a]) * back + n.astype(np.uint64))


def repeats(key: np.ndarray, n: np.ndarray, pieces: pa.Array, least: np.ndarray, second: np.ndarray, length: int = LENGTH):
    """(record, from, to, least, second) of stretches of suffixes of distinct records, grouped by key, that two documents have.

    least and second: of the documents that have a record, the two least, as numbers in their order (second -1: there is one).
    """
    kinds = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)))
    base = np.concatenate([[0], np.cumsum(n)])
    cls = np.arange(base[-1])  # the class of suffix o of record r is cls[base[r] + o]
    sort = np.flatnonzero(np.repeat(kinds > 1, kinds))
    if len(sort):
        p = pieces.take(pa.array(sort))
        b, o = textops.raw(p)
        s, e, first = textops.words(b, o)
        h = textops.hashes(b, s, e)
        _, rank = np.unique(h, return_inverse=True)
        count = np.diff(first)
        at = first[:-1] + np.arange(len(sort))  # where each record begins among symbols, with an end mark after each
        t = np.empty(len(h) + len(sort), np.int64)
        row = np.repeat(np.arange(len(sort)), count)
        t[np.arange(len(h)) + row] = rank + len(sort)
        t[at + count] = np.arange(len(sort))[::-1]  # the very last mark is the least symbol
        sa = suffix_array(t)
        m = n[sort]
        of = np.repeat(np.arange(len(sort)), count + 1)
        off = np.arange(len(t)) - at[of]
        sa = sa[off[sa] < m[of[sa]]]  # suffixes that these keys answer for
        lcp = common_prefixes(t, sa, length)
        cls[base[sort[of[sa]]] + off[sa]] = base[-1] + np.cumsum(lcp < length)
    rec = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(rec)) - base[rec]
    two = second[rec] >= 0
    c, d = np.concatenate([cls, cls[two]]), np.concatenate([least[rec], second[rec][two]])
    order = np.lexsort((d, c))
    c, d = c[order], d[order]
    one = np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
    c, d = c[one], d[one]
    head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    more = np.diff(np.append(head, len(c))) > 1
    at = np.searchsorted(c[head], cls)
    low, high = d[head][at], np.where(more, d[np.minimum(head + 1, len(d) - 1)], -1)[at]
    ok = high >= 0
    rec, off, low, high = rec[ok], off[ok], low[ok], high[ok]
    if not len(rec):
        return rec, off, off, low, high
    begin = np.flatnonzero(np.concatenate([[True], (rec[1:] != rec[:-1]) | (off[1:] != off[:-1] + 1) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    return rec[begin], off[begin], off[np.append(begin[1:], len(rec)) - 1], low[begin], high[begin]


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, n_words, other_doc_id) of every passage of at least length words that another document has."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(col(id)).dtypes[0][1]
    d = docs.where(col(id).isNotNull() & col(text).isNotNull()).select(F.xxhash64(col(id), col(text).cast("string")).alias("uid"), col(id).alias("id"), col(text).cast("string").alias("text"))

    def find(batches):
        for b in batches:
            uid, ids = b["uid"], b["id"]
            for i, j in textops.slices(b["text"]):
                buf, offsets = textops.raw(b["text"].slice(i, j - i))
                starts, ends, first = textops.words(buf, offsets)
                h = textops.hashes(buf, starts, ends)
                row, start, n, key = runs(h, first, length)
                record = hashed_runs(h, first, row, start, n, length)
                r = pa.array(row + i)
                yield pa.record_batch({"uid": uid.take(r), "id": ids.take(r), "start": start.astype(np.int32), "n": n.astype(np.int32), "key": key.view(np.int64), "record": record.view(np.int64)})

    found = stored(d.mapInArrow(find, f"uid long, id {kind}, start int, n int, key long, record long"), "suffix-found")
    records = found.groupBy("key", "record", "n").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min(F.struct("uid", "start")).alias("at"))
    records = stored(records, "suffix-records")
    shared = records.groupBy("key").agg(F.min("least").alias("low"), F.max("most").alias("high")).where("low <> high").select("key")
    records = stored(records.join(shared, "key", "left_semi"), "suffix-shared")
    members = stored(found.join(records.select("key", "record", "least"), ["key", "record"]).select("key", "record", "id", "start", "least"), "suffix-members")
    second = members.where("id <> least").groupBy("key", "record").agg(F.min("id").alias("second"))
    run = F.struct(F.col("at.start").alias("start"), "n", "key", "record", "least", "second")
    by_doc = stored(records.join(second, ["key", "record"], "left").groupBy("at.uid").agg(F.collect_list(run).alias("runs")), "suffix-runs")
    flagged = by_doc.select("uid")
    with_runs = d.join(small(flagged, flagged.count(), 16, BROADCAST_BYTES), "uid", "left_semi").dropDuplicates(["uid"]).join(by_doc, "uid")

    def cut(batches):
        for b in batches:
            for i, j in textops.slices(b["text"]):
                part = b.slice(i, j - i)
                buf, offsets = textops.raw(part["text"])
                starts, ends, first = textops.words(buf, offsets)
                lists = part["runs"]
                r = lists.flatten()
                row = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                start, n = r.field("start").to_numpy().astype(np.int64), r.field("n").to_numpy().astype(np.int64)
                low, high = starts[first[row] + start], ends[first[row] + start + n + length - 2]
                data = buf.tobytes()
                pieces = [data[x:y] for x, y in zip(low.tolist(), high.tolist())]
                yield pa.record_batch({"piece": pa.array(pieces, pa.binary())} | {c: r.field(c) for c in ("key", "record", "n", "least", "second")})

    pieces = with_runs.select("text", "runs").mapInArrow(cut, f"piece binary, key long, record long, n int, least {kind}, second {kind}")
    owned = pieces.repartition(partitions(spark), "key").sortWithinPartitions("key")

    def sort(batches):
        for t, _ in whole_groups(batches, ["key"], 8 << 20):
            t = t.combine_chunks()
            least, second = (t[c].combine_chunks() for c in ("least", "second"))
            ids = pc.unique(pa.concat_arrays([least, second])).drop_null()
            ids = ids.take(pc.sort_indices(ids))
            number = lambda a: pc.fill_null(pc.index_in(a, ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            text = t["piece"].combine_chunks().cast(pa.large_binary()).view(pa.large_string())
            r, low, high, one, two = repeats(t["key"].to_numpy(), t["n"].to_numpy().astype(np.int64), text, number(least), number(second), length)
            yield pa.record_batch({"key": t["key"].combine_chunks().take(pa.array(r)), "record": t["record"].combine_chunks().take(pa.array(r)), "low": low, "high": high, "one": ids.take(pa.array(one)), "two": ids.take(pa.array(two))})

    found_in = owned.mapInArrow(sort, f"key long, record long, low long, high long, one {kind}, two {kind}")
    part = members.join(found_in, ["key", "record"])
    part = part.select(F.col("id").alias("doc"), F.when(F.col("id") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("other"), (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    pair = Window.partitionBy("doc", "other").orderBy("low", "high")
    joined = part.withColumn("reach", F.max("high").over(pair.rowsBetween(Window.unboundedPreceding, -1)))
    joined = joined.withColumn("new", F.when(F.col("reach").isNull() | (F.col("low") > F.col("reach") + 1), 1).otherwise(0))
    joined = joined.withColumn("passage", F.sum("new").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("doc", "other", "passage").agg(F.min("low").alias("start_word"), F.max("high").alias("end"))
    return out.select(F.col("doc").alias("doc_id"), "start_word", (F.col("end") - F.col("start_word") + length).alias("n_words"), F.col("other").alias("other_doc_id"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
h AS (SELECT doc_id, list_transform(range(len(ws) - 49), lambda s: md5(array_to_string(ws[s + 1 : s + 50], ' '))) AS hs FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, unnest(hs) AS k, generate_subscripts(hs, 1) - 1 AS s FROM h),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k HAVING min(doc_id) <> max(doc_id)),
n AS (SELECT k, low, min(doc_id) AS next FROM g JOIN m USING (k) WHERE doc_id <> low GROUP BY k, low),
r AS (SELECT DISTINCT doc_id, s, CASE WHEN doc_id = low THEN next ELSE low END AS other FROM g JOIN n USING (k)),
i AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, other ORDER BY s) AS island FROM r)
SELECT doc_id, min(s) AS start_word, max(s) - min(s) + 50 AS n_words, other AS other_doc_id FROM i GROUP BY doc_id, other, island
"""


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
