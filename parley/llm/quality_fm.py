"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], which takes time
linear in the active features. Features are present (1) or absent: every distinct lower-cased word
and beginning of a word (PREFIX bytes) hashed to one of 2**18 places, ten statistics of the text's structure in bins, and the metadata
(language, source, bin of n_chars), hashed too. Two machines share the features: one for quality, one
for toxicity. A document is kept if its quality is at least, and its toxicity below, a threshold: halfway between one half
and the score beyond which LOSS of the good training rows lie, but at least one half for quality and at most one half for toxicity.

Both machines are fitted on the driver by Adam on at most TRAIN_ROWS labelled rows, those of the least
hash of their id. Features in fewer than MIN_DOCS of them, and those whose share of a machine's label is
within MIN_Z standard errors of the average, carry no weight: so thousands of indifferent words in a
long document don't drown one that tells. Scoring sees every document whole.

Defined cases. A null text counts as empty. An empty text has structure and metadata features only.
Texts of any length are read whole, a slice of rows at a time. Null metadata is a value of its own; metadata columns that are missing count as null. Labels that
are null are left out; of several labels of a document the greatest counts, and of several documents of an id the one of the least hash. Ids are of any type that labels have too; null ids are scored and not learnt from. With no labelled rows,
or labels of one kind only, nothing can be learnt: that machine passes every document (quality 1,
toxicity 0). Repeated rows get equal scores. Ties: a score at a threshold passes for quality and not for toxicity. An empty table gives an empty
result. Columns of any name are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import col, read, ship

BITS = 18
TRAIN_ROWS = 20_000
MIN_DOCS = 5
MIN_Z = 4.0
FACTORS = 8
PREFIX = 4
LOSS = 0.002
METADATA = ("lang", "source", "n_chars")
_PLACES = 1 << BITS
_STRETCH = 1 << 16
_CLASSES = np.zeros((6, 256), np.int32)
_CLASSES[0, 65:91] = 1  # capitals
_CLASSES[1, [ord(c) for c in "!?"]] = 1
_CLASSES[2, [ord(c) for c in "|#$%&*<>{}[]=_~^\\/"]] = 1
_CLASSES[3, 48:58] = 1
_CLASSES[4, 10] = 1
_CLASSES[5, 97:123] = 1
_EDGES = np.array([0, 0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9])
_LENGTHS = np.array([0, 2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14])


def _structure(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, h: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """A bin for each row and statistic."""
    n = np.maximum(np.diff(offsets), 1)
    count = np.maximum(np.diff(first), 1)
    out = []
    for k in range(len(_CLASSES)):
        total = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_CLASSES[k][buf], out=total[1:])
        part = total[offsets[1:]] - total[offsets[:-1]]
        out.append(np.searchsorted(_EDGES, part / (count if k == 4 else n)))
    size = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=size[1:])
    out.append(np.searchsorted(_LENGTHS, (size[first[1:]] - size[first[:-1]]) / count))
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same = h[1:] == h[:-1]
        inner = first[1:-1]
        same[inner[(inner > 0) & (inner < len(h))] - 1] = False
        np.cumsum(same, out=again[2:])
    out.append(np.searchsorted(_EDGES, (again[first[1:]] - again[np.minimum(first[:-1] + 1, first[1:])]) / count))
    out.append(np.searchsorted(_EDGES, 1 - distinct / count))
    out.append(np.log2(n).astype(np.int64))
    return np.stack(out, 1)


def _metadata(arrays: list[pa.Array], n: int) -> np.ndarray:
    out = np.zeros((n, len(METADATA)), np.int64)
    for k, a in enumerate(arrays):
        if pa.types.is_integer(a.type) or pa.types.is_floating(a.type):
            v = np.nan_to_num(a.cast(pa.float64(), safe=False).fill_null(-1).to_numpy(zero_copy_only=False), nan=-1, posinf=2.0**62, neginf=-1)
            code = np.where(v < 0, -1, np.log2(np.maximum(v, 1)).astype(np.int64)).astype(np.uint64)
        else:
            d = pc.dictionary_encode(a.cast(pa.string()), null_encoding="encode")
            if isinstance(d, pa.ChunkedArray):
                d = d.combine_chunks()
            buf, offs = textops.raw(d.dictionary)
            code = textops.hashes(buf, offs[:-1], offs[1:])[d.indices.to_numpy(zero_copy_only=False)] if len(offs) > 1 else np.zeros(n, np.uint64)
        out[:, k] = textops.mix(code + np.uint64(7919 * (k + 1))) & np.uint64(_PLACES - 1)
    return out


def features(text: pa.Array, meta: list[pa.Array], lut: np.ndarray | None = None):
    """For slices of rows: first row, offsets and places (or their numbers in lut) of the active features of each row."""
    metas = _metadata(meta, len(text))
    for i, j in textops.slices(text):
        buf, offsets = textops.raw(text.slice(i, j - i))
        starts, ends, first = textops.words(buf, offsets, punctuation=False)
        h = textops.hashes(buf, starts, ends, lower=True)
        row = np.repeat(np.arange(j - i), np.diff(first))
        begin = textops.mix(textops.hashes(buf, starts, np.minimum(ends, starts + PREFIX), lower=True) ^ np.uint64(0xA5A5))
        place = (np.concatenate([h, begin]) & np.uint64(_PLACES - 1)).astype(np.int64)
        key = np.unique(row << BITS | place[: len(h)])
        distinct = np.bincount(key >> BITS, minlength=j - i)
        bins = _structure(buf, offsets, starts, ends, first, h, distinct)
        bins = (textops.mix((bins + 64 * np.arange(1, bins.shape[1] + 1)).astype(np.uint64)) & np.uint64(_PLACES - 1)).astype(np.int64)
        fixed = np.concatenate([bins, metas[i:j]], 1)
        key = np.unique(np.concatenate([key, row << BITS | place[len(h) :], (np.arange(j - i)[:, None] << BITS | fixed).ravel()]))
        place = key & (_PLACES - 1)
        if lut is not None:
            place = lut[place]
            key, place = key[place >= 0], place[place >= 0]
        yield i, np.searchsorted(key >> BITS, np.arange(j - i + 1)), place


@dataclass
class Machine:
    """b, w and v of a factorisation machine; v and w have a row for each known feature and one of zeros."""

    b: float
    w: np.ndarray
    v: np.ndarray

    def score(self, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Linear in len(index): the pairwise term by the sum-of-squares identity."""
        out = np.empty(len(offsets) - 1)
        i = 0
        while i < len(out):  # rows by stretches of bounded size
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STRETCH, "right")) - 1)
            at = index[offsets[i] : offsets[j]]
            w, v = self.w[at], self.v[at]
            s = _sums(np.concatenate([v, (v * v).sum(1)[:, None], w[:, None]], 1), offsets[i : j + 1] - offsets[i])
            out[i:j] = self.b + s[:, -1] + 0.5 * ((s[:, :-2] ** 2).sum(1) - s[:, -2])
            i = j
        return out


def pairwise_score(m: Machine, active: list[int]) -> float:
    """The same score by its definition, over all pairs: for tests."""
    return m.b + float(m.w[active].sum()) + sum(float(m.v[a] @ m.v[c]) for k, a in enumerate(active) for c in active[k + 1 :])


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of x, between offsets."""
    ahead = np.zeros((len(x) + 1, x.shape[1]))
    np.cumsum(x, axis=0, out=ahead[1:])
    return ahead[offsets[1:]] - ahead[offsets[:-1]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, known: int, factors: int = FACTORS, epochs: int = 12, rate: float = 0.02, l2: float = 2e-5, seed: int = 7) -> Machine:
    """Logistic loss by Adam, in batches of 64 rows."""
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((known + 1, 1)), rng.normal(0, 0.01, (known + 1, factors))], 1)
    used = np.zeros(known + 1, bool)
    for r in rows:
        used[r] = True
    theta[~used] = 0  # what the machine never saw says nothing
    m, u, b = np.zeros_like(theta), np.zeros_like(theta), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            size = np.array([len(rows[p]) for p in pick])
            index = np.concatenate([rows[p] for p in pick]).astype(np.int64)
            doc = np.repeat(np.arange(len(pick)), size)
            t = theta[index]
            s = _sums(t, np.concatenate([[0], np.cumsum(size)]))
            sq = np.bincount(doc, (t[:, 1:] ** 2).sum(1), len(pick))
            g = (_sigmoid(b + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(1) - sq)) - y[pick]) / len(pick)
            grad = np.empty_like(t)
            grad[:, 0] = g[doc]
            grad[:, 1:] = g[doc, None] * (s[doc, 1:] - t[:, 1:])
            by = np.argsort(index, kind="stable")
            new = np.flatnonzero(np.diff(index[by], prepend=-1))
            ids = index[by][new]
            total = _sums(grad[by], np.append(new, len(by)))
            total += l2 * theta[ids]
            step += 1
            m[ids] = 0.9 * m[ids] + 0.1 * total
            u[ids] = 0.99 * u[ids] + 0.01 * total**2
            theta[ids] -= rate * m[ids] / (np.sqrt(u[ids]) + 1e-6)
            b -= rate * 0.1 * float(g.sum())
    return Machine(b, theta[:, 0].copy(), theta[:, 1:].copy())


@dataclass
class Model:
    lut: np.ndarray
    quality: Machine | None
    toxic: Machine | None
    least_quality: float = 0.5
    most_toxicity: float = 0.5

    def keep(self, s: Column) -> Column:
        return (s["quality"] >= self.least_quality) & (s["toxicity"] < self.most_toxicity)


def _inputs(docs: DataFrame, text: str) -> list[Column]:
    return [col(text).cast("string"), *(col(c) if c in docs.columns else F.lit(None).cast("string") for c in METADATA)]


def _rows(lists: pa.ListArray) -> list[np.ndarray]:
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _codes(*arrays: pa.Array) -> pa.Array:
    out = []
    for _, offsets, place in features(arrays[0], list(arrays[1:])):
        out += [place[a:b].astype(np.int32) for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.array(out, pa.list_(pa.int32()))


def _telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Places of features that are in enough rows and whose share of the label differs from the average."""
    if not rows:
        return np.zeros(0, np.int64)
    have = np.flatnonzero(~np.isnan(y))
    if not len(have) or not 0 < (p := float((y[have] > 0).mean())) < 1:
        return np.zeros(0, np.int64)
    n, k = np.zeros(_PLACES), np.zeros(_PLACES)
    for at in range(0, len(have), 500):  # bounds what is copied at once
        for total, some in ((n, have[at : at + 500]), (k, (part := have[at : at + 500])[y[part] > 0])):
            if len(some):
                total += np.bincount(np.concatenate([rows[i] for i in some]), minlength=_PLACES)
    z = np.abs(k - n * p) / np.sqrt(np.maximum(n, 1) * p * (1 - p))
    return np.flatnonzero((n >= MIN_DOCS) & (z >= MIN_Z))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fits both machines on at most `rows` labelled documents, those of the least hash of their id."""
    ship(docs.sparkSession)
    some = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    x = F.struct(*(c.alias(f"f{k}") for k, c in enumerate(_inputs(docs, text))))
    picked = docs.select(col(id).alias("doc_id"), x.alias("x")).join(F.broadcast(some), "doc_id")
    picked = picked.groupBy("doc_id", "q", "t").agg(F.min_by("x", F.xxhash64("x")).alias("x")).select("doc_id", "q", "t", "x.*")  # one of the rows of an id
    codes = F.arrow_udf(_codes, "array<int>")
    got = picked.select("doc_id", "q", "t", codes(*(f"f{k}" for k in range(1 + len(METADATA)))).alias("x")).toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    views = [r for c in got["x"].chunks for r in _rows(c)]  # of the Arrow buffers, without a copy
    rows_ = [views[i] for i in order]
    y2 = {n: got[n].to_numpy(zero_copy_only=False).astype(float)[order] for n in ("q", "t")}
    telling = {n: _telling(rows_, y) for n, y in y2.items()}
    known = np.union1d(telling["q"], telling["t"]).astype(np.int64)
    lut = np.full(_PLACES, -1, np.int32)
    lut[known] = np.arange(len(known))
    rows_ = [(k := lut[r])[k >= 0] for r in rows_]
    del views

    def machine(name: str) -> Machine | None:
        y = y2[name]
        have = np.flatnonzero(~np.isnan(y))
        kinds = set(y[have] > 0)
        mine = np.isin(known, telling[name])
        return fit([rows_[i][mine[rows_[i]]] for i in have], (y[have] > 0).astype(float), len(known)) if len(kinds) == 2 else None

    model = Model(lut, machine("q"), machine("t"))
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows_])]).astype(np.int64)
    index = np.concatenate(rows_) if rows_ else np.zeros(0, np.int32)
    if model.quality:
        good = _sigmoid(model.quality.score(offsets, index))[y2["q"] > 0]
        model.least_quality = max(0.5, 0.5 * (0.5 + float(np.quantile(good, LOSS))))
    if model.toxic:
        good = _sigmoid(model.toxic.score(offsets, index))[y2["t"] == 0]
        model.most_toxicity = min(0.5, 0.5 * (0.5 + float(np.quantile(good, 1 - LOSS))))
    return model


def score_arrays(model: Model, text: pa.Array, meta: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    q, t = np.ones(len(text)), np.zeros(len(text))
    for i, offsets, index in features(text, meta, model.lut):
        j = i + len(offsets) - 1
        if model.quality:
            q[i:j] = _sigmoid(model.quality.score(offsets, index))
        if model.toxic:
            t[i:j] = _sigmoid(model.toxic.score(offsets, index))
    return q, t


def scored(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct<quality, toxicity> of each document."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(*arrays: pa.Array) -> pa.Array:
        q, t = score_arrays(sent.value, arrays[0], list(arrays[1:]))
        return pa.StructArray.from_arrays([pa.array(q), pa.array(t)], ["quality", "toxicity"])

    return F.arrow_udf(score, "quality double, toxicity double")(*_inputs(docs, text))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality, toxicity, keep) of every document."""
    model = train(docs, labels, id, text, rows)
    s = docs.select(col(id).alias("doc_id"), scored(docs, model, text).alias("s"))
    return s.select("doc_id", F.col("s.quality").alias("quality"), F.col("s.toxicity").alias("toxicity"), model.keep(F.col("s")).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are kept, columns as they were."""
    model = train(docs, labels, id, text, rows)
    return docs.where(model.keep(scored(docs, model, text)))


def op7_quality_fm(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
