"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: it is sliced by bit, so that a place holds a mask with a bit
for each language (in as many planes of 32 as there are languages for), and the masks at an n-gram's places, and-ed, give all languages whose profile has
the n-gram. For each document the masks of all its n-grams (GRAM bytes of the lower-cased text, white space
of any kind and length being one space) are counted by language. Of N n-grams, a language of which
h are in its profile is credited with c = h + (N - h) * f on average, f being the share of foreign
n-grams that its slice lets through (its fill to the power of HASHES), so h is taken to be (c - N f) / (1 - f).
The greatest h decides, if it is MIN_SHARE of N at least; else the language is "und".

Profiles are built on the driver from at most TRAIN_ROWS labelled rows, those of the least hash of their
id: the n-grams that are in MIN_COUNT places of a language and at least a fifth as frequent there
as in any other. Scoring sees every document whole.

Defined cases. A null text, or one with fewer than GRAM bytes (empty, white space), has no n-grams: "und" with share 0, keep
false. Texts of any length are read whole, a slice of rows at a time. Ties: of languages with equal credit the first in alphabetical order is taken. Null labels
don't count for profiles. Without labelled rows all is "und". Repeated rows get equal results, and of rows with one id one is learnt from. Ids are of any type, and null ids
are kept. Other columns, of whatever name, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import col, read, ship

GRAM = 4
PLACES = 20  # bits of a place in the filter
HASHES = 3
TRAIN_ROWS = 6000
MIN_COUNT = 4
MIN_SHARE = 0.3
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[9, 10, 11, 12, 13]] = 32


def grams(buf: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the rows, and the first of each row (with one more entry)."""
    b = _SPACE[buf]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    row = np.zeros(len(b), np.int32)
    np.add.at(row, offsets[1:-1][offsets[1:-1] < len(b)], 1)
    np.cumsum(row, out=row)
    keep = np.ones(len(b), bool)  # of several white-space characters the first stays
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (row[1:] != row[:-1])
    b, row = b[keep], row[keep]
    n = len(b) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g = g << np.uint64(8) | b[j : n + j]
    inside = row[:n] == row[gram - 1 :]
    g, row = g[inside], row[:n][inside]
    return textops.mix(g), np.searchsorted(row, np.arange(len(offsets)))


def _at(g: np.ndarray, k: int) -> np.ndarray:
    """The k-th place of n-grams: three stretches of bits of their hash."""
    return (g >> np.uint64(k * PLACES) & np.uint64((1 << PLACES) - 1)).astype(np.int64)


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray
    pass_rate: np.ndarray

    @classmethod
    def of(cls, profiles: dict[str, np.ndarray]) -> Filter:
        languages = sorted(profiles)
        masks = np.zeros((max(1, -(-len(languages) // 32)), 1 << PLACES), np.uint32)
        for l, name in enumerate(languages):
            for k in range(HASHES):
                masks[l // 32][np.unique(_at(profiles[name], k))] |= np.uint32(1 << l % 32)
        fill = np.array([float((masks[l // 32] >> np.uint32(l % 32) & np.uint32(1)).mean()) for l in range(len(languages))])
        return cls(languages, masks, fill**HASHES)

    def lookup(self, g: np.ndarray) -> np.ndarray:
        """The masks (planes, n-grams) of languages that each n-gram may be of."""
        m = self.masks[:, _at(g, 0)]
        for k in range(1, HASHES):
            m &= self.masks[:, _at(g, k)]
        return m

    def credit(self, g: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For rows and languages the corrected number of n-grams in the profile."""
        m, n = self.lookup(g), np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        for l, f in enumerate(self.pass_rate):
            total = np.zeros(len(g) + 1, np.int32)
            np.cumsum(m[l // 32] >> np.uint32(l % 32) & np.uint32(1), out=total[1:], dtype=np.int32)
            out[:, l] = (total[first[1:]] - total[first[:-1]] - n * f) / (1 - f)
        return out


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def profiles(texts: list[str], langs: list[str]) -> dict[str, np.ndarray]:
    by: dict[str, list[str]] = {}
    for t, l in zip(texts, langs):
        if t is not None and l is not None:
            by.setdefault(l, []).append(t)
    top = sorted(by)
    counts = {}
    for l in top:
        got = []
        lowered = _lower(pa.array(by[l], pa.large_string()))
        for i, j in textops.slices(lowered):
            g, n = np.unique(grams(*textops.raw(lowered.slice(i, j - i)))[0], return_counts=True)
            got.append((g, n))
        g = np.concatenate([x for x, _ in got])
        u, back = np.unique(g, return_inverse=True)
        counts[l] = (u, np.bincount(back, np.concatenate([n for _, n in got]), len(u)))
    best: dict = {}
    every = np.unique(np.concatenate([u for u, _ in counts.values()])) if counts else np.zeros(0, np.uint64)
    rate = np.zeros((len(top), len(every)))
    for k, l in enumerate(top):
        u, n = counts[l]
        rate[k, np.searchsorted(every, u)] = n / max(n.sum(), 1)
    high = rate.max(0) if len(top) else rate
    for k, l in enumerate(top):
        u, n = counts[l]
        best[l] = u[(n >= MIN_COUNT) & (rate[k, np.searchsorted(every, u)] >= high[np.searchsorted(every, u)] / 5)]
    return {l: g for l, g in best.items() if len(g)}


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Filter:
    some = docs.where(col(id).isNotNull() & col(lang).isNotNull()).select(col(id).alias("id")).orderBy(F.xxhash64("id"), "id").limit(rows).distinct()
    rows_ = docs.where(col(lang).isNotNull()).select(col(id).alias("id"), F.struct(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang")).alias("x"))
    one = rows_.join(F.broadcast(some), "id").groupBy("id").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    got = one.select("x.*").toArrow()
    return Filter.of(profiles(got["text"].to_pylist(), got["lang"].to_pylist()))


def identify(docs: DataFrame, model: Filter, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, share, n_grams, keep) of every row; keep: the language could be told."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def tell(texts: pa.Array) -> pa.Array:
        f, n_rows = sent.value, len(texts)
        lang, share, count = np.full(n_rows, "und", object), np.zeros(n_rows), np.zeros(n_rows, np.int64)
        lowered = _lower(texts)
        for i, j in textops.slices(lowered, 1 << 18):
            g, first = grams(*textops.raw(lowered.slice(i, j - i)))
            n = np.diff(first)
            count[i:j] = n
            if f.languages:
                c = f.credit(g, first)
                best = c.argmax(1)
                s = np.maximum(c[np.arange(j - i), best], 0) / np.maximum(n, 1)
                share[i:j] = np.minimum(s, 1)
                known = s >= MIN_SHARE
                lang[i:j][known] = np.array(f.languages, object)[best[known]]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(share), pa.array(count)], ["language", "share", "n_grams"])

    e = docs.select(col(id).alias("doc_id"), F.arrow_udf(tell, "language string, share double, n_grams long")(col(text)).alias("e"))
    return e.select("doc_id", "e.language", "e.share", "e.n_grams").withColumn("keep", F.col("language") != "und")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
