"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its pieces are small; each leaf is encoded by itself, and neighbours are
joined upwards. A join re-encodes a window around the seam and keeps the tokens outside it. The
window grows on both sides until it reaches a place where the tokens outside are proved stable:
between a character that is no white space and a white-space character, or between a letter, a digit and another
sign that aren't of one kind (but for an apostrophe before a letter). The pre-tokenizer's
pattern has no alternative that goes on from the one to the other, and looks no further than the
next character, so in any text a pre-token ends exactly there whatever stands further on either
side, and BPE never merges across pre-tokens. Kinds are told for characters that every version of Unicode has alike. Where a side has no such place, the window takes that
side whole. The operation is associative with the empty text as its unit, and gives the tokens of
the whole text's encoding. Decoding concatenates the bytes of tokens up the same tree.

The vocabulary is a file of ranks (base64 token, rank); its path is a parameter. A long text is
one row: its pieces are encoded in turn by the task that has it, in memory linear in its length.

Defined cases. Null text: null tokens, null count, round_trip null. Empty text: no tokens. Texts of any length are encoded whole. Repeated
rows are encoded alike; ids are of any type, and null ids are kept. Ties: of equal ranks the leftmost pair is merged first. Other columns, of
whatever name, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import textops
from .common import col, read, ship

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 8192
WINDOW = 32
_BREAKS = " \n\t\r"


class Codec:
    def __init__(self, path: str = PATH, leaf: int = LEAF) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.leaf = leaf
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes[r] = t
        self.size = np.array([len(t) for t in self.bytes], np.int32)

    def piece(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, 0, len(text)) if text else np.zeros(0, np.int32)

    def _tree(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return self.piece(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self._tree(text, a, m), self._tree(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        p, q = _stable_before(text, a, m), _stable_after(text, m, b)
        i = len(left) - self._count(left[::-1], len(text[p:m].encode()))
        j = self._count(right, len(text[m:q].encode()))
        return np.concatenate([left[:i], self.piece(text[p:q]), right[j:]])

    def _count(self, tokens: np.ndarray, n: int) -> int:
        """How many of the first tokens make up n bytes."""
        if n == 0:
            return 0
        some = tokens[:n]  # a token has one byte at least
        return int(np.searchsorted(np.cumsum(self.size[some]), n)) + 1

    def decode(self, tokens: np.ndarray) -> bytes:
        if len(tokens) <= self.leaf:
            table = self.bytes
            return b"".join([table[t] for t in tokens.tolist()])
        m = len(tokens) // 2
        return self.decode(tokens[:m]) + self.decode(tokens[m:])


def _kind(c: str) -> int:
    """1: a letter, 2: a digit, 3: another sign; 0: not told, or white space."""
    if c < "\x80":
        return 1 if c.isalpha() else 2 if c.isdigit() else 3 if "!" <= c <= "~" else 0
    if "\u4e00" <= c <= "\u9fa5" or "\u3041" <= c <= "\u3096" or "\u30a1" <= c <= "\u30fa" or "\uac00" <= c <= "\ud7a3" or "\u0430" <= c <= "\u044f" or "\u0620" < c <= "\u063a":
        return 1
    return 3 if c in "\u3001\u3002\uff0c\uff01\uff1a\uff1b\uff1f\u300c\u300d" else 0


def _stable(text: str, k: int) -> bool:
    a, b = text[k - 1], text[k]
    if b in _BREAKS:
        return not a.isspace()
    x, y = _kind(a), _kind(b)
    return x > 0 and y > 0 and x != y and not (a == "'" and y == 1)


def _stable_before(text: str, a: int, m: int) -> int:
    """The last stable place in (a, m), or a; the window doubles until it has one."""
    seen, n = m, WINDOW
    while seen > a + 1:
        low = max(a + 1, m - n)
        for k in range(seen - 1, low - 1, -1):
            if _stable(text, k):
                return k
        seen, n = low, 2 * n
    return a


def _stable_after(text: str, m: int, b: int) -> int:
    """The first stable place in (m, b), or b."""
    seen, n = m + 1, WINDOW
    while seen < b:
        high = min(b, m + n)
        for k in range(seen, high):
            if _stable(text, k):
                return k
        seen, n = max(seen, high), 2 * n
    return b


@lru_cache(maxsize=4)
def codec(path: str, leaf: int) -> Codec:
    return Codec(path, leaf)


def _code(texts: pa.Array, c: Codec) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Tokens, their number, and whether they decode to the text's very bytes."""
    out, ok = [], []
    for t in texts:
        t = t.as_py()
        out.append(np.zeros(0, np.int32) if t is None else c.encode(t))
        ok.append(None if t is None else c.decode(out[-1]) == t.encode())
    n = np.array([len(x) for x in out], np.int32)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    tokens = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
    return tokens, pa.array(n, mask=missing), pa.array(ok, pa.bool_())


def decoded(tokens: Column, path: str = PATH, leaf: int = LEAF) -> Column:
    """The text of an array of tokens; null tokens give null, and bytes that are no UTF-8 U+FFFD."""

    def decode(arrays: pa.Array) -> pa.Array:
        c = codec(path, leaf)
        return pa.array([None if t is None else c.decode(np.array(t, np.int32)).decode("utf-8", "replace") for t in arrays.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(tokens)


def tokenize(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = PATH, leaf: int = LEAF) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of every row; texts are taken a megabyte at a time, whole."""
    ship(docs.sparkSession)

    def code(batches):
        c = codec(path, leaf)
        for b in batches:
            for i, j in textops.slices(b["t"]):
                part = b.slice(i, j - i)
                tokens, n, ok = _code(part["t"], c)
                yield pa.record_batch({"doc_id": part["doc_id"], "tokens": tokens, "n_tokens": n, "round_trip": ok})

    kind = StructType([StructField("doc_id", docs.schema[id].dataType), *StructType.fromDDL("tokens array<int>, n_tokens int, round_trip boolean")])
    return docs.select(col(id).alias("doc_id"), col(text).cast("string").alias("t")).mapInArrow(code, kind)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return tokenize(read(spark, sf_dir, "documents"))
