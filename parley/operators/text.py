"""Rewrites of message values. All but the last two of HTML, UTF-8 and recursive replacement stay in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import stripper
from ..schema import with_udf_values, with_values


def trim(df: DataFrame) -> DataFrame:
    """Unicode white space and byte order marks taken off both ends of every value."""
    return with_values(df, T.trimmed)


def encoding(df: DataFrame, codec: str = "utf-8", invalid: str = "�") -> DataFrame:
    """Code units that the codec can't have replaced by invalid; utf-8 re-reads units as bytes. Unknown codecs mean utf-8."""
    if codec == "us-ascii":
        return with_values(df, lambda v: T.to_ascii(v, invalid))
    if codec == "iso-8859-1":
        return with_values(df, lambda v: T.to_latin1(v, invalid))
    return with_udf_values(df, T.on_arrays(lambda v: T.reread_utf8(v, invalid)))


def regex_replace(df: DataFrame, replacements: list, multi_line: bool = False, case_sensitive: bool = True, unicode: bool = False, dot_all: bool = False) -> DataFrame:
    """Patterns replaced in order, each in the result of the one before; replacements are literal."""
    pairs = [(T.java_regex(p, multi_line, case_sensitive, unicode, dot_all), T.quoted(r)) for p, r in replacements]

    def rewrite(v):
        for p, r in pairs:
            v = F.regexp_replace(v, p, r)
        return v

    return with_values(df, rewrite)


def exact_replace(df: DataFrame, replacements: list = (), packed: list = (), recursive: bool = False) -> DataFrame:
    """Literal replacements in order; packed ones come last, their two characters \\n being a line feed.

    recursive repeats the whole list until nothing changes, and fails where it doesn't settle.
    """
    pairs = [(str(r[0]), str(r[1]) if len(r) > 1 and r[1] is not None else "") for r in replacements]
    pairs += [(a.replace("\\n", "\n"), b.replace("\\n", "\n")) for a, b in ((str(r[0]), str(r[1]) if len(r) > 1 and r[1] is not None else "") for r in packed)]
    if any(not a for a, _ in pairs):
        raise ValueError("an empty text can't be replaced")
    if recursive:
        return with_udf_values(df, T.on_arrays(T.fixpoint(pairs)))

    def rewrite(v):
        for a, b in pairs:
            v = F.replace(v, F.lit(a), F.lit(b))
        return v

    return with_values(df, rewrite)


def html_strip(df: DataFrame, anchor_patterns: list = (), anchor_selector: str = "a, img", dom: list = (), case_sensitive: bool = True, bare_references: bool = True) -> DataFrame:
    """Values parsed as HTML fragments and replaced by their text. References without a semicolon are read as HTML does, unless bare_references is false."""
    return with_udf_values(df, T.on_arrays(stripper(anchor_patterns, anchor_selector, dom, case_sensitive, bare_references)))
