"""Text expressions: white space, UTF-16 lengths, regular expressions, code units."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the byte order mark.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_CLASS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD_TOKENS = r"[a-zA-Z]+|[0-9]|-|!|\.|_|:|=|'"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACE))


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 code units, as long."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("long")


def words(value: Column) -> Column:
    """Number of parts between single spaces; the empty text has one."""
    return F.size(F.split(value, " ", -1)).cast("long")


def token_count(value: Column, pattern: str = WORD_TOKENS) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("long")


def java_regex(pattern: str, multi_line: bool = False, case_sensitive: bool = True, unicode: bool = False, dot_all: bool = False) -> str:
    """An ECMAScript-style pattern in the dialect of java.util.regex, flags included.

    Without multi_line, $ means the very end; \\s is the Unicode set of white space, and \\S its complement.
    """
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "s":
                out.append(_CLASS_SPACE if inside else f"[{_CLASS_SPACE}]")
            elif n == "S":
                out.append(f"[^{_CLASS_SPACE}]")
            elif n == "u" and (m := re.match(r"\\u\{([0-9a-fA-F]+)\}", pattern[i:])):
                out.append(f"\\x{{{m.group(1)}}}")
                i += len(m.group()) - 2
            elif n == "/":
                out.append("/")
            elif n == "d":
                out.append("0-9" if inside else "[0-9]")
            else:
                out.append(c + n)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[" or c == "&" and pattern[i + 1 : i + 2] == "&":
                c = "\\" + c  # plain in the source dialect
        elif c == "[":
            if pattern.startswith("[^]", i):
                out.append(r"(?s:.)")
                i += 3
                continue
            if pattern.startswith("[]", i):
                out.append(r"(?!)")
                i += 2
                continue
            inside = True
        elif c == "$" and not multi_line:
            c = r"\z"
        elif c == "(" and (m := re.match(r"\(\?<([A-Za-z_]\w*)>", pattern[i:])):
            out.append(f"(?<{m.group(1).replace('_', 'U')}>")
            i += len(m.group())
            continue
        out.append(c)
        i += 1
    flags = ("m" if multi_line else "") + ("" if case_sensitive else "iu") + ("s" if dot_all else "")
    return (f"(?{flags})" if flags else "") + "".join(out)


def quoted(replacement: str) -> str:
    """A replacement that regexp_replace takes literally."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def to_ascii(value: Column, invalid: str) -> Column:
    """Every UTF-16 code unit above 0x7F replaced: characters outside the basic plane have two."""
    two = F.regexp_replace(value, r"[\x{10000}-\x{10FFFF}]", quoted(invalid * 2))
    return F.regexp_replace(two, r"[^\x00-\x7F]", quoted(invalid)) if invalid.isascii() else _units(value, 0x7F, invalid)


def to_latin1(value: Column, invalid: str) -> Column:
    if all(ord(c) <= 0xFF for c in invalid):
        two = F.regexp_replace(value, r"[\x{10000}-\x{10FFFF}]", quoted(invalid * 2))
        return F.regexp_replace(two, r"[^\x00-\xFF]", quoted(invalid))
    return _units(value, 0xFF, invalid)


def _units(value: Column, top: int, invalid: str) -> Column:
    """For replacements that are themselves above the top: each unit is matched once, and none of a replacement."""
    beyond, within = r"[\x{10000}-\x{10FFFF}]", f"[^\\x00-\\x{top:02X}\\x{{10000}}-\\x{{10FFFF}}]"
    steps = [(within, invalid), (beyond, invalid * 2)]
    if any(ord(c) > 0xFFFF for c in invalid):
        steps.reverse()
        if any(top < ord(c) <= 0xFFFF for c in invalid):  # neither order leaves replacements alone
            return F.array_join(F.transform(F.split(value, ""), lambda c: F.when(c.rlike(beyond), invalid * 2).when(c.rlike(within), invalid).otherwise(c)), "")
    for pattern, new in steps:
        value = F.regexp_replace(value, pattern, quoted(new))
    return value


def reread_utf8(text: str, invalid: str) -> str:
    """The text's UTF-16 code units taken as bytes (those above 0xFF are no byte) and decoded as UTF-8."""
    if text.isascii():
        return text
    units = np.frombuffer(text.encode("utf-16-le"), "<u2")
    return np.minimum(units, 0xFF).astype(np.uint8).tobytes().decode("utf-8", "replace").replace("�", invalid)


def on_arrays(f, most: int = 1 << 20):
    """A function of one text as an Arrow function of array<string>; nulls stay. Of a batch's texts some `most` bytes at a time, or one that is longer, are Python's."""

    def run(arrays: pa.Array) -> pa.Array:
        values = arrays.flatten()
        ends, parts, at = pc.fill_null(pc.binary_length(values), 0).to_numpy().astype(np.int64).cumsum(), [pa.array([], pa.string())], 0
        while at < len(values):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            parts.append(pa.array([None if v is None else f(v) for v in values.slice(at, stop - at).to_pylist()], pa.string()))
            at = stop
        done = pa.concat_arrays(parts)
        lengths = [0 if n is None else n for n in pc.list_value_length(arrays).to_pylist()]
        offsets, at = [0], 0
        for n in lengths:
            at += n
            offsets.append(at)
        missing = pa.array([x for x in arrays.is_null().to_pylist()] + [False])
        return pa.ListArray.from_arrays(pa.array([None if m else o for o, m in zip(offsets, missing.to_pylist())], pa.int32()), done)

    return F.arrow_udf(run, "array<string>").asNondeterministic()  # else a filter that Spark infers from an explode runs it once more, in workers of its own


def fixpoint(pairs: list[tuple[str, str]], growth: int = 1000):
    """All replacements in order, again and again until none changes anything, however many rounds that takes; a text that comes back to what it was before fails, as well as one that grows without end."""

    def f(text: str) -> str:
        most, mark, rounds, power = growth * (len(text) + 1000), text, 0, 1
        while True:
            before = text
            for a, b in pairs:
                text = text.replace(a, b)
            if text == before:
                return text
            if text == mark or len(text) > most:
                raise ValueError("replacements don't settle")
            rounds += 1
            if rounds == power:  # the mark moves on at longer and longer intervals, so that it comes to lie in any cycle
                mark, rounds, power = text, 0, 2 * power

    return f
