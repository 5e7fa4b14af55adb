"""Personal data and secrets by a semi-Markov conditional random field.

A text is a sequence of tokens (runs of letters and digits, of white space, and single other characters). The model
scores labelled segments: a segment of a type has features of its whole span (its shape, digit counts,
checks of addresses, check sums, length of hexadecimal runs), of the tokens on both sides, and of the type
of the segment before it; a segment outside all types is one token and scores 0 but for that last
feature. Dynamic programming over segment ends, with entities of at most MAX_TOKENS tokens, finds the best
boundaries and types jointly; forward and backward sums over the same lattice give the gradient of the
likelihood, and the weights are fitted on the driver, on sentences that a seeded generator writes, with
look-alikes (versions, dates, prices, plain numbers) among them.

Candidates are spans within a line, without two blanks in a row, of at most MAX_TOKENS tokens and any number of characters, that begin and end with a letter or digit (or begin with + or an opening bracket) and
hold a digit or @, or follow a cue such as "password =" in one run without blanks. Every other segmentation has no weight, so tokens away from these are outside in
any best labelling, and the sequence falls into independent stretches around them: only
stretches are labelled, of whatever length, and nothing is missed. The best labelling is put out as soon as all live ones agree on it, so that a
long stretch takes time in proportion to its length, and memory for the part that is still open.

Offsets count characters. Defined cases. Null and empty texts have no rows in the result; null ids
are kept as they are, ids are of any type. Texts of any length are read whole. Repeated rows give repeated entities. Ties: of labellings that score alike the
one with the fewer entity tokens is taken. Other columns, of whatever name, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import col, read, ship

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "IBAN")
MAX_TOKENS = 24
SENTENCES = 700
SEED = 3
_TOKEN = regex.compile(r"[^\W_]+|\s+|.", regex.S)
_BACK = regex.compile(r"(?r)[^\W_]+|\s+|.", regex.S)
_TRIGGER = re.compile(r"[0-9@]")
_CUE = re.compile(r"(?i)(?<![^\W_])(?:password|passwd|pwd|secret|token|key)[ \t]?[:=][ \t]?[\"']?(?=[^\W_])")
_NEAR = MAX_TOKENS + 12  # tokens on either side of a trigger: more than an entity and its context take
_OPEN = 4096  # tokens between two looks at what is settled
_HEX = regex.compile(r"[0-9a-fA-F]+\Z")
_MAIL = regex.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+\Z")
_LETTERS, _DIGITS, _OTHER = regex.compile(r"[^\W\d_]+"), regex.compile(r"[0-9]+"), regex.compile(r"[^0-9]+")
_LOOSE, _LENGTHS = regex.compile(r"9[0-9]+"), regex.compile(r"(?<=9)[0-9]+")
_NAME, _BEFORE = regex.compile(r"[\w-]+\Z"), regex.compile(r"([^\W\d_]+)\W*\Z")
_IBAN = regex.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z", regex.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _shape(span: str) -> str:
    """Letters as a, digit runs as 9 with their length, the rest as it is."""
    s = _LETTERS.sub("a", span)
    return _DIGITS.sub(lambda m: f"9{len(m.group())}", s)


@lru_cache(maxsize=65536)
def span_features(shape: str, kind: int, digits: int, n: int) -> tuple[str, ...]:
    """What of a span's features depends on a digest of it only."""
    loose = _LOOSE.sub("9", shape)
    return (f"shape={shape}" if len(shape) <= 40 else "shape=long", f"loose={loose}" if len(loose) <= 24 else "loose=long", f"kind={kind}", f"digits={min(digits, 20)}", f"kind={kind},digits={min(digits, 20)}", f"length={min(n // 4, 12)}", "bias")


def _kind(span: str) -> int:
    """A set of checks of the whole span, as bits."""
    k = 0
    if "@" in span and _MAIL.match(span):
        k |= 1
    parts = span.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        k |= 2
    digits = _OTHER.sub("", span)
    if 13 <= len(digits) <= 19 and not any(c.isalpha() for c in span):
        k |= 4
        if _luhn(digits):
            k |= 8
    if len(span) >= 20 and _HEX.match(span) and any(c.isalpha() for c in span):
        k |= 16
        if len(span) in (32, 40, 64):
            k |= 32
    if _IBAN.match(span.replace(" ", "")):
        k |= 64
    if 7 <= len(digits) <= 15 and span[0] in "+(":
        k |= 128
    if 24 <= len(span) and span.isascii() and _NAME.match(span) and digits and any(c.isalpha() for c in span):
        k |= 256
    return k


class Lattice:
    """The candidate segments of one stretch of text: (first token, end, features)."""

    def __init__(self, text: str, features: bool = True) -> None:
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.text = text
        self.start, self.end = [a for a, _ in spans], [b for _, b in spans]
        n = self.n = len(spans)
        self.edge = edge = [text[a].isalnum() for a in self.start]
        self.opens = [e or text[a] in "+([" for e, a in zip(edge, self.start)]
        mark = [e and not text[a:b].isalpha() and bool(_TRIGGER.search(text, a, b)) or text[a] == "@" for (a, b), e in zip(spans, edge)]
        upcoming, nxt = [n] * (n + 1), n
        for i in range(n - 1, -1, -1):
            nxt = i if mark[i] else nxt
            upcoming[i] = nxt
        self.upcoming = upcoming
        self.cued = {m.end() for m in _CUE.finditer(text)}
        self.stop = [text[a].isspace() and (b - a > 1 or text[a] == "\n") for a, b in spans]  # no segment goes over these
        self.segments = [(i, j, self._features(i, j - 1)) for i in range(n) for j in self.ends(i)] if features else []

    def ends(self, i: int):
        """The ends of the segments that begin at token i."""
        if not self.opens[i]:
            return
        cued, edge, stop = self.start[i] in self.cued, self.edge, self.stop
        least = i if cued else self.upcoming[i]
        if least >= i + MAX_TOKENS:
            return
        for j in range(i, min(self.n, i + MAX_TOKENS)):
            if stop[j]:
                return
            if cued and j < self.upcoming[i] and self.text[self.start[j]].isspace():
                cued, least = False, self.upcoming[i]  # without a digit or @ a value has no blanks
            if edge[j] and j >= least:
                yield j + 1

    def before(self, i: int) -> list[str]:
        """Features of what stands before a segment."""
        before = self.text[max(0, self.start[i] - 12) : self.start[i]].lower()
        out = ["before=" + before[-1:]]
        word = _BEFORE.search(before)
        if word and word.group(1) in _CUES:
            out.append("cue=" + word.group(1))
        if self.start[i] in self.cued:
            out.append("value")
        return out

    def after(self, j: int) -> list[str]:
        """Features of what stands behind a segment whose last token is j."""
        at = self.end[j]
        return ["after=" + self.text[at : at + 1], "goes on" if self.text[at : at + 1] in ".-@" and self.text[at + 1 : at + 2].isalnum() else "ends"]

    def _features(self, i: int, j: int) -> list[str]:
        span = self.text[self.start[i] : self.end[j]]
        digits = sum("0" <= c <= "9" for c in span)
        return [*span_features(_shape(span), _kind(span), digits, len(span)), *self.before(i), *self.after(j)]


_CUES = {"token", "key", "secret", "password", "api", "iban", "card", "phone", "tel", "call", "mail", "email", "ip", "version", "license", "price", "passwd", "pwd"}


def _long(shape: str) -> str:
    """What span_features takes of a shape too long to be a feature."""
    loose = _LOOSE.sub("9", shape)
    return "long " + (loose if len(loose) <= 24 else "")


class Model:
    """Weights of (feature, type) and of (type before, type); type 0 is outside."""

    def __init__(self, index: dict[str, int]) -> None:
        self.index, self.k = index, len(TYPES)
        self.w = np.zeros((len(index) + 1, self.k))  # features unknown to the index share the last row, which stays 0
        self.t = np.zeros((self.k + 1, self.k + 1))
        self.sums: dict[tuple, list[float]] = {}

    def scores(self, lattice: Lattice) -> list[np.ndarray]:
        get, last = self.index.get, len(self.index)
        return [self.w[[get(f, last) for f in fs]].sum(0) for _, _, fs in lattice.segments]

    def scored(self, lattice: Lattice):
        """For each first token its segments as (end, scores by type), as `scores` has them: what depends on the first token, on the last and on a digest of the span is summed once for each."""
        get, last, w, text = self.index.get, len(self.index), self.w, lattice.text
        shapes = [_shape(text[a:b]) for a, b in zip(lattice.start, lattice.end)]
        digits = [sum(map(int, _LENGTHS.findall(s))) if "9" in s else 0 for s in shapes]
        alpha = ["a" in s for s in shapes]
        sums, after = self.sums, {}

        def total(key, features) -> list[float]:
            s = sums.get(key)
            if s is None:
                s = w[[get(f, last) for f in features]].sum(0).tolist()
                if len(sums) < 1 << 17:
                    sums[key] = s
            return s

        for i in range(lattice.n):
            ends = list(lattice.ends(i))
            if not ends:
                yield ()
                continue
            own = total(tuple(some := lattice.before(i)), some)
            at, out, k = lattice.start[i], [], i
            shape, count, letters, dots = "", 0, False, 0
            for j in ends:
                for k in range(k, j):
                    shape, count, letters, dots = shape + shapes[k], count + digits[k], letters or alpha[k], dots + (shapes[k] == ".")
                k = j
                n = lattice.end[j - 1] - at
                # the checks of _kind, where none of them can hold it is 0
                head = text[at]
                kind = 0
                if head in "+(" or "@" in shape or dots == 3 or letters and n >= 13 or not letters and count >= 13:
                    kind = _kind(text[at : at + n])
                key = (shape if len(shape) <= 40 else _long(shape), kind, min(count, 20), min(n // 4, 12))
                s = sums.get(key) or total(key, span_features(shape, kind, count, n))
                behind = after.get(j)
                if behind is None:
                    behind = after[j] = total(tuple(some := lattice.after(j - 1)), some)
                    after.pop(j - MAX_TOKENS - 1, None)
                out.append((j, [x + y + z for x, y, z in zip(s, own, behind)]))
            yield out

    def best(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """The segments (first token, end, type) of the best labelling but those outside."""
        n, k, t = lattice.n, self.k + 1, self.t.tolist()
        low = float("-inf")
        types, every = range(1, k), range(k)
        v: dict[int, list] = {0: [0.0] + [low] * (k - 1)}  # of tokens that open segments may still reach
        back: dict[int, list] = {0: [None] * k}
        coming: dict[int, list] = {}
        out: list[tuple[int, int, int]] = []
        base = 0  # what is before it has been put out
        segments = self.scored(lattice)
        for j in range(n + 1):
            if j:
                prev = v[j - 1]
                p = max(every, key=lambda a: (prev[a] + t[a][0], -a))
                row, from_ = [prev[p] + t[p][0]] + [low] * (k - 1), [(j - 1, p)] + [None] * (k - 1)
                for i, into, s in coming.pop(j, ()):
                    for y in types:
                        if (z := into[y][0] + s[y - 1]) > row[y]:
                            row[y], from_[y] = z, (i, into[y][1])
                v[j], back[j] = row, from_
                v.pop(j - MAX_TOKENS - 1, None)
            if j < n and (own := next(segments)):
                at = v[j]
                into = [None, *(max((at[a] + t[a][y], -a) for a in every) for y in types)]
                into = [None, *((z, -a) for z, a in into[1:])]
                for end, s in own:
                    coming.setdefault(end, []).append((j, into, s))
            if j - base >= _OPEN and j < n:
                # all live labellings agree before a place that each of their traces passes
                live = {(i, y) for i in range(max(base, j - MAX_TOKENS), j + 1) for y in every if v[i][y] > low}
                while len(live) > 1:
                    i, y = max(live)
                    live.discard((i, y))
                    if i <= base:
                        break
                    live.add(back[i][y])
                else:
                    (i, y), = live
                    if i > base:
                        out += self._trace(back, i, y, base)
                        for x in range(base, i):
                            back.pop(x, None)
                        back[i], base = [None] * k, i
        out += self._trace(back, n, max(every, key=lambda a: (v[n][a], -a)), base)
        return out

    def _trace(self, back: dict, j: int, y: int, base: int) -> list[tuple[int, int, int]]:
        out = []
        while j > base:
            i, a = back[j][y]
            if y:
                out.append((i, j, y))
            j, y = i, a
        return out[::-1]

    def rows(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Rows of weights of all segments' features, one after the other, and where each segment's begin."""
        get, last = self.index.get, len(self.index)
        at = np.cumsum([0] + [len(fs) for _, _, fs in lattice.segments])
        return np.array([get(f, last) for _, _, fs in lattice.segments for f in fs], np.int64), at[:-1]

    def gradient(self, lattice: Lattice, gold: list[tuple[int, int, int]], rows: tuple[np.ndarray, np.ndarray] | None = None):
        """Log-likelihood of the gold labelling and its gradient, by forward and backward sums."""
        n, k = lattice.n, self.k + 1
        flat, at = rows or self.rows(lattice)
        s = np.add.reduceat(self.w[flat], at, axis=0) if len(at) else np.zeros((0, self.k))
        first, end = np.array([x[:2] for x in lattice.segments], np.int64).reshape(-1, 2).T
        lse = np.logaddexp.reduce
        a, b, into = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf), np.empty((n + 1, self.k))
        a[0, 0], b[n] = 0, 0
        ending = [np.flatnonzero(end == j) for j in range(n + 1)]
        starting = [np.flatnonzero(first == i) for i in range(n + 1)]
        for j in range(n + 1):
            if j:
                a[j, 0] = lse(a[j - 1] + self.t[:, 0])
                if len(x := ending[j]):
                    a[j, 1:] = lse(into[first[x]] + s[x], 0)
            into[j] = lse(a[j][:, None] + self.t[:, 1:], 0)
        for i in range(n - 1, -1, -1):
            b[i] = self.t[:, 0] + b[i + 1, 0]
            if len(x := starting[i]):
                b[i] = np.logaddexp(b[i], lse(self.t[:, 1:] + lse(s[x] + b[end[x], 1:], 0), 1))
        z = lse(a[n])
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        gt[:, 0] -= np.exp(a[:-1] + self.t[:, 0] + b[1:, :1] - z).sum(0)
        if len(at):
            p = np.exp(a[first][:, :, None] + self.t[:, 1:] + (s + b[end, 1:])[:, None, :] - z)
            gt[:, 1:] -= p.sum(0)
            np.subtract.at(gw, flat, np.repeat(p.sum(1), np.diff(np.append(at, len(flat))), axis=0))
        where = {(i, j): x for x, (i, j, _) in enumerate(lattice.segments)}
        score, done, y0 = 0.0, 0, 0
        for i, j, y in [*gold, (n, n, 0)]:
            for _ in range(done, i):
                score += self.t[y0, 0]
                gt[y0, 0] += 1
                y0 = 0
            if y:
                x = where[i, j]
                score += self.t[y0, y] + s[x][y - 1]
                gt[y0, y] += 1
                np.add.at(gw[:, y - 1], flat[at[x] : at[x] + len(lattice.segments[x][2])], 1)
                y0, done = y, j
        gw[-1] = 0
        return score - z, gw, gt


# Training ---------------------------------------------------------------------------------------


def sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A line of made-up words with entities and look-alikes, and the entities' places."""
    letters = rng.choice(["etaoinshr", "etaoinshrdlucmfg", "aeiouéèlmnrst", "enrißüaschtg"])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 11)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def entity() -> tuple[str, str, str, str]:
        t = rng.choice(TYPES)
        if t == "EMAIL":
            s = rng.choice([f"{word()}.{digits(2)}", word(), f"{word()}.{word()}", f"{word()}_{digits(3)}", f"{word()}+{word()}"]) + "@" + rng.choice([word(), f"mail{digits(1)}", f"{word()}-{word()}"]) + rng.choice([".example", ""]) + rng.choice([".com", ".org", ".net", ".de", ".co.uk"])
        elif t == "PHONE":
            s = rng.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)}-{digits(3)}-{digits(3)}-{digits(4)}"])
        elif t == "IP":
            s = ".".join(str(rng.randint(0 if i else 1, 255)) for i in range(4))
        elif t == "CARD":
            s = rng.choice([digits(16), "4" + digits(15), "-".join(digits(4) for _ in range(4)), " ".join(digits(4) for _ in range(4)), digits(15)])
        elif t == "SECRET" and rng.random() < 0.25:
            s = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * (rng.random() < 0.7)) for _ in range(rng.randint(8, 32)))
            q = rng.choice(['"', '"', "'", ""])
            return f"{rng.choice(['password', 'secret', 'token', 'key', 'passwd', 'PASSWORD'])}{rng.choice([' = ', '=', ': '])}{q}", s, q, t
        elif t == "SECRET":
            s = rng.choice([hexes(40), hexes(40), hexes(32), hexes(64), "sk_live_" + "".join(rng.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(24)), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)) + digits(4)])
            s = s.upper() if rng.random() < 0.15 else s
            if not any("0" <= c <= "9" for c in s) or s.isdigit():
                s += "7a"
            cue = rng.choice(["token", "key", "secret", "api_key", "password", "TOKEN"])
            q = rng.choice(['"', '"', "'", ""])
            return f"{cue}{rng.choice([' = ', ' = ', ': ', '='])}{q}", s, q, t
        else:
            s = rng.choice(["DE", "FR", "ES", "GB"]) + digits(2) + digits(rng.choice([14, 18, 20]))
        if rng.random() < 0.05 and t != "SECRET":
            s = s.upper()
        return "", s, "", t

    def decoy() -> str:
        return rng.choice([f"{digits(1)}.{digits(1)}", f"version {digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(3)}.{digits(2)}", digits(rng.randint(1, 8)), f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"@{word()}", f"{word()} @ {word()}", f"{word()}{digits(2)}", f"NC {digits(1)}.0", f"{digits(1)},{digits(3)},{digits(3)}", f"${digits(3)}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"({digits(4)})", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{rng.choice(['key', 'token', 'secret', 'password'])}: {word()[:7]}", f"key: {word()[:5]} {word()}"])

    junk = rng.choice(["", "", "", "", "!!", "***", "###", "|"])
    text, gold = "", []
    for _ in range(rng.randint(3, 9)):
        text += rng.choice(["", "", "", "", "\n", "(", '"']) if not text or text[-1] in " \n" else ""
        r = rng.random()
        if r < 0.33:
            pre, s, post, t = entity()
            text += pre
            gold.append((len(text), len(text) + len(s), t))
            text += s + post
        elif r < 0.5:
            text += decoy()
        else:
            text += " ".join(word() for _ in range(rng.randint(1, 3)))
        text += (" | " if junk == "|" else junk + " ") if junk else rng.choice([" ", " ", " ", " ", ", ", ". ", ".\n", "; ", ") "])
    return text, gold


@lru_cache(maxsize=2)
def train(sentences: int = SENTENCES, epochs: int = 14, seed: int = SEED) -> Model:
    """Maximum likelihood by Adagrad over the generator's sentences; features seen once carry no weight."""
    rng = random.Random(seed)
    data, seen = [], {}
    for _ in range(sentences):
        text, gold = sentence(rng)
        lattice = Lattice(text)
        start, end = {a: i for i, a in enumerate(lattice.start)}, {b: i + 1 for i, b in enumerate(lattice.end)}
        have = {(i, j) for i, j, _ in lattice.segments}
        marks = [(start.get(a, -1), end.get(b, -1), TYPES.index(t) + 1) for a, b, t in gold]
        if all((i, j) in have for i, j, _ in marks):
            data.append((lattice, marks))
            for _, _, fs in lattice.segments:
                for f in fs:
                    seen[f] = seen.get(f, 0) + 1
    model = Model({f: n for n, f in enumerate(sorted(f for f, c in seen.items() if c > 1))})
    data = [(lattice, marks, model.rows(lattice)) for lattice, marks in data]
    hw, ht = np.full_like(model.w, 1e-6), np.full_like(model.t, 1e-6)
    for _ in range(epochs):
        rng.shuffle(data)
        for at in range(0, len(data), 8):
            gw, gt = -1e-3 * model.w, -1e-3 * model.t
            for lattice, gold, rows in data[at : at + 8]:
                _, dw, dt = model.gradient(lattice, gold, rows)
                gw, gt = gw + dw, gt + dt
            hw, ht = hw + gw**2, ht + gt**2
            model.w += 0.3 * gw / np.sqrt(hw)
            model.t += 0.3 * gt / np.sqrt(ht)
    return model


# Tagging ----------------------------------------------------------------------------------------


def stretches(text: str):
    """(begin, end) of parts of text around triggers, cut where no entity can reach across."""
    begin = end = None
    marks = sorted([m.start() for m in _TRIGGER.finditer(text)] + [m.end() for m in _CUE.finditer(text)])
    for p in marks:
        if end is not None and p < end - 1:
            if p >= at:  # a trigger further on than the last that was looked at
                end = max(end, _tokens_on(text, p))
                at = max(at, (p + end) // 2)
            continue
        low = _tokens_back(text, p)
        if end is not None and low <= end:
            end = max(end, _tokens_on(text, p))
        else:
            if end is not None:
                yield begin, end
            begin, end = low, _tokens_on(text, p)
        at = (p + end) // 2
    if end is not None:
        yield begin, _tokens_on(text, marks[-1])


def _tokens_on(text: str, p: int) -> int:
    """The end of the token that is _NEAR tokens on from place p."""
    end = p
    for k, m in enumerate(_TOKEN.finditer(text, p)):
        end = m.end()
        if k == _NEAR:
            break
    return end


def _tokens_back(text: str, p: int) -> int:
    begin = p
    for k, m in enumerate(_BACK.finditer(text, 0, p)):
        begin = m.start()
        if k == _NEAR:
            break
    return begin


def entities(model: Model, text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of all entities of a text."""
    out = []
    for a, b in stretches(text):
        lattice = Lattice(text[a:b], features=False)
        for i, j, y in model.best(lattice):
            out.append((TYPES[y - 1], a + lattice.start[i], a + lattice.end[j - 1]))
    return out


def find_private(docs: DataFrame, id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, type, start, end) of every entity."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model or train())

    def tag(texts: pa.Array) -> pa.Array:
        m, kinds, starts, ends, offsets = sent.value, [], [], [], [0]
        has = np.zeros(len(texts), bool)
        for i, j in textops.slices(texts):
            buf, offs = textops.raw(texts.slice(i, j - i))
            at = np.flatnonzero((buf >= 48) & (buf <= 58) | (buf == 64) | (buf == 61))  # digits, @, and what stands between a cue and its value
            has[i + np.searchsorted(offs, at, "right") - 1] = True
        for r in range(len(texts)):
            if has[r]:
                for t, a, b in entities(m, texts[r].as_py()):
                    kinds.append(t), starts.append(a), ends.append(b)
            offsets.append(len(kinds))
        items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["type", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    found = docs.where(col(text).isNotNull()).select(col(id).alias("doc_id"), F.explode(F.arrow_udf(tag, "array<struct<type:string,start:int,end:int>>")(col(text))).alias("e"))
    return found.select("doc_id", "e.type", "e.start", "e.end")


def op2_pii_crf(spark, sf_dir: str) -> DataFrame:
    return find_private(read(spark, sf_dir, "documents"))
