"""Exact dedup, SimHash near-dedup, embeddings and repeated passages against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import components, embedding_lsh, exact_dedup, simhash_vp, suffix_dedup, textops


def test_directory_splits_and_doubles():
    d = exact_dedup.Directory({0: 3, 1: 5, 3: 2}, bits=2, capacity=5)
    assert (d.depth, d.slots) == (2, [0, 1, 2, 2])
    assert exact_dedup.Directory({}, 4, 10).slots == [0]
    hot = exact_dedup.Directory({5: 10**6, 0: 1}, 4, 10)  # one hash can't be split: it is chained
    assert hot.depth == 4 and len(hot.slots) == 16 and max(hot.owners(3)) == 2
    assert hot.owners(3) == sorted(hot.owners(3))


def _exact(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            continue
        if t in first:
            out.append((i, first[t]))
        else:
            first[t] = i
    return out


def test_exact_duplicates(awkward, nothing, documents):
    for d in (awkward, documents):
        got = exact_dedup.exact_duplicates(d).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(map(tuple, got), key=key) == sorted(_exact(d.select("doc_id", "text").collect()), key=key)
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    kept = exact_dedup.without_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    texts = [r.text for r in kept.collect()]
    n_null = awkward.where("text is null").count()
    assert texts.count(None) == n_null and len(texts) - n_null == len({r.text for r in awkward.collect()} - {None})
    assert exact_dedup.without_exact_duplicates(nothing).count() == 0


def test_equal_hashes_are_told_apart_by_bytes(spark):
    """A hash under which different texts collide."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "b"), (5, "ab"), (6, "aa")], "doc_id long, text string")
    bad = lambda text: F.xxhash64(F.substring(text, 1, 1))
    assert sorted(map(tuple, exact_dedup.exact_duplicates(d, hash_with=bad).collect())) == [(3, 1), (5, 2), (6, 1)]
    assert {r.doc_id for r in exact_dedup.without_exact_duplicates(d, hash_with=bad).collect()} == {1, 2, 4}


def test_words_and_hashes():
    texts = ["", "a b", None, "  x\ny  ", "é\t語", "end", "start"]
    buf, offs = textops.raw(pa.array(texts))
    s, e, first = textops.words(buf, offs)
    got = [[bytes(buf[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [(t or "").split() for t in texts]
    same = textops.raw(pa.array(["word", "other word", "word"]))
    s, e, _ = textops.words(*same)
    h = textops.hashes(same[0], s, e)
    assert h[0] == h[2] == h[3] and h[1] != h[0]
    assert list(textops.slices(pa.array(["a" * 10, "b", "c" * 30, "d"]), 12)) == [(0, 2), (2, 3), (3, 4)]


def _pairs(f, n, radius=24):
    return {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if n[i] and n[j] and int(np.bitwise_count(f[i, :2] ^ f[j, :2]).sum()) <= radius and int(np.bitwise_count(f[i] ^ f[j]).sum()) <= 2 * radius}


@pytest.mark.parametrize("radius", [3, 24])
def test_tree_search_is_exact(radius):
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**63, (600, 4)).astype(np.uint64)
    f[300:] = f[:300]
    for i in range(300, 600):
        for b in rng.integers(0, 256, rng.integers(0, 16)):
            f[i, b // 64] ^= np.uint64(1 << int(b % 64))
    f[500:540] = f[7] ^ (np.uint64(1) << rng.integers(0, 63, (40, 4)).astype(np.uint64))  # a crowd
    true = _pairs(f, np.ones(600, int), radius)
    got = [(min(a, b), max(a, b)) for a, c, _ in simhash_vp.search(f, None, radius, leaf=16) for b in c.tolist()]
    assert set(got) == true and len(got) == len(true)
    met = [(a, b) for a, c, _ in simhash_vp.search(f[:250], f[250:], radius, leaf=16) for b in (c + 250).tolist()]
    assert len(set(met)) == len(met) and set(met) == {(a, b) for a, b in true if a < 250 <= b}
    tree, leaves = simhash_vp.build(f, 16, radius)
    if radius == 3:  # here bounds prune
        assert leaves > 8
        assert sum(len(q) for _, q in simhash_vp.visit(tree, f, np.arange(600), 3)) < 0.8 * 600 * leaves


def _labels(n, pairs):
    l = list(range(n))

    def root(i):
        while l[i] != i:
            i = l[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        l[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def _classes(ids, pairs):
    """(id, class, links) of rows by brute force; null ids come last."""
    label, links = _labels(len(ids), pairs), [0] * len(ids)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    least = {}
    for i, l in zip(ids, label):
        least[l] = min((x for x in (least.get(l), i) if x is not None), default=None)
    return sorted(((i, least[l], n) for i, l, n in zip(ids, label, links)), key=str)


def test_links_of_a_task():
    links = components.Links(np.array([1, 2, 3, 4, 5]))
    links.add(0, np.array([2]))
    links.add(3, np.array([4]))
    links.add(2, np.array([3, 4]))
    assert [x.tolist() for x in links.found()] == [[0, 2, 3, 4], [0, 0, 0, 0], [3, 10, 8, 7]]


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (3, 1), (None, 5), (20, 30), (30, 20)]
    got = dict(map(tuple, components.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {2: 1, 3: 1, 6: 5, 7: 5, 8: 5, 9: 5, 30: 20}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _near(rows):
    return _pairs(*simhash_vp.fingerprints(pa.array([t for _, t in rows], pa.string())))


@pytest.mark.parametrize("cell", [None, 90])
def test_near_classes(awkward, nothing, documents, cell):
    """One row for each row, with the least id of its class and the number of its partners, by comparing every pair; in one cell and in many."""
    for d in (awkward, documents):
        rows = [(r.doc_id, r.text) for r in d.collect()]
        got = sorted(map(tuple, simhash_vp.near_classes(d, cell=cell).collect()), key=str)
        assert got == _classes([i for i, _ in rows], _near(rows)) and any(n for *_, n in got)
    assert simhash_vp.near_classes(nothing, cell=cell).count() == 0


def test_sizes_do_not_matter(spark):
    """A text and the same with a section added: the fingerprints decide, not the numbers of words."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 510)]
        rows += [(2 * k, " ".join(words[:400])), (2 * k + 1, " ".join(words))]
    true = _near(rows)
    assert sum((2 * k, 2 * k + 1) in true for k in range(40)) > 20
    got = simhash_vp.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _classes([i for i, _ in rows], true)


def test_copies_of_near_texts_and_ids_of_text(spark):
    """Two equal texts near two others: every row has three links; ids may be strings, and rows repeated."""
    words = [f"word{i}" for i in range(200)]
    one, two = " ".join(words), " ".join(["changed", *words[1:]])
    rows = [("b", one), ("c", one), ("d", two), ("e", two), ("c", one), (None, two), ("z", "alone in the world"), ("y", None)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(map(tuple, simhash_vp.near_classes(d).collect()), key=str)
    assert got == _classes([i for i, _ in rows], _near(rows)) and ("b", "b", 5) in got
    assert sorted(r.doc_id for r in simhash_vp.without_near_duplicates(d).collect()) == ["b", "y", "z"]


def test_which_repeated_row_stays(spark):
    """Rows alike in id and text but not in a map: the same one stays however rows lie."""
    rows = [(1, "some words here", {"k": str(k)}) for k in range(9)] + [(2, "some words here", {"k": "x"})]
    d = spark.createDataFrame(rows, "doc_id long, text string, m map<string,string>")
    kept = [simhash_vp.without_near_duplicates(d.repartition(n)).collect() for n in (1, 7)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] and kept[0][0].doc_id == 1
    kept = [exact_dedup.without_exact_duplicates(d.repartition(n)).collect() for n in (1, 7)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] and kept[0][0].doc_id == 1


def test_one_of_each_group_stays(awkward, nothing):
    kept = simhash_vp.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 22 not in ids and 1 in ids and not {20, 21} & set(ids) and ids.count(3) == 1
    assert {30, 31, 32, 33, 36} <= set(ids)  # no words, no duplicates
    assert 34 in ids and 38 not in ids and ids.count(None) == 1  # the null id's text is doc 2's; the null text stays
    assert simhash_vp.without_near_duplicates(nothing).count() == 0


def test_collision_probability_and_shape():
    rng = np.random.default_rng(2)
    d = 0.5
    hit = np.floor((rng.normal(size=200_000) * d + (b := rng.uniform(0, 2, 200_000))) / 2) == np.floor(b / 2)
    assert abs(hit.mean() - embedding_lsh.collision(d)) < 0.01
    assert embedding_lsh.shape(1000)[0] < embedding_lsh.shape(10**6)[0]


@pytest.fixture(scope="module")
def vectors():
    """Rows with crowds of near copies, exact copies, and vectors that match nothing."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 32))
    for i in range(300, 700):
        x[i] = x[i % 40] + rng.normal(size=32) * rng.uniform(0.02, 0.16)
    x[700:800] = x[:100]
    x[800:] = x[5] + rng.normal(size=(100, 32)) * 0.05
    rows = [(int(i), [float(z) for z in v * (1 if 700 <= i < 800 else rng.uniform(0.1, 9))], "l") for i, v in enumerate(x)]
    rows += [(5, rows[5][1], "l"), (5, rows[5][1], "m"), (1000, None, None), (1001, [], "l"), (1002, [0.0] * 32, "l"), (1003, [None] * 32, "l"), (1004, [float("nan")] * 32, "l"), (1005, [1.0, 2.0], "l"), (1006, [2.0, 4.0], "l"), (1007, [0.0] * 32, "l"), (None, rows[0][1], "l"), (None, None, None)]
    u = np.array([np.pad(v, (0, 32 - len(v))) / np.linalg.norm(v) if v and None not in v and np.isfinite(v).all() and any(v) else np.full(32, np.nan) for _, v, _ in rows])
    dim = np.array([len(v or []) for _, v, _ in rows])
    return rows, {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu((u @ u.T >= 0.95) & (dim[:, None] == dim), 1)))}


def test_near_vectors(spark, vectors):
    rows, true = vectors
    assert len(true) > 5000
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, sig string")
    want = _classes([i for i, *_ in rows], true)
    for block in (7, 2048):
        got = sorted(map(tuple, embedding_lsh.near_vectors(d, block=block).collect()), key=str)
        assert [r[:1] for r in got] == [r[:1] for r in want]
        assert 0.995 * 2 * len(true) <= sum(r[2] for r in got) <= 2 * len(true)
        assert np.mean([a == b for a, b in zip(got, want)]) > 0.97
    named = spark.createDataFrame([(None if i is None else f"v{i:04}", v) for i, v, _ in rows], "vec_id string, embedding array<double>")
    got = embedding_lsh.near_vectors(named).collect()
    assert len(got) == len(rows) and {r.class_id for r in got if r.vec_id == "v1006"} == {"v1005"}
    assert embedding_lsh.near_vectors(d.limit(0)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(200):
        t = np.append(rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 60)), 0).astype(np.int64)
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def _passages(rows, length):
    seen, words, by = {}, {}, {}
    for i, t in rows:
        if i is not None and t is not None:
            words.setdefault(i, set()).add(t)
    for i, ts in words.items():
        for t in ts:
            w = t.split()
            for s in range(len(w) - length + 1):
                seen.setdefault(tuple(w[s : s + length]), set()).add(i)
    for i, ts in words.items():
        for t in ts:
            w = t.split()
            for s in range(len(w) - length + 1):
                if o := seen[tuple(w[s : s + length])] - {i}:
                    by.setdefault((i, min(o)), set()).add(s)
    out = set()
    for (i, p), ss in by.items():
        for s in sorted(ss):
            if s - 1 not in ss:
                e = s
                while e + 1 in ss:
                    e += 1
                out.add((i, s, e - s + length, p))
    return out


@pytest.mark.parametrize("length", [50, 9, 3])
def test_repeated_passages(awkward, nothing, documents, length):
    for d in (documents, awkward) if length == 50 else (documents,):
        got = list(map(tuple, suffix_dedup.repeated_passages(d, length=length).collect()))
        assert len(got) == len(set(got)) and set(got) == _passages([(r.doc_id, r.text) for r in d.collect()], length)
    assert suffix_dedup.repeated_passages(nothing).count() == 0


def test_passages_of_many_copies_and_ids_of_text(spark):
    """A boilerplate in most documents, alone or within others, exact copies and repeated rows; ids are strings."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    boiler, rows = words(70), []
    for k in range(120):
        own = words(60)
        rows.append((f"d{rng.integers(0, 1000):03}", " ".join(boiler if k % 3 == 0 else own[:30] + boiler + own[30:] if k % 3 == 1 else own)))
    rows += [(f"e{k}", rows[1][1]) for k in range(5)] + [rows[0]] * 3 + [(None, rows[0][1]), ("n", None), ("s", "short")]
    d = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    got = list(map(tuple, suffix_dedup.repeated_passages(d).collect()))
    assert len(got) == len(set(got)) and set(got) == _passages(rows, 50) and len(got) > 80
