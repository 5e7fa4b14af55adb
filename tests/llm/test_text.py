"""Language, private data, quality, language model, BPE and mixing."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import bpe, language_id, lm_pseudo, mixing, pii_crf, quality_fm, textops


# Language


def test_language_accuracy_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(d.where("doc_id % 2 = 0"))
    rows = language_id.identify(d.where("doc_id % 2 = 1"), model).join(d, "doc_id").collect()
    assert np.mean([r.language == r.lang for r in rows]) > 0.98


def test_credit_against_sets():
    texts = {"x": ["abcdef abcabc", "fedcba"], "y": ["zzzyyyxxx abc"]}
    rows = [(t, l) for l, ts in texts.items() for t in ts * 4]
    prof = language_id.profiles([t for t, _ in rows], [l for _, l in rows])
    f = language_id.Filter.of(prof)
    lowered = pa.array(["abcdef  ABC", "zzzyyy", "", "qq"], pa.large_string())
    g, first = language_id.grams(*textops.raw(lowered))
    m = f.lookup(g)
    for l, name in enumerate(f.languages):
        true = np.isin(g, prof[name])
        assert ((m[0] >> l & 1)[true] == 1).all()  # no false negatives
        c = f.credit(g, first)[:, l]
        assert np.allclose(c[1:], [(np.isin(g[a:b], prof[name]).sum()) for a, b in zip(first[1:-1], first[2:])], atol=0.1)


def test_forty_languages(spark):
    """Against plain sets, with more languages than a word has bits."""
    rng = random.Random(9)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)] for k in range(40)}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(30)), l) for i, l in enumerate(sorted(words) * 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(d)
    assert len(model.languages) == 40 and model.masks.shape[0] == 2
    got = {r.doc_id: r for r in language_id.identify(d, model).collect()}
    prof = language_id.profiles([t for _, t, _ in rows], [l for *_, l in rows])
    for i, t, l in rows:
        g = language_id.grams(*textops.raw(pa.array([t], pa.large_string())))[0]
        held = {name: np.isin(g, p).sum() for name, p in prof.items()}
        assert got[i].language == l == max(held, key=held.get) and abs(got[i].share - held[l] / len(g)) < 0.1


def test_a_repeated_id_is_learnt_once(spark):
    d = spark.createDataFrame([(1, "some text here", "en", "s", 14)] * 50 + [(2, "andere worte hier", "de", "s", 17)] * 3, "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_fm.train(d, labels, rows=2) and quality_fm.classify(d, labels).count() == 53
    assert language_id.identify(d, language_id.train(d)).count() == 53


def test_language_cases(awkward, nothing):
    model = language_id.train(awkward)
    rows = {(r.doc_id, r.n_grams): r for r in language_id.identify(awkward, model).collect()}
    assert len(language_id.identify(awkward, model).collect()) == awkward.count()
    assert rows[(30, 0)].language == "und" and not rows[(32, 0)].keep and rows[(32, 0)].share == 0
    assert language_id.identify(nothing, language_id.train(nothing)).count() == 0
    assert {r.language for r in language_id.identify(awkward, language_id.train(nothing)).collect()} == {"und"}


# Private data


@pytest.fixture(scope="module")
def crf():
    return pii_crf.train(sentences=300, epochs=10)


def test_crf_gradient_and_best_by_enumeration():
    text = "a b@c.de 1.2.3.4"
    lattice = pii_crf.Lattice(text)
    feats = sorted({f for *_, fs in lattice.segments for f in fs})
    m = pii_crf.Model({f: i for i, f in enumerate(feats)})
    rng = np.random.default_rng(0)
    m.w[:-1], m.t[:] = rng.normal(size=m.w[:-1].shape), rng.normal(size=m.t.shape)
    s = m.scores(lattice)

    def every(at, before):
        if at == lattice.n:
            yield 0.0, []
            return
        for z, rest in every(at + 1, 0):
            yield z + m.t[before, 0], rest
        for x, (i, j, _) in enumerate(lattice.segments):
            if i == at:
                for y in range(1, m.k + 1):
                    for z, rest in every(j, y):
                        yield z + m.t[before, y] + s[x][y - 1], [(i, j, y), *rest]

    text_small = list(every(0, 0))
    best = max(text_small, key=lambda x: x[0])
    assert m.best(lattice) == best[1]
    ll, gw, gt = m.gradient(lattice, best[1])
    assert np.isclose(ll, best[0] - np.logaddexp.reduce([z for z, _ in text_small]))
    for at in [(0, 1), (3, 0), (2, 2)]:
        old = m.t[at]
        m.t[at] = old + 1e-5
        up = m.gradient(lattice, best[1])[0]
        m.t[at] = old
        assert np.isclose((up - ll) / 1e-5, gt[at], atol=1e-3)


def test_crf_held_out(crf):
    rng, ok, gold, said = random.Random(77), 0, 0, 0
    for _ in range(150):
        t, g = pii_crf.sentence(rng)
        e = {(a, b, k) for k, a, b in pii_crf.entities(crf, t)}
        ok, gold, said = ok + len(e & set(g)), gold + len(g), said + len(e)
    assert ok >= 0.95 * gold and ok >= 0.95 * said


def test_stretches_change_nothing(crf):
    rng = random.Random(5)
    for _ in range(6):
        t = "".join(pii_crf.sentence(rng)[0] + " word" * rng.randint(0, 300) for _ in range(4))
        lattice = pii_crf.Lattice(t)
        whole = [(pii_crf.TYPES[y - 1], lattice.start[i], lattice.end[j - 1]) for i, j, y in crf.best(lattice)]
        assert pii_crf.entities(crf, t) == whole


def test_long_spans(crf):
    rng = random.Random(1)
    for n in (158, 161, 200, 400, 5000):
        h = "".join(rng.choice("0123456789abcdef") for _ in range(n))
        t = f'see token = "{h}" and so on'
        assert pii_crf.entities(crf, t) == [("SECRET", 13, 13 + n)]
    mail = "a" * 150 + ".b@mail-host.example.com"
    assert pii_crf.entities(crf, f"write to {mail} now") == [("EMAIL", 9, 9 + len(mail))]


def test_secrets_of_letters(crf):
    t = 'login with password = "CorrectHorseBattery" today'
    assert pii_crf.entities(crf, t) == [("SECRET", 23, 42)]
    assert pii_crf.entities(crf, "the word password has eight letters, and a key: it opens doors") == []


def test_what_is_settled_is_put_out_early(crf, monkeypatch):
    """The same labelling, and the same scores, as by definition; and long runs of digits in memory of what is open."""
    rng = random.Random(6)
    texts = [" ".join(pii_crf.sentence(rng)[0] for _ in range(8)) for _ in range(12)] + ["1 2 3-4 " * 300, "12 " * 500 + "a@b.example.com"]
    whole = [pii_crf.entities(crf, t) for t in texts]
    monkeypatch.setattr(pii_crf, "_OPEN", 7)
    assert [pii_crf.entities(crf, t) for t in texts] == whole and sum(map(len, whole)) > 20
    for t in texts[:3]:
        lattice = pii_crf.Lattice(t)
        slow = {(i, j): s for (i, j, _), s in zip(lattice.segments, crf.scores(lattice))}
        fast = {(i, j): s for i, own in enumerate(crf.scored(lattice)) for j, s in own}
        assert slow.keys() == fast.keys() and all(np.allclose(slow[k], fast[k]) for k in slow)


def test_repeated_rows_and_other_columns(spark, crf):
    rows = [("x", "mail me: jo.doe@host.example", 1)] * 3 + [(None, "mail me: jo.doe@host.example", 2), ("y", None, 3)]
    d = spark.createDataFrame(rows, "doc_id string, text string, start int")
    got = sorted(map(tuple, pii_crf.find_private(d, model=crf).collect()), key=str)
    assert got == sorted([(None, "EMAIL", 9, 28)] + [("x", "EMAIL", 9, 28)] * 3, key=str)


def test_private_data(spark, crf, awkward, nothing):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    found = {}
    for r in pii_crf.find_private(d, model=crf).collect():
        found.setdefault(r.type, set()).add((r.doc_id, r.start, r.end))
    for kind, p in {"EMAIL": r"[\w.]+@[\w.]+\w", "PHONE": r"\+1 \(\d{3}\) 555-\d{4}", "IP": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]\d)", "CARD": r"(?<!\w)\d{16}(?!\w)", "SECRET": r"(?<!\w)(?=[0-9]*[a-fA-F])[0-9a-fA-F]{40}(?!\w)"}.items():
        true = {(i, *m.span()) for i, t in text.items() for m in re.finditer(p, t)}
        assert len(found[kind] & true) >= 0.95 * len(true) and len(found[kind] - true) <= 0.05 * len(true)
    assert pii_crf.find_private(awkward, model=crf).count() == 0
    assert pii_crf.find_private(nothing, model=crf).count() == 0


# Quality


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    active = [[0, 3, 5], [], [8], list(range(9))]
    offsets = np.cumsum([0] + [len(a) for a in active])
    got = m.score(offsets, np.concatenate([np.array(a, np.int64) for a in active]))
    assert np.allclose(got, [quality_fm.pairwise_score(m, a) for a in active])


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (600, 2))
    rows = [np.array([a, 2 + b], np.int64) for a, b in bits]
    y = (bits[:, 0] == bits[:, 1]).astype(float)
    m = quality_fm.fit(rows, y, 4, epochs=60)
    z = m.score(np.arange(0, 1201, 2), np.concatenate(rows))
    assert ((z > 0) == (y > 0)).mean() > 0.95


def test_quality_held_out(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_fm.train(d, l.where("doc_id % 10 < 7"))
    test = d.where("doc_id % 10 >= 7").join(l, "doc_id")
    rows = test.select("quality", "toxic", quality_fm.scored(test, model).alias("s")).collect()
    assert np.mean([(r.s.quality >= model.least_quality) == (r.quality == 1) for r in rows]) > 0.97
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean([r.s.quality >= model.least_quality and r.s.toxicity < model.most_toxicity for r in clean]) > 0.98
    toxic = [r for r in rows if r.toxic == 1]
    assert np.mean([r.s.toxicity >= model.most_toxicity for r in toxic]) > 0.8


def test_quality_cases(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (30, 0, 0), (32, 1, None)], "doc_id long, quality int, toxic int")
    got = quality_fm.classify(awkward, labels)
    assert got.count() == awkward.count() and got.columns == ["doc_id", "quality", "toxicity", "keep"]
    assert quality_fm.accepted(awkward, labels).columns == awkward.columns
    assert quality_fm.accepted(awkward, labels.limit(0)).count() == awkward.count()  # nothing learnt: all pass
    assert quality_fm.classify(nothing, labels).count() == 0
    bare = awkward.select("doc_id", "text")
    assert quality_fm.classify(bare, labels).count() == awkward.count()


# Language model


def _lexicon(texts, own=40):
    (_, h, first), = list(lm_pseudo._words(texts))
    u, n = np.unique(h, return_counts=True)
    order = np.argsort(-n, kind="stable")
    return h, first, lm_pseudo.Lexicon.of(u[order], n[order], float(n.sum()), own, 5)


def test_network_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = lm_pseudo.Net.start(12, 64)
    ctx, h, some = rng.integers(0, 12, (4, 50)), rng.integers(0, 2**63, 50).astype(np.uint64), rng.integers(0, 2**63, 7).astype(np.uint64)
    some[0] = h[3]  # which is no negative of itself

    def loss(net):
        hid = np.tanh(sum(net.e[k].astype(float)[ctx[k]] for k in range(4)) + net.b)
        z = np.concatenate([(hid * net.vectors(h)).sum(1)[:, None], hid @ net.vectors(some).T], 1)
        z[:, 1:][h[:, None] == some] = -80
        return float((np.logaddexp.reduce(z, 1) - z[:, 0]).sum())

    dh, d_own, d_some = lm_pseudo.Trainer(net).gradient(ctx, h, some)
    for at in [(0, 3, 2), (2, 7, 0), (3, 11, 15)]:
        up = lm_pseudo.Net(net.e.astype(float), net.b, net.u.astype(float))
        up.e[at] += 1e-5
        assert np.isclose((loss(up) - loss(lm_pseudo.Net(net.e.astype(float), net.b, net.u.astype(float)))) / 1e-5, dh[ctx[at[0]] == at[1]].sum(0)[at[2]], atol=2e-3)
    a, b = net.places(np.concatenate([h, some]))
    for row in (int(a[4]), int(b[-1])):
        up = lm_pseudo.Net(net.e.astype(float), net.b, net.u.astype(float))
        up.u[row, 1] += 1e-5
        want = np.concatenate([d_own, d_some])[(a == row) | (b == row)].sum(0)[1]
        assert np.isclose((loss(up) - loss(lm_pseudo.Net(net.e.astype(float), net.b, net.u.astype(float)))) / 1e-5, want, atol=2e-3)


def test_windows_by_definition():
    h, first, lex = _lexicon(pa.array(["the cat sat", "", "the", None, "a b c d e f"]), own=3)
    ctx, sym = lm_pseudo.windows(lex, h, first), lex.symbols(h, lex.find(h))
    assert (sym < 3).sum() == 4 and sym.max() < lex.size - 1
    for d in range(5):
        own = sym[first[d] : first[d + 1]]
        for p in range(len(own)):
            for k, off in enumerate(lm_pseudo.PLACES):
                want = own[p + off] if 0 <= p + off < len(own) else lex.size - 1
                assert ctx[k, first[d] + p] == want


def _by_definition(model, counts, text):
    """A document's summed log P(word | both sides), word by word in plain Python."""
    (_, h, first), = list(lm_pseudo._words(pa.array([text])))
    lex, net, words = model.lexicon, model.net, [int(x) for x in h]
    place = {int(w): k for k, w in enumerate(lex.words[: lex.own]) if lex.find(np.array([w]))[0] == k}
    vector = lambda w: net.u[w % (len(net.u) // 2)] + net.u[(w >> 32) % (len(net.u) // 2) + len(net.u) // 2]
    symbol = lambda w: place.get(w, lex.own + (w >> 40) % lex.sharing)
    total = 0.0
    for i, w in enumerate(words):
        x = np.array(net.b, float)
        for k, off in enumerate((-2, -1, 1, 2)):
            x = x + net.e[k][symbol(words[i + off]) if 0 <= i + off < len(words) else lex.size - 1]
        x = np.tanh(x)
        z = sum(q * math.exp(x @ vector(int(s))) for s, q in zip(model.sample.words, model.sample.weights))
        total += math.log(counts.get(w, 1) / lex.total) + x @ vector(w) - math.log(z)
    return len(words), total


def test_lm_scores_by_definition(spark, documents, awkward, nothing, monkeypatch):
    """Every term of every document; also where most words' counts have to be joined."""
    for cache in (lm_pseudo.CACHE, 60):
        monkeypatch.setattr(lm_pseudo, "CACHE", cache)
        monkeypatch.setattr(lm_pseudo, "SYMBOLS", min(cache, 4096))
        model = lm_pseudo.train(documents)
        counts = {r.word % (1 << 64): r.n for r in model.counts.collect()}
        some = documents.where("doc_id % 9 = 0")
        text = {r.doc_id: r.text for r in some.collect()}
        got = lm_pseudo.score(some, model).collect()
        assert len(got) == len(text) > 10
        for r in got:
            n, want = _by_definition(model, counts, text[r.doc_id])
            assert r.n_words == n and abs(r.log_likelihood - want) <= 1e-3 * max(1, n) and (n == 0 or abs(r.mean_log_likelihood - want / n) < 1e-3)
    by = {r.doc_id: r for r in lm_pseudo.score(awkward, model).collect()}
    assert by[32].log_likelihood is None and by[32].n_words == 0 and by[30].log_likelihood == 0 and by[30].mean_log_likelihood is None and by[36].n_words == 0
    assert by[34].n_words == by[38].n_words == 20_000 and by[34].log_likelihood == by[38].log_likelihood and by[35].n_words == 1
    assert lm_pseudo.score(awkward, model).count() == awkward.count()
    assert lm_pseudo.score(nothing, lm_pseudo.train(nothing)).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [{r.doc_id: r.mean_log_likelihood for r in lm_pseudo.score(x, lm_pseudo.train(x)).collect()} for x in (d.repartition(2), d.repartition(40))]
    assert len(got[0]) == d.count() and all(v is None and got[1][i] is None or abs(v - got[1][i]) < 1e-4 for i, v in got[0].items())


def test_both_sides_tell_more_than_none(documents):
    """Held-out documents score above what word frequencies give them, and above their own words shuffled."""
    model = lm_pseudo.train(documents.where("doc_id % 5 <> 0"))
    texts = [r.text for r in documents.where("doc_id % 5 = 0").collect()]
    n, s = lm_pseudo.score_arrays(model, pa.array(texts))
    plain = sum(float(np.sum(np.append(np.log(model.lexicon.counts), 0.0)[model.lexicon.find(h)] - np.log(model.lexicon.total))) for _, h, _ in lm_pseudo._words(pa.array(texts)))
    rng = random.Random(3)
    noise = pa.array([" ".join(rng.sample(w := " ".join(texts).split(), min(len(w), len(t.split())))) for t in texts])
    n2, s2 = lm_pseudo.score_arrays(model, noise)
    assert s.sum() > plain and s.sum() / n.sum() > s2.sum() / n2.sum()


def test_every_word_has_its_own_count(spark, monkeypatch):
    """Words beyond those that travel with the model: scores rise with the count of the word over the corpus."""
    monkeypatch.setattr(lm_pseudo, "CACHE", 60)
    monkeypatch.setattr(lm_pseudo, "known", lambda distinct: (40, 4, 1024))
    common = [f"w{i}th" for i in range(100)]
    rows = [" ".join(common)] * 30 + ["often1xy"] * 8 + ["seldom2xy"]
    model = lm_pseudo.train(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    ask = spark.createDataFrame([(1, "often1xy"), (2, "seldom2xy"), (3, "never3xy"), (4, "often1xy often1xy"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_pseudo.score(ask, model).collect()}
    assert got[1].log_likelihood > got[2].log_likelihood + 1.5 and got[2].log_likelihood > got[3].log_likelihood - 0.5
    assert got[4].n_words == 2 and got[4].mean_log_likelihood > got[2].mean_log_likelihood + 1 and got[5].log_likelihood is None


def test_words_are_told_apart_by_both_sides():
    """Two words of about one count: the own term of each is higher between its neighbours."""
    rng = random.Random(5)
    filler = [f"f{i}q" for i in range(60)]
    side = {"onezz": "left", "twozz": "right"}
    rows = [" ".join([rng.choice(filler), side[w], w, side[w], rng.choice(filler)]) for w in rng.choices(list(side), k=3000)] + [" ".join(filler * 100)] * 20
    h, first, lex = _lexicon(pa.array(rows), own=100)
    sample = lm_pseudo.Sample(lex.words, lex.counts / lex.total)
    t = lm_pseudo.Trainer(lm_pseudo.Net.start(lex.size, 1024), 0.1)
    for _ in range(3):
        for at in range(0, len(first) - 1, 200):
            stop = min(at + 200, len(first) - 1)
            own = h[first[at] : first[stop]]
            t.all(lm_pseudo.windows(lex, own, first[at : stop + 1] - first[at]), own)

    def own(text):
        (_, h, first), = list(lm_pseudo._words(pa.array([text])))
        return (t.net.fit(lm_pseudo.windows(lex, h, first), h, sample) + np.log(lex.counts[lex.find(h)] / lex.total))[2]

    assert own("f1q left onezz left f2q") > own("f1q left twozz left f2q") + 1
    assert own("f1q right twozz right f2q") > own("f1q right onezz right f2q") + 1


def test_priority_sample_stands_for_the_corpus(spark):
    words = [(i * 7919 + 1, 1 + 2000 // (i + 1)) for i in range(6000)]
    counts = spark.createDataFrame(words, "word long, n long")
    lex, _ = lm_pseudo.lexicon(counts)
    s = lm_pseudo.sampled(counts, lex)
    assert len(s.words) == len(set(s.words)) == lm_pseudo.TOP + lm_pseudo.PARTITION and 0.8 < s.weights.sum() < 1.2


def test_probabilities_of_all_words_sum_to_one(documents):
    """Z is of every word of the corpus: at each place their probabilities sum to 1."""
    model = lm_pseudo.train(documents)
    n = {r.word % (1 << 64): r.n for r in model.counts.collect()}
    words = np.array(list(n), np.uint64)
    assert len(words) > 1000 and dict(zip(model.sample.words.tolist(), np.rint(model.sample.weights * model.lexicon.total).astype(int).tolist())) == n
    q = np.array(list(n.values())) / model.lexicon.total
    rng = np.random.default_rng(4)
    for _ in range(5):
        ctx = np.repeat(rng.integers(0, model.lexicon.size, (4, 1)), len(words), 1)
        assert abs((q * np.exp(model.net.fit(ctx, words, model.sample))).sum() - 1) < 1e-4


def test_scores_over_all_words_by_definition(spark, documents, monkeypatch):
    """As test_lm_scores_by_definition, in doubles with Z summed over the counts of the corpus, not over what the model holds."""
    for cache in (lm_pseudo.CACHE, 60):
        monkeypatch.setattr(lm_pseudo, "CACHE", cache)
        monkeypatch.setattr(lm_pseudo, "SYMBOLS", min(cache, 4096))
        model = lm_pseudo.train(documents)
        lex, net = model.lexicon, model.net
        counts = {r.word % (1 << 64): r.n for r in model.counts.collect()}
        v = net.vectors(np.array(list(counts), np.uint64)).astype(float)
        log_q = np.log(np.array(list(counts.values())) / lex.total)
        some = documents.where("doc_id % 9 = 0 and text is not null")
        text = {r.doc_id: r.text for r in some.collect()}
        for r in lm_pseudo.score(some, model).collect():
            want = 0.0
            for _, h, first in lm_pseudo._words(pa.array([text[r.doc_id]])):
                x = np.tanh(sum(net.e[k].astype(float)[c] for k, c in enumerate(lm_pseudo.windows(lex, h, first))) + net.b)
                log_n = np.log([counts.get(w, 1) / lex.total for w in h.tolist()])
                for at in range(0, len(h), 500):
                    y = x[at : at + 500]
                    want += (log_n[at : at + 500] + (y * net.vectors(h[at : at + 500])).sum(1) - np.logaddexp.reduce(y @ v.T + log_q, axis=1)).sum()
            assert abs(r.log_likelihood - want) <= 1e-3 * max(1, r.n_words)


def test_partition_by_definition():
    """Also of one word, of none, of words that share rows, and of vectors whose exponentials exceed single precision."""
    rng = np.random.default_rng(6)
    for words, rows, scale in ((1, 64, 1), (0, 64, 1), (3000, 64, 1), (3000, 4096, 1), (3000, 1024, 100)):
        net = lm_pseudo.Net.start(12, rows)
        net.u *= scale
        s = lm_pseudo.Sample(rng.integers(0, 2**63, words).astype(np.uint64), rng.random(words) / 1000)
        hid = rng.uniform(-1, 1, (2500, 16)).astype(np.float32)
        want = np.logaddexp.reduce(hid.astype(float) @ net.vectors(s.words).astype(float).T + np.log(s.weights), axis=1, initial=-np.inf)
        assert np.allclose(net.partition(s)(hid), want, rtol=1e-5, atol=1e-5)
    assert len(net.partition(s)(hid[:0])) == 0


def test_few_places_are_summed_over_all_words(documents, monkeypatch):
    """Scores take moments of all words for nearly all places, so words times places are summed for few, and log Z is the same."""
    model = lm_pseudo.train(documents)
    asked, partition = [], lm_pseudo.Net.partition

    def counting(net, sample):
        log_z = partition(net, sample)
        return lambda hid: asked.append(len(hid)) or log_z(hid)

    monkeypatch.setattr(lm_pseudo.Net, "partition", counting)
    texts = pa.array([r.text for r in documents.collect()])
    n, _ = lm_pseudo.score_arrays(model, texts)
    assert n.sum() > 10_000 and sum(asked) < n.sum() / 50
    hid = np.concatenate([model.net.hidden(lm_pseudo.windows(model.lexicon, h, first)) for _, h, first in lm_pseudo._words(texts)])[::7]
    z, good = model.near(hid)
    assert good.mean() > 0.98 and np.abs(z - partition(model.net, model.sample)(hid))[good].max() < lm_pseudo.TOLERANCE


def test_places_that_no_centre_is_near_to(spark, documents, monkeypatch):
    """With no error allowed all places are summed over all words, a few hundred at a time, and scores are the same."""
    some = documents.where("doc_id % 9 = 0")
    model = lm_pseudo.train(documents)
    want = {r.doc_id: r for r in lm_pseudo.score(some, model).collect()}
    monkeypatch.setattr(lm_pseudo, "TOLERANCE", 0.0)
    monkeypatch.setattr(lm_pseudo, "FAR", 700)
    strict = lm_pseudo.train(documents)
    assert not strict.near(np.zeros((3, lm_pseudo.HIDDEN), np.float32))[1].any()
    got = lm_pseudo.score(some, strict).collect()
    assert len(got) == len(want) > 10
    for r in got:
        assert r.n_words == want[r.doc_id].n_words and (r.n_words == 0 or abs(r.mean_log_likelihood - want[r.doc_id].mean_log_likelihood) < 2e-5)


def test_equal_places_are_summed_once(spark, monkeypatch):
    """Places with equal contexts that no centre is near to: as many sums as contexts, in one piece."""
    rows = [(i, "one two three four five six seven") for i in range(60)] + [(99, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm_pseudo.train(docs)
    monkeypatch.setattr(lm_pseudo, "FAR", 60)  # of 422 places, 9 differ
    model.near.limits[:] = -np.inf
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, x: sent.append(x) or broadcast(sc, x))
    got = {r.doc_id: r for r in lm_pseudo.score(docs, model).collect()}
    pieces = [x[1] for x in sent if isinstance(x, tuple) and len(x) == 2 and getattr(x[1], "ndim", 0) == 2]
    assert [len(x) for x in pieces] == [9]
    n, want = lm_pseudo.score_arrays(model, pa.array([rows[0][1], rows[-1][1]]))
    assert got[0].n_words == 7 and len({got[i].log_likelihood for i in range(60)}) == 1 and np.allclose([got[0].log_likelihood, got[99].log_likelihood], want, atol=1e-3)


def test_bound_of_the_error_by_definition():
    """Where a place is called near, log Z is within the bound, also for vectors so long that few or no places are."""
    rng = np.random.default_rng(8)
    for words, scale, reach in ((4000, 1, 0.3), (4000, 4, 0.3), (4000, 100, 0.3), (4000, 1, 3.0), (1, 1, 0.3)):
        net = lm_pseudo.Net.start(12, 1024)
        net.u *= scale
        w, share = rng.integers(0, 2**63, words).astype(np.uint64), rng.pareto(1.2, words) + 1
        share /= share.sum()
        v = net.vectors(w)
        middle = share @ v
        centres = rng.uniform(-0.5, 0.5, (9, lm_pseudo.HIDDEN))
        width = 1.0001 * float(np.linalg.norm(v - middle, axis=1).max() + 1e-3) / lm_pseudo.BINS
        sums = sum(lm_pseudo.tilted(v[at : at + 999], share[at : at + 999], centres, middle, width) for at in range(0, words, 999))
        near = lm_pseudo.Near.of(np.eye(lm_pseudo.HIDDEN), centres, middle, width, sums.astype(float))
        hid = np.clip(np.repeat(centres, 200, 0) + rng.normal(0, reach / 4, (1800, lm_pseudo.HIDDEN)), -1, 1).astype(np.float32)
        z, good = near(hid)
        want = np.logaddexp.reduce(hid.astype(float) @ v.T.astype(float) + np.log(share), axis=1)
        assert np.abs(z - want)[good].max(initial=0) < lm_pseudo.TOLERANCE
        assert good.mean() > 0.95 if scale == 1 and reach < 1 else not good.all() or words == 1
    assert len(near(hid[:0])[0]) == 0


def test_bound_by_the_rows_of_both_halves(spark):
    """Places that the bound by lengths leaves to the sum over all words, which takes places times words, are mostly within the bound by rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lm_pseudo.train(docs)
    hid = np.concatenate([model.net.hidden(lm_pseudo.windows(model.lexicon, h, first)) for _, h, first in lm_pseudo._words(pa.array([r.text for r in docs.collect()]))])
    rows, model.near.rows = model.near.rows, None
    far = hid[~model.near(hid)[1]]
    model.near.rows = rows
    z, good = model.near(far)
    assert len(far) > 20 and good.mean() > 0.8
    assert np.abs(z - model.net.partition(model.sample)(far))[good].max() < lm_pseudo.TOLERANCE


def test_the_model_grows_with_the_corpus():
    assert lm_pseudo.known(10**6)[0] > lm_pseudo.SYMBOLS and lm_pseudo.known(10**8)[0] >= 9 * lm_pseudo.known(10**6)[0]
    assert lm_pseudo.groups(10**10) >= 9 * lm_pseudo.groups(10**8)


def test_runs_do_not_depend_on_batches():
    rng = random.Random(2)
    texts = [None if k % 11 == 0 else " ".join(f"{rng.random():.9f}" for _ in range(rng.choice([0, 3, 900]))) for k in range(300)]
    cut = lambda n: [pa.record_batch({"t": pa.array(texts[a : a + n], pa.string())}) for a in range(0, 300, n)]
    whole, parts = list(lm_pseudo._runs(cut(300), 2000)), list(lm_pseudo._runs(cut(7), 2000))
    assert len(whole) > 5 and len(whole) == len(parts) and all((a == c).all() for (a, _), (c, _) in zip(whole, parts))
    assert sum(len(h) for h, _ in whole) == sum(2 * len((t or "").split()) for t in texts)


# BPE


def test_tree_equals_whole_text_encoding(documents):
    whole, rng = bpe.Codec(), random.Random(0)
    parts = ["a", "b", " ", "  ", "\n", "'", "'ll", "'re", "1", "é", "😀", "　", "\x1c", "\t", "!?", "word", "'s x", "\r\n", "\x85", " "]
    texts = [r.text for r in documents.limit(40).collect()] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(400)] + ["x" * 5000, " " * 700, ""]
    for leaf in (1, 5, 64):
        c = bpe.Codec(leaf=leaf)
        for t in texts:
            got = c.encode(t)
            assert np.array_equal(got, whole.piece(t) if t else got) and c.decode(got) == t.encode()


def test_stable_places_in_text_without_blanks():
    """Letters, digits and signs in a row, Chinese and base64 among them: the same tokens, from small windows."""
    rng, whole = random.Random(4), bpe.Codec()
    kinds = ["\u4e2d\u6587\u5b57", "\u3002\uff0c", "abcXYZ", "0189", "+/=-'", "'s", "'ll", "\u0434\u0430", "\u3042\u30a2", "\uac00", "\u00e9", "\u20ac", "\u0661", "\u2167"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(2, 400))) for _ in range(300)]
    texts += ["".join(rng.choice("ABCdef0123456789+/") for _ in range(60_000)), "".join(rng.choice("\u4e2d\u6587\u5b57\u7684\u4e86\u662f\u3002") for _ in range(30_000))]
    for leaf in (1, 7, 512):
        c, seen = bpe.Codec(leaf=leaf), 0
        for t in texts if leaf > 1 else texts[:300]:
            assert np.array_equal(c.encode(t), whole.piece(t))
    c = bpe.Codec(leaf=512)
    encoded, piece = [], c.piece
    c.piece = lambda t: encoded.append(len(t)) or piece(t)
    for t in texts[300:]:
        encoded.clear()
        c.encode(t)
        assert sum(encoded) < 1.6 * len(t)


def test_join_is_associative():
    c, t = bpe.Codec(leaf=10**9), "it's a  test 'll of\n\n joining 123abc  pieces"
    for i in range(1, len(t)):
        for j in range(i + 1, len(t), 5):
            a, b, d = c.piece(t[:i]), c.piece(t[i:j]), c.piece(t[j:])
            left = c.join(t, 0, j, len(t), c.join(t, 0, i, j, a, b), d)
            right = c.join(t, 0, i, len(t), a, c.join(t, i, j, len(t), b, d))
            assert np.array_equal(left, right)


def test_tokenize(awkward, nothing, spark):
    rows = bpe.tokenize(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[32].tokens is None and by[32].n_tokens is None and by[32].round_trip is None
    assert by[30].tokens == [] and by[30].n_tokens == 0 and by[34].round_trip and by[37].round_trip
    assert all(r.round_trip for r in rows if r.tokens is not None)
    back = bpe.tokenize(awkward).select("doc_id", bpe.decoded("tokens").alias("text"))
    assert sorted(map(str, back.collect())) == sorted(map(str, awkward.select("doc_id", "text").collect()))
    assert bpe.tokenize(nothing).count() == 0


# Mixing


def test_quotas():
    assert mixing.quotas([10, 3, 100, 0], [1, 1, 1, 1], 60).tolist() == [10, 3, 47, 0]
    assert mixing.quotas([100, 100], [3, 1], 40).tolist() == [30, 10]
    assert mixing.quotas([5, 5], [0, 0], 4).tolist() == [0, 0]
    assert mixing.quotas([7, 7, 7], [1, 1, 1], 10).sum() == 10
    assert mixing.quotas([2, 9], [5, 0], 10).tolist() == [2, 0]


def test_tree_is_exact_and_hypergeometric():
    q, sizes = np.array([10, 20, 33]), np.array([16, 16, 16, 15])
    some = np.stack([mixing.split(q, sizes, seed) for seed in range(400)])
    assert (some.sum(1) == q).all() and (some.sum(2) == sizes).all()
    n = q.sum()
    var = sizes[0] * q[0] / n * (1 - q[0] / n) * (n - sizes[0]) / (n - 1)
    assert abs(some[:, 0, 0].mean() - sizes[0] * q[0] / n) < 0.3 and abs(some[:, 0, 0].var() / var - 1) < 0.3


def test_large_populations_are_split_exactly():
    q, sizes = np.array([600_000_001, 400_000_001]), np.array([500_000_001, 500_000_001])
    some = np.stack([mixing.split(q, sizes, seed) for seed in range(12)])
    assert (some.sum(2) == sizes).all() and (some.sum(1) == q).all() and len(set(some[:, 0, 0].tolist())) > 8
    big = np.array([3 * 10**10, 10**10, 7])
    got = mixing.split(big, np.array([10**10 + 1, 10**10 - 1, 10**10, 10**10 + 7]))
    assert (got.sum(0) == big).all() and got.sum(1).tolist() == [10**10 + 1, 10**10 - 1, 10**10, 10**10 + 7]


def test_large_draws_have_the_distribution(monkeypatch):
    """The sampler for large populations against numpy's, where both can draw."""
    rng = np.random.default_rng(1)
    for good, bad, n in ((30, 50, 20), (5, 1000, 990), (2000, 3000, 1500)):
        want = rng.hypergeometric(good, bad, n, 4000)
        monkeypatch.setattr(mixing, "_NUMPY", 0)
        got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)])
        assert got.min() >= max(0, n - bad) and got.max() <= min(good, n)
        assert abs(got.mean() - want.mean()) < 5 * want.std() / 60 and abs(got.std() / want.std() - 1) < 0.1
    assert mixing.hypergeometric(rng, 10, 0, 4) == 4 and mixing.hypergeometric(rng, 0, 10, 4) == 0 and mixing.hypergeometric(rng, 5, 5, 0) == 0


def test_placing_by_definition(spark):
    """Blocks and draws again in plain Python: the same rows in the same shards and places."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None])) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = {r.doc_id: (r.shard, r.position) for r in mixing.mix(d, shard_rows=50, block=16).collect()}
    keys = sorted({"-" if s is None else f"+{s}" for _, s in rows})
    have = [sum(("-" if s is None else f"+{s}") == k for _, s in rows) for k in keys]
    q = mixing.quotas(have, [1] * len(keys), int(0.8 * len(rows)))
    shards = -(-int(q.sum()) // 50)
    sizes = np.diff(np.arange(shards + 1) * int(q.sum()) // shards)
    tree = mixing.split(q, sizes)
    hashed = {}
    for r in d.selectExpr("doc_id", "coalesce('+' || source, '-') AS k", f"xxhash64({mixing.SEED}, doc_id, 0L) AS u").selectExpr("*", f"xxhash64({mixing.SEED + 1}, u) AS b").collect():
        hashed[r.doc_id] = r
    order = {(r.k, r.b): r.h for r in spark.createDataFrame([(k, b) for k in keys for b in range(64)], "k string, b long").selectExpr("k", "b", f"xxhash64({mixing.SEED}, k, b) AS h").collect()}
    want = {}
    for s, k in enumerate(keys):
        blocks = max(1, -(-have[s] // 16))
        mine = sorted((r for r in hashed.values() if r.k == k), key=lambda r: (order[k, r.b % blocks], r.b % blocks, r.u, r.doc_id))
        cuts = np.cumsum(tree[:, s])
        for rank, r in enumerate(mine[: int(q[s])]):
            want[r.doc_id] = int(np.searchsorted(cuts, rank, "right"))
    assert {i: s for i, (s, _) in got.items()} == want
    for s in range(shards):
        assert sorted(p for t, p in got.values() if t == s) == list(range(int(sizes[s])))


def test_mix(documents, awkward, nothing):
    got = mixing.mix(documents, shard_rows=30, block=8).collect()
    n = documents.count()
    assert len(got) == int(0.8 * n) == len({r.doc_id for r in got})
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    by = {}
    for r in documents.collect():
        by[r.source] = by.get(r.source, 0) + 1
    want = mixing.quotas(list(by.values()), [1] * len(by), int(0.8 * n))
    for s, w in zip(by, want):
        assert abs(sum(r.source == s for r in got) - w) <= 1
    assert sorted(map(tuple, mixing.mix(documents, shard_rows=30, block=8).collect())) == sorted(map(tuple, got))
    m = mixing.mixed(awkward)
    assert m.columns == awkward.columns and m.count() == int(0.8 * awkward.count())
    assert mixing.mix(awkward, share=1.0).count() == awkward.count()
    assert {r.source for r in mixing.mix(awkward, weights={None: 1}, share=1.0).collect()} == {None}
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
