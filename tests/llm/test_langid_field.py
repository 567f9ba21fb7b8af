"""The field's marginals by enumeration, letters by Unicode class, labels of words, and the toxic label model by rows."""

import itertools
import random

import numpy as np

from tessera.llm import langid, toxicity


def test_pair_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    lengths, k = np.array([4, 1, 3]), 3
    e, trans = rng.random((8, k)) + 0.1, rng.random((k, k)) + 0.1
    alpha, beta = langid.messages(e, lengths, trans)
    start = 0
    for n in lengths.tolist():
        want, total = np.zeros((max(0, n - 1), k, k)), 0.0
        for ys in itertools.product(range(k), repeat=n):
            p = np.prod([e[start + t, y] for t, y in enumerate(ys)]) * np.prod([trans[a, b] for a, b in zip(ys, ys[1:])])
            total += p
            for t in range(n - 1):
                want[t, ys[t], ys[t + 1]] += p
        if n > 1:
            got = langid.pair_marginals(alpha, beta, e, trans, np.arange(start, start + n - 1))
            assert np.allclose(got, want / total)
        start += n


def test_letters_are_unicode_letters(spark):
    rows = [(1, "²½Ⅷ①"), (2, "123 _ !"), (3, None), (4, ""), (5, "abc² def"), (6, "日本語"), (None, "abc")]
    train = [(100 + i, ("abc bcd cab " if i % 2 else "xyz zyx yzx ") * 9, "en" if i % 2 else "de") for i in range(40)]
    model = langid.train(spark.createDataFrame(train, "id long, text string, lang string"))
    df = spark.createDataFrame([(*r, "x", 0.5, "y") for r in rows], "id long, text string, lang_pred string, score double, words string")
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert {i for i, (lang, _) in got.items() if lang == "und"} == {1, 2, 3, 4} and got[5][0] == got[None][0] == "en"
    assert all(s == 0 for i, (_, s) in got.items() if i in (1, 2, 3, 4))


def test_words_are_labelled_one_by_one(spark):
    rng = random.Random(4)
    one, two = (["".join(rng.choice(letters) for _ in range(5)) for _ in range(80)] for letters in ("abcdefgh", "mnopqrst"))
    say = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    train = [(i, say(one if i % 2 else two, 60), "en" if i % 2 else "de") for i in range(80)]
    model = langid.train(spark.createDataFrame(train, "id long, text string, lang string"))
    mixed = say(one, 12) + " 7 " + say(two, 12)
    df = spark.createDataFrame([(1, mixed), (2, None), (3, "x" * 300_000)], "id long, text string")
    got = {r.id: r.words for r in langid.label_words(df, model).collect()}
    assert [w.lang for w in got[1]] == ["en"] * 12 + ["de"] * 12 and got[2] == [] and len(got[3]) == 1
    assert [mixed[w.start : w.stop] for w in got[1]] == mixed.replace(" 7 ", " ").split()


def slow_label_model(rows, gold, prior, rounds):
    """Posteriors of rows (tuples of votes), one row at a time, before voters' correlations are looked at."""
    votes = (toxicity.CLEAN, toxicity.TOXIC, toxicity.NONE)
    start = ((0.6, 0.1, 0.3), (0.2, 0.5, 0.3))
    post = [0.95 if g == 1 else 0.05 if g == 0 else 0.8 if toxicity.TOXIC in r else prior / 2 for r, g in zip(rows, gold)]
    for _ in range(rounds):
        rate = {}
        for j in range(len(rows[0])):
            for c in (0, 1):
                n = [sum((p if c else 1 - p) for r, p in zip(rows, post) if r[j] == v) + 0.5 * start[c][i] for i, v in enumerate(votes)]
                rate.update({(j, c, v): x / sum(n) for v, x in zip(votes, n)})
        pi = min(0.5, max(1e-4, sum(post) / len(post)))
        odds = [np.log(pi / (1 - pi)) + (np.log(19) if g == 1 else -np.log(19) if g == 0 else 0) + sum(np.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in enumerate(r)) for r, g in zip(rows, gold)]
        post = [1 / (1 + np.exp(-max(-30, min(30, z)))) for z in odds]
    return post


def test_toxic_label_model_equals_a_slow_version():
    rng = random.Random(6)
    kinds = [tuple(rng.choice((0, 1, 2, 2)) for _ in range(5)) for _ in range(12)]
    rows = [rng.choice(kinds) for _ in range(300)]
    gold = [rng.choice((-1, -1, 0, 1)) for _ in rows]
    keys = sorted(set(zip(rows, gold)))
    weight = np.array([sum(1 for x in zip(rows, gold) if x == k) for k in keys], float)
    post, _, _ = toxicity.label_model(np.array([k[0] for k in keys]), weight, np.array([k[1] for k in keys]), 0.1, rounds=5)
    fast = dict(zip(keys, post))
    assert all(abs(fast[k] - p) < 1e-8 for k, p in zip(zip(rows, gold), slow_label_model(rows, gold, 0.1, 5)))
