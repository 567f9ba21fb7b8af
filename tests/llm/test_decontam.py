"""Retrieval of benchmark items: against brute force, at all word frequencies, and what the latent space contributes."""

import math
import random

import numpy as np
import pytest

from tessera.llm import decontam as D


def fitted(items_words, texts, least=8, y=None):
    items = D.Items([(i, " ".join(ws)) for i, ws in enumerate(items_words)], least)
    d = len(items.vocab)
    omega, df, total, sketch = D.random_matrix(d, 11), np.zeros(d, np.int64), 0, np.zeros((d, D.RANK))
    for ids, first, lengths, _ in D.stretches(items, texts):
        starts, _ = D.blocks(first, lengths)
        w, block = D.known_words(ids, starts)
        df += np.bincount(w, minlength=d)
        u, total = D.sums(omega[w], block, len(starts)), total + len(starts)
        np.add.at(sketch, w, u[block])
    return items, D.Space(items, total, df, sketch if y is None else y(sketch))


def slow(items, space, texts, overlap=0.8, paraphrase=0.6):
    out = set()
    for t, text in enumerate(texts):
        ids = items.number(D.words_of(text)).tolist()
        for k, own in enumerate(items.words):
            n = len(own)
            if items.exact[k]:
                if any(ids[j : j + n] == own for j in range(len(ids) - n + 1)):
                    out.add((t, items.ids[k]))
                continue
            need, rare = math.ceil(paraphrase * n - 1e-9), space.rare[k]
            for j in range(max(1, len(ids) - 2 * n + 1)):
                part = ids[j : j + 2 * n]
                if sum(w in set(own) for w in part) >= need:
                    c = D.lcs(own, part)
                    if c >= overlap * n - 1e-9 or (c >= paraphrase * n - 1e-9 and len(rare & set(part)) >= 0.8 * len(rare)):
                        out.add((t, items.ids[k]))
                        break
    return out


def corpus(rng, n_words=1500, n_items=25, n_texts=120, lengths=(9, 14, 20, 33, 50, 64)):
    words = ["w%d" % int(n_words * rng.random() ** 2) for _ in range(20_000)]  # some are common
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(rng.choice(lengths)) for _ in range(n_items)]
    texts = [" ".join(say(rng.randint(5, 300))) for _ in range(n_texts)]
    return say, items, texts


def test_matches_equal_brute_force_but_for_few_paraphrases():
    rng = random.Random(21)
    say, items_words, texts = corpus(rng)
    for ws in items_words:
        for share in (0.0, 0.1, 0.2, 0.3, 0.4):
            x = [say(1)[0] if rng.random() < share else w for w in ws]
            texts.append(" ".join([*say(rng.randint(0, 90)), *x, *say(rng.randint(0, 90))]))
    items, space = fitted(items_words, texts)
    want = slow(items, space, texts)
    got = set(D.found_in(items, space, texts, 0.8, 0.6))
    assert got <= want and len(want) > 80
    assert len(got) >= 0.9 * len(want)
    exact = {(t, i) for t, text in enumerate(texts) for i, ws in enumerate(items_words) if f" {' '.join(ws)} " in f" {text} "}
    assert exact <= got


@pytest.mark.parametrize("share", [0.0001, 0.001, 0.01, 0.1, 0.3])
def test_verbatim_items_are_found_at_every_word_frequency(share):
    rng = random.Random(22)
    common = ["c%d" % i for i in range(40)]
    items_words = [[rng.choice(common) for _ in range(n)] for n in [*range(1, 9), 12, 20, 33, 64]]
    per_block = share * D.BLOCK  # each common word stands in about this share of blocks
    texts = [" ".join(rng.choice(common) if rng.random() < per_block * 5 else "x%d" % rng.randrange(9999) for _ in range(400)) for _ in range(60)]
    planted = {}
    for i, ws in enumerate(items_words):
        planted[len(texts)] = i
        texts.append(" ".join(["before"] * 33 + ws + ["after"] * 31))
    items, space = fitted(items_words, texts)
    got = set(D.found_in(items, space, texts, 0.8, 0.6))
    assert {(t, i) for t, i in planted.items()} <= got
    assert {k for k in got if items.exact[items.ids.index(k[1])]} == {k for k in slow(items, space, texts) if items.exact[items.ids.index(k[1])]}


def test_the_corpus_makes_the_space():
    rng = random.Random(23)
    say, items_words, texts = corpus(rng)
    for ws in items_words:
        x = [say(1)[0] if rng.random() < 0.35 else w for w in ws]
        texts.append(" ".join([*say(30), *x, *say(30)]))

    def found(y):
        items, space = fitted(items_words, texts, y=y)
        return {(int(doc[t]), i, a) for ids, first, lengths, doc in D.stretches(items, texts) for t, i, a, _, _ in D.candidates(items, space, ids, first, lengths, 0.6)}

    own = found(None)
    other = np.random.default_rng(3)
    assert own and found(lambda y: np.zeros_like(y)) == set()
    assert found(lambda y: y[other.permutation(len(y))]) != own


def test_singular_values_are_those_of_the_matrix():
    rng = np.random.default_rng(4)
    c = rng.poisson(0.3, (500, 40)).astype(float)
    idf = rng.random(40) + 0.5
    vectors, values = D.singular_vectors(idf, c.T @ c @ D.random_matrix(40, 11).astype(float))
    want = np.linalg.svd(c * idf, compute_uv=False)
    assert np.allclose(values, want[: len(values)], rtol=1e-3) and len(values) == 40
    assert np.allclose(vectors.T @ vectors, np.eye(40), atol=1e-6)


def test_very_long_texts_are_searched_by_stretches(monkeypatch):
    rng = random.Random(24)
    say, items_words, _ = corpus(rng)
    text = " ".join(w for ws in items_words for w in [*say(400), *ws])
    items, space = fitted(items_words, [text, None, ""])
    whole = set(D.found_in(items, space, [text, None, ""], 0.8, 0.6))
    assert {i for _, i in whole} == set(range(len(items_words)))
    monkeypatch.setattr(D, "STRETCH", 256)
    assert set(D.found_in(items, space, [text, None, ""], 0.8, 0.6)) == whole
