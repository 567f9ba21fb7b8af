"""Language identification with a linear-chain conditional random field over words.

Each word has affixes, character n-grams and itself (the lexicon) as features, hashed; weights for features
and for transitions between languages are learned by gradient steps on the conditional likelihood of word
sequences, some of which switch language half way. The forward-backward algorithm gives each word of a text
its probabilities, so code-switched text is labelled word by word; a text's language is the one with most
expected words.

The field is fitted on the whole texts of about `max_docs` rows of each language, chosen by a hash of the id. Every text
is then labelled as a whole; label_words gives each word's language.

Defined results: `und` and score 0 for a text that is null or has no letter (Unicode's letters; digits of any kind, Roman numerals and
fractions are none), and for any text if there is
nothing to learn from; repeated rows are labelled alike; rows with a null id are labelled but not learned
from; very long texts and words are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.toxicity import fold
from tessera.session import prepare, stored, table

BUCKETS = 1 << 16
STRETCH = 12
#: Words whose scores a worker keeps; words read together.
CACHE, TOGETHER = 400_000, 2_000_000


WORD = re.compile(r"[^\W\d_]+")


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def numerals(last: int) -> re.Pattern:
    """What WORD takes up to a code point though it isn't of a letter class: numerals of other kinds."""
    return re.compile("[" + "".join(c for c in map(chr, range(128, last + 1)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L") + "]")


def plain(text: str) -> str:
    """The text with blanks for what only looks like letters."""
    if text.isascii():
        return text
    return numerals(sys.maxunicode if ASTRAL.search(text) else 0xFFFF).sub(" ", text)  # a class within 16 bits is one look-up


def features(word: str) -> list[int]:
    """Hashed affixes, n-grams and the word itself."""
    w = f"^{word}$"
    n = len(w)
    out = [w, "p" + w[:3], "p" + w[:4], "s" + w[-3:], "s" + w[-4:], *(w[i : i + 2] for i in range(n - 1)), *(w[i : i + 3] for i in range(n - 2))]
    return [zlib.crc32(x.encode()) % BUCKETS for x in out]


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The summed weights of each word's features."""
    got = [features(w) for w in words]
    if not got:
        return np.zeros((0, weights.shape[1]), np.float32)
    at = np.cumsum([0, *map(len, got)])[:-1]
    return np.add.reduceat(weights[np.concatenate([np.array(g) for g in got])], at, axis=0)


def forward_backward(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each word's label probabilities; e: exponentiated emissions of sequences one after another."""
    alpha, beta = messages(e, lengths, trans)
    alpha *= beta
    return alpha / alpha.sum(axis=1, keepdims=True)


def pair_marginals(alpha: np.ndarray, beta: np.ndarray, e: np.ndarray, trans: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probabilities of the labels of words at and at + 1 together."""
    p = alpha[at][:, :, None] * trans[None] * (e[at + 1] * beta[at + 1])[:, None, :]
    return p / p.sum(axis=(1, 2), keepdims=True)


def messages(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's forward and backward messages, at a sum of one.

    All sequences step together, the longest first in line, so that a step is one operation on those still going."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = None
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    for t in range(longest):
        k = alive[t]
        at = start[:k] + t
        a = e[at] if a is None else (a[:k] @ trans) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    end, b = start + size - 1, None
    back = trans.T.copy()
    for t in range(longest):
        k = alive[t]
        at = end[:k] - t
        if b is None:
            b = np.ones((k, e.shape[1]), e.dtype)
        else:
            b = (b[:k] * e[at + 1]) @ back
            b /= b.sum(axis=1, keepdims=True)
        beta[at] = b
    return alpha, beta


def fit(chunks: list[tuple[int, list[str]]], n_labels: int, epochs: int = 4, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and log transitions from stretches of words of one label; every other sequence joins two."""
    rng = np.random.default_rng(7)
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in chunks for w in ws))}
    feats = [np.unique(features(w)) for w in vocab]
    flat, sizes = np.concatenate(feats), np.array([len(f) for f in feats])
    first = np.cumsum(sizes) - sizes
    weights, trans = np.zeros((BUCKETS, n_labels)), np.zeros((n_labels, n_labels))
    gw, gt = np.full_like(weights, 1e-2), np.full_like(trans, 1e-2)
    chunks = [(y, [vocab[w] for w in ws]) for y, ws in chunks]
    for _ in range(epochs):
        order = rng.permutation(len(chunks))
        seqs, i = [], 0
        while i < len(order):
            step = 2 if len(seqs) % 2 and i + 1 < len(order) else 1
            part = [chunks[j] for j in order[i : i + step]]
            seqs.append(([w for _, ws in part for w in ws], [y for y, ws in part for _ in ws]))
            i += step
        for at in range(0, len(seqs), batch):
            group = seqs[at : at + batch]
            ids, ys = (np.array([x for s in group for x in s[c]]) for c in (0, 1))
            lengths = np.array([len(s[0]) for s in group])
            used, place = np.unique(ids, return_inverse=True)
            idx = np.concatenate([flat[first[u] : first[u] + sizes[u]] for u in used])
            cut = np.cumsum(sizes[used]) - sizes[used]
            em = np.add.reduceat(weights[idx], cut, axis=0)[place]
            e = np.exp(em - em.max(axis=1, keepdims=True))
            alpha, beta = messages(e, lengths, np.exp(trans))
            post = alpha * beta
            post /= post.sum(axis=1, keepdims=True)
            err = post.copy()
            err[np.arange(len(ys)), ys] -= 1
            inner = np.ones(len(ys), bool)
            inner[np.cumsum(lengths) - 1] = False
            l = np.flatnonzero(inner)  # noqa: E741
            pair = pair_marginals(alpha, beta, e, np.exp(trans), l)
            g = pair.sum(axis=0)
            np.add.at(g, (ys[l], ys[l + 1]), -1)
            gt += g * g
            trans -= 0.2 * g / np.sqrt(gt)
            per_word = np.zeros((len(used), n_labels))
            np.add.at(per_word, place, err)
            hit, where = np.unique(idx, return_inverse=True)
            grad = np.zeros((len(hit), n_labels))
            np.add.at(grad, where, np.repeat(per_word, sizes[used], axis=0))
            grad += 1e-3 * weights[hit]
            gw[hit] += grad * grad
            weights[hit] -= 0.2 * grad / np.sqrt(gw[hit])
    return weights.astype(np.float32), np.clip(trans, -4, 4).astype(np.float32)


def train(docs: DataFrame, max_docs: int = 60) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """The labels and the fitted field, from rows (id, text, lang)."""
    docs = docs.filter("id is not null and text is not null and lang is not null")
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(math.ceil((1 << 62) * min(1, max_docs / n))))])
    picked = docs.filter(F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(1 << 62)) < share[F.col("lang")])
    langs = sorted(counts)

    def run(batches):
        for b in batches:
            y, ws = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORD.findall(plain(text.lower()))
                for i in range(0, len(words), STRETCH):
                    y.append(lang), ws.append(words[i : i + STRETCH])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(ws, pa.list_(pa.string()))], names=["lang", "words"])

    rows = picked.select("lang", "text").mapInArrow(run, "lang string, words array<string>").collect()
    if not rows:
        return None
    chunks = sorted((langs.index(r.lang), list(r.words)) for r in rows)
    return (langs, *fit(chunks, len(langs)))


class Labeller:
    """Word probabilities of texts under a fitted field; keeps the scores of words it has seen."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans, self.ids = weights, np.exp(trans), {}
        self.table = np.zeros((1 << 12, weights.shape[1]), np.float32)

    def number(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        new = list({w for w in words if w not in ids})
        if new:
            n = len(ids)
            e = emissions(new, self.weights)
            e = np.exp(e - e.max(axis=1, keepdims=True))
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = np.maximum(e, 1e-12)
            ids.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))

    def forget(self) -> None:
        if len(self.ids) > CACHE:
            self.ids.clear()

    def probabilities(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return forward_backward(self.table[ids], lengths, self.trans)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(id, lang_pred, score) of rows (id, text)."""
    langs = model[0]
    sent = docs.sparkSession.sparkContext.broadcast(model[1:])  # as large as the feature buckets
    id_type = docs.schema["id"].dataType.simpleString()

    def settle(lab, ids, numbers, lengths):
        lengths = np.array(lengths, np.int64)
        some = lengths > 0
        name, score = np.full(len(lengths), len(langs)), np.zeros(len(lengths))
        if some.any():
            p = lab.probabilities(np.concatenate(numbers), lengths[some])
            at = np.cumsum(lengths[some]) - lengths[some]
            mean = np.add.reduceat(p.astype(np.float64), at, axis=0) / lengths[some][:, None]
            name[some], score[some] = mean.argmax(axis=1), np.minimum(mean.max(axis=1), 1.0)
        lab.forget()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([*langs, "und"], pa.string()).take(pa.array(name)), pa.array(score)], names=["id", "lang_pred", "score"])

    def run(batches):
        lab, ids, numbers, lengths, held = Labeller(*sent.value), [], [], [], 0
        for b in batches:
            words: list[str] = []
            for t in b.column(1).to_pylist():
                ws = WORD.findall(plain(t.lower())) if t else []
                lengths.append(len(ws))
                words += ws
            ids.append(b.column(0))
            numbers.append(lab.number(words))
            held += len(words)
            if held >= TOGETHER:
                yield settle(lab, ids, numbers, lengths)
                ids, numbers, lengths, held = [], [], [], 0
        if ids:
            yield settle(lab, ids, numbers, lengths)

    return docs.select("id", "text").mapInArrow(run, f"id {id_type}, lang_pred string, score double")


def label_words(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(id, words) of rows (id, text): each word's first and last place (end exclusive), language and probability."""
    langs, sent = model[0], docs.sparkSession.sparkContext.broadcast(model[1:])
    id_type = docs.schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string()), ("prob", pa.float64())]))

    def run(batches):
        lab = Labeller(*sent.value)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                found = list(WORD.finditer(plain(t))) if t else []
                if not found:
                    out.append([])
                    continue
                p = lab.probabilities(lab.number([m.group().lower() for m in found]), np.array([len(found)])).astype(np.float64)
                out.append([{"start": m.start(), "stop": m.end(), "lang": langs[i], "prob": min(1.0, q)} for m, i, q in zip(found, p.argmax(axis=1).tolist(), p.max(axis=1).tolist())])
                lab.forget()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["id", "words"])

    return docs.select("id", "text").mapInArrow(run, f"id {id_type}, words array<struct<start:long,stop:long,lang:string,prob:double>>")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    model = train(docs.filter(fold("id", 4) != 2))
    if model is None:
        found = docs.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        found = predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
