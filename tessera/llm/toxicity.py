"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

Voters are word lists (three written here, four mined from labelled rows) and patterns. One pass over the
whole texts leaves each row's votes and the listed words it holds. Expectation-maximisation over the counts
of vote patterns of all rows estimates each voter's rates of voting toxic, clean or nothing for either class;
voters that agree more than their rates explain, given the class, form cliques whose evidence is shared out
among them. Known labels take part as one more voter of the rows that may be learned from. A logistic
regression over listed words, patterns and counts then learns the posterior labels, and scores every row.

The word statistics and the regression are fitted on samples of about `max_labelled` and `max_fitted` rows,
chosen by a hash of the id; the label model uses all rows. Of labelled rows that begin alike or end alike (40 characters) one counts when
words are mined: copies of a toxic text are one piece of evidence. All words that pass are kept.

Defined results: null and empty texts get the score of a text without any listed word; no labelled rows at
all leave the written lists and a class share of 0.05; repeated rows are scored alike; rows with a null id
are scored; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import held, prepare, stored, table

LISTS = {
    "insult": "idiot idiots moron morons imbecile fool dumb stupid dimwit halfwit blockhead idiota imbécile crétin dummkopf trottel estúpido tonto".split(),
    "contempt": "trash garbage scum filth vermin parasite loser losers clown clowns abschaum ordure basura escoria payaso".split(),
    "disgust": "pathetic worthless disgusting useless despicable repulsive wertlos ekelhaft dégoûtant pitoyable patético asqueroso".split(),
}
MINED_VOTERS = 4
#: Letters of the word beginnings that may be mined.
STARTS = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"[^\W\d_]{3,}")
CENSORED = re.compile(r"\b[^\W\d_]\*{2,}[^\W\d_]*")
ADDRESS = re.compile(r"\b(?:you|your|youre|u|tu|du|dich|eres|vous)\b", re.I)
BANGS = re.compile(r"!{3,}")
PATTERNS = ("several", "addressed", "shouting", "censored", "bangs")
#: Votes: toxic, clean, none.
TOXIC, CLEAN, NONE = 1, 0, 2


def longer(n: int):
    return lambda w: F.length(w) > n


def start(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def mine(labelled: DataFrame, least: int = 5) -> list[str]:
    """Words, and word beginnings (with a star), that mark toxic rows: seen in at least `least`
    of them, rarely in clean ones, and with log odds well above their error.

    Toxic rows that open or end alike count once, so that copies of one text don't make its words look like markers."""
    words = F.array_distinct(F.expr("regexp_extract_all(lower(text), '\\\\p{L}+', 0)"))
    starts = [F.transform(F.filter(words, longer(n)), start(n)) for n in STARTS]
    units = F.explode(F.concat(words, *map(F.array_distinct, starts))).alias("unit")
    ends = [F.xxhash64(x) for x in (F.substring("text", 1, 40), F.expr("right(text, 40)"))]
    toxic = labelled.filter("toxic = 1").select(ends[0].alias("head"), ends[1].alias("tail"), "text")
    n = toxic.agg(F.count_distinct("head"), F.count_distinct("tail")).first()
    nt, nc = min(n[0], n[1]), labelled.filter("toxic = 0").count()
    if not nt or not nc:
        return []
    t = toxic.select("head", "tail", units).groupBy("unit").agg(F.least(F.count_distinct("head"), F.count_distinct("tail")).alias("t")).filter(f"t >= {least}")
    c = labelled.filter("toxic = 0").select(units).groupBy("unit").agg(F.count("*").alias("c"))
    both = t.join(c, "unit", "left").select("unit", "t", F.coalesce("c", F.lit(0)).alias("c")).filter("t >= 15 * c")
    odds = F.log((F.col("t") + 0.5) / (nt - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (nc - F.col("c") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    kept = both.withColumn("z", odds / error).filter("z > 2")
    found, begun = [], set()  # as many as the sample of labelled rows has
    for u in sorted((r.unit for r in kept.collect()), key=lambda u: (len(u.rstrip("*")), not u.endswith("*"), u)):
        if not any(u[:n] in begun for n in STARTS if len(u.rstrip("*")) > n):  # a beginning stands for all that goes on from it
            found.append(u)
            if u.endswith("*"):
                begun.add(u[:-1])
    return found


def lists_of(mined: list[str]) -> dict[str, list[str]]:
    known = {w for ws in LISTS.values() for w in ws}
    new = [w for w in mined if w not in known]
    return LISTS | {f"mined{i}": new[i::MINED_VOTERS] for i in range(MINED_VOTERS)}


def reader(lists: dict[str, list[str]]) -> tuple[list[str], list[str], Callable[[str], tuple[list[int], list[int]]]]:
    """The voters' and features' names, and what gives a text's votes and the features that it has."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lists.values() for w in ws))}
    list_of = {w: {j for j, ws in enumerate(lists.values()) if w in set(ws)} for w in vocabulary}
    names, features = [*lists, *PATTERNS], [*vocabulary, *PATTERNS]
    base, nl, starts = len(vocabulary), len(lists), {n: {w[:-1] for w in vocabulary if w.endswith("*") and len(w) == n + 1} for n in STARTS}

    def read(text: str) -> tuple[list[int], list[int]]:
        words = WORD.findall(text.lower())
        distinct = set(words)
        hits = {w for w in distinct if w in vocabulary}
        begun = {n: {w[:n] for w in distinct if len(w) > n} & ws for n, ws in starts.items()}
        hits |= {w + "*" for ws in begun.values() for w in ws}
        votes = [NONE] * len(names)
        found = sorted(vocabulary[w] for w in hits)
        for w in hits:
            for j in list_of[w]:
                votes[j] = TOXIC
        count = sum(w in hits or any(w[:n] in ws and len(w) > n for n, ws in begun.items()) for w in words) if hits else 0
        flags = [count >= 2, bool(hits) and bool(ADDRESS.search(text)), False, "**" in text and bool(CENSORED.search(text)), "!!!" in text]
        if text.isupper() or hits:
            shouted = [w for w in SHOUT.findall(text) if w.isupper()]
            flags[2] = len(shouted) > 0.3 * max(1, len(words))
        for i, on in enumerate(flags):
            if on:
                votes[nl + i] = TOXIC
                found.append(base + i)
        if len(words) >= 5 and not hits:  # enough read, and nothing listed in it
            for j in range(nl):
                votes[j] = CLEAN
        return votes, found

    return names, features, read


def label_model(patterns: np.ndarray, weight: np.ndarray, gold: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each vote pattern (rows x voters), the rates [voter, class, vote] and each voter's share.

    gold: 1 or 0 where a label is known, else -1; it counts as a voter of fixed accuracy."""
    n, m = patterns.shape
    toxic = (patterns == TOXIC).any(axis=1)
    post = np.where(gold >= 0, np.where(gold == 1, 0.95, 0.05), np.where(toxic, 0.8, prior / 2))
    said = np.stack([patterns == v for v in (CLEAN, TOXIC, NONE)], axis=2).astype(float)  # rows, voters, votes
    share = np.ones(m)
    gold_odds = np.where(gold == 1, np.log(19.0), np.where(gold == 0, -np.log(19.0), 0.0))
    for step in range(rounds):
        mass = np.stack([weight * (1 - post), weight * post])
        rates = np.einsum("cr,rmv->mcv", mass, said) + 0.5 * np.array([[0.6, 0.1, 0.3], [0.2, 0.5, 0.3]])
        rates /= rates.sum(axis=2, keepdims=True)
        if step in (5, 20):  # correlations: what two voters share beyond what the class explains
            resid = (said - np.einsum("cr,mcv->rmv", np.stack([1 - post, post]), rates)).reshape(n, -1)
            cov = (resid * weight[:, None]).T @ resid / weight.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr = np.abs(cov / sd[:, None] / sd[None, :]).reshape(m, 3, m, 3).max(axis=(1, 3))
            np.fill_diagonal(corr, 1)
            share = 1 / np.where(corr > 0.3, corr, 0).sum(axis=1)
        odds = np.log(rates[:, 1] / rates[:, 0])  # voters, votes
        pi = np.clip((weight * post).sum() / weight.sum(), 1e-4, 0.5)
        new = 1 / (1 + np.exp(-np.clip(np.log(pi / (1 - pi)) + gold_odds + np.einsum("rmv,mv->r", said, odds * share[:, None]), -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, rates, share


def fit_linear(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, n: int, rounds: int = 25, ridge: float = 0.5) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression over sets of features, by Newton steps."""
    penalty = np.full(n + 1, ridge)
    penalty[n] = 1e-6
    w = np.zeros(n + 1)
    w[n] = np.log((target @ weight + 1) / ((1 - target) @ weight + 1))

    def parts():  # a dense matrix of some rows at a time
        for at in range(0, len(rows), 1000):
            x = np.zeros((len(rows[at : at + 1000]), n + 1))
            x[:, n] = 1
            for i, fs in enumerate(rows[at : at + 1000]):
                x[i, fs] = 1
            yield x, target[at : at + 1000], weight[at : at + 1000]

    for _ in range(rounds):
        grad, curve = penalty * w, np.diag(penalty)
        for x, t, v in parts():
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = grad + x.T @ ((p - t) * v)
            curve = curve + (x * (v * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        step = np.linalg.solve(curve, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    return w


def part_of(df: DataFrame, n: int, most: int, id_col: str = "id") -> DataFrame:
    """About `most` of n rows, the same ones each time."""
    return df if n <= most else df.filter(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 62)) < math.ceil((1 << 62) * most / n))


class Model:
    """A fitted classifier: the lists that texts are read by, and the weights of what is found."""

    def __init__(self, lists: dict[str, list[str]], weights: np.ndarray):
        self.lists, self.weights = lists, weights

    def scorer(self) -> Callable[[str | None], float]:
        _, _, read = reader(self.lists)
        w, bias = self.weights[:-1].tolist(), float(self.weights[-1])

        def one(text: str | None) -> float:
            z = bias + sum(w[i] for i in read(text or "")[1])
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

        return one


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = 20_000, max_fitted: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and a stored table (id, found) of what each row holds. labelled has (id, toxic 0/1) of the rows
    that may be learned from."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gold = labelled.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    gold = stored(gold, "toxic-labels")
    picked = part_of(gold, gold.count(), max_labelled)
    sample = stored(docs.join(F.broadcast(picked), "id"), "toxic-sample")  # max_labelled rows bound what is broadcast
    lists = lists_of(mine(sample))
    names, features, read = reader(lists)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        held("toxicity")
        for b in batches:
            got = [read(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(map(str, v)) for v, _ in got], pa.string()), pa.array([f for _, f in got], pa.list_(pa.int32()))], names=["id", "votes", "found"])

    rows = stored(docs.mapInArrow(run, f"id {id_type}, votes string, found array<int>"), "toxic-votes")
    # votes of all rows: as many groups as there are vote patterns, whatever the input
    known = rows.join(gold, "id", "left").withColumn("gold", F.coalesce("toxic", F.lit(-1)))
    distinct = stored(known.groupBy("votes", "found", "gold").agg(F.count("*").alias("n")), "toxic-patterns")
    counted = {(r.votes, r.gold): r.n for r in distinct.groupBy("votes", "gold").agg(F.sum("n").alias("n")).collect()}
    if not counted:
        return Model(lists, np.append(np.zeros(len(features)), -5.0)), rows
    keys = sorted(counted)
    toxic_share = [sum(n for (_, g), n in counted.items() if g == want) for want in (1, 0)]
    prior = toxic_share[0] / sum(toxic_share) if sum(toxic_share) else 0.05
    patterns = np.array([[int(c) for c in k[0]] for k in keys], np.int8)
    post, _, _ = label_model(patterns, np.array([counted[k] for k in keys], float), np.array([k[1] for k in keys]), max(prior, 0.005))
    posterior = dict(zip(keys, post))
    fitted = part_of(distinct, distinct.count(), max_fitted, "found").collect()
    target = np.array([posterior[r.votes, r.gold] for r in fitted])
    w = fit_linear([r.found for r in fitted], target, np.array([r.n for r in fitted], float), len(features)) if fitted else np.append(np.zeros(len(features)), -5.0)
    return Model(lists, w), rows.select("id", "found")


def score(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, score) of every row."""
    model, rows = fit(docs, labelled, id_col=id_col, **options)
    weights = F.array(*[F.lit(float(x)) for x in model.weights[:-1]])
    z = F.aggregate("found", F.lit(float(model.weights[-1])), lambda acc, i: acc + F.element_at(weights, i + 1))
    return rows.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score"))


def clean(docs: DataFrame, labelled: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score at threshold or above. Texts are scored where they are, not moved."""
    model, _ = fit(docs, labelled, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        held("toxicity")
        one = model.scorer()
        for b in batches:
            yield b.filter(pa.array([one(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str, n: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, labels.filter(fold("doc_id", 5) != 0).select("doc_id", "toxic"))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

