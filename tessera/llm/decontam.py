"""Benchmark decontamination by latent semantic retrieval, then exact checks of word order and answers.

Passages are runs of blocks of BLOCK words over the benchmark's vocabulary. One pass over the whole corpus counts each
word's occurrences and applies the blocks' term matrix and its transpose to a random matrix; from that sketch alone the
randomised singular value decomposition of the TF-IDF matrix follows (Nystrom's form for C'C, whose eigenvectors
are the right singular vectors). Tasks send slices of the sketch, which are summed by slices. A word's place in
the latent space is its row of the singular vectors at unit length times its inverse frequency; items and passages are
sums of their words. Items have no part in fitting the space: what it knows comes from the corpus.

The second pass takes cosines of all passages with all items of their length class (a passage is as long as the
item and a block more). Whatever reaches COSINE is a candidate, and goes on if enough of its words are the item's. It
is verified by the longest common subsequence with the item inside any run of words of twice the item's length:
`overlap` of the item's words, or `paraphrase` of them if the item's rarest words - its answer - are there too. Verbatim
copies don't depend on the space: each item's rarest pair of neighbouring words is looked up at every
place of every text, and the whole item compared there. Items of fewer than `least` words are found in this way only,
as a paraphrase of so few words can't be told from chance.

All items are searched for in one pass, up to `part` items or 400 characters for each of so many; larger
benchmarks are taken in parts, which bounds what is sent to executors. Texts of more than STRETCH words are searched
by overlapping stretches, so a very long text needs little memory.

Defined results: null and empty texts and items match nothing;
items that repeat each match on their own; repeated rows match alike; rows with a null id give matches with
a null id; empty tables give no rows; very long texts are searched whole, and items of more than SEGMENT words match by any of their
segments; other columns are ignored (clean keeps them). Case and ASCII punctuation don't count.
"""

from __future__ import annotations

import itertools
import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import held, prepare, table

BLOCK, SEGMENT = 8, 64
#: Dimensions of the sketch and of the space, and the cosine from which a passage is a candidate.
RANK, COSINE = 64, 0.45
#: Slices of the vocabulary that tasks' sums are dealt into.
SLICES = 32
#: Words of a text that are searched together; cells of a table of cosines.
STRETCH, CELLS = 1 << 16, 1 << 19
PUNCTUATION = bytes(32 if chr(i) in string.punctuation else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(PUNCTUATION).split() if text else []


def lcs(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, a word of b at a time over bits for a."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """Segments of benchmark items over the vocabulary of their words; exact: those to be found word for word only."""

    def __init__(self, rows: list[tuple], least: int):
        self.ids, self.words, exact, vocab = [], [], [], {}
        for item, text in rows:
            ws = [vocab.setdefault(w, len(vocab)) for w in words_of(text)]
            n = -(-len(ws) // SEGMENT)
            exact += [len(ws) < least] * n
            for i in range(n):
                self.ids.append(item)
                self.words.append(ws[len(ws) * i // n : len(ws) * (i + 1) // n])
        self.vocab = vocab
        self.get = vocab.get
        self.exact = np.array(exact, bool)
        self.length = np.array([len(ws) for ws in self.words], np.int64)
        #: blocks of the passages that an item is held against
        self.size = -(-self.length // BLOCK) + 1

    def number(self, words: list[bytes]) -> np.ndarray:
        """Word numbers; -1 for words that no item has."""
        get = self.get
        return np.fromiter(map(get, words, itertools.repeat(-1)), np.int32, len(words))


def stretches(items: Items, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Word numbers of some texts, one after another, each one's first word, number of words, and place in texts.

    Long texts come in stretches that overlap by what holds any match."""
    ids, doc, held = [], [], 0

    def together():
        lengths = np.array([len(x) for x in ids], np.int64)
        return np.concatenate(ids), np.cumsum(lengths) - lengths, lengths, np.array(doc)

    for d, t in enumerate(texts):
        x = items.number(words_of(t))
        for at in range(0, max(1, len(x) - 4 * SEGMENT), STRETCH):
            one = x[at : at + STRETCH + 4 * SEGMENT]
            if len(one):
                ids.append(one), doc.append(d)
                held += len(one)
            if held >= STRETCH:
                yield together()
                ids, doc, held = [], [], 0
    if ids:
        yield together()


def blocks(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the text of every block; blocks start anew with each text."""
    n = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return first[text] + nth * BLOCK, text


def sums(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group; group is sorted and may leave groups out."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    at = np.flatnonzero(np.diff(group, prepend=-1))
    if len(at):
        out[group[at]] = np.add.reduceat(rows, at, axis=0)
    return out


def block_sums(rows: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of each block's words, the first words of all blocks at once, then the second ones, and so on."""
    rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
    ids = np.append(ids, -1)  # words that no item has count as the last row
    size = np.diff(np.append(starts, len(ids) - 1))
    out = rows[ids[starts]]
    for j in range(1, BLOCK):
        out += rows[ids[np.where(size > j, starts + j, len(ids) - 1)]]
    return out


def known_words(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that items have, and the block of each."""
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    known = ids >= 0
    return ids[known], block[known]


def random_matrix(d: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d, RANK)).astype(np.float32)


def corpus_pass(docs: DataFrame, sent, seed: int = 11) -> tuple[int, np.ndarray, np.ndarray]:
    """Blocks, each word's occurrences, and the transposed term matrix times itself times a random matrix."""
    d = len(sent.value.vocab)
    cut = [d * i // SLICES for i in range(SLICES + 1)]

    def gather(batches):
        held("decontamination")
        items = sent.value
        omega = random_matrix(d, seed)
        n, df, y = 0, np.zeros(d, np.int64), np.zeros((d, RANK))
        for b in batches:
            for ids, first, lengths, _ in stretches(items, b.column(0).to_pylist()):
                starts, _ = blocks(first, lengths)
                n += len(starts)
                w, block = known_words(ids, starts)
                df += np.bincount(w, minlength=d)
                u = block_sums(omega, ids, starts)
                order = np.argsort(w, kind="stable")
                y += sums(u[block[order]], w[order], d)
        if n:
            part = [(df[x:z].tobytes(), y[x:z].astype(np.float32).tobytes()) for x, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array([p[0] for p in part], pa.binary()), pa.array([p[1] for p in part], pa.binary())], names=["slice", "n", "df", "y"])

    def total(batches):
        found = {}
        for b in batches:
            for k, m, one, two in zip(*(c.to_pylist() for c in b.columns)):
                got = found.setdefault(k, [0, 0, 0])
                got[0], got[1], got[2] = got[0] + m, got[1] + np.frombuffer(one, np.int64), got[2] + np.frombuffer(two, np.float32).astype(float)
        for k, (m, one, two) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m], pa.int64()), pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary())], names=["slice", "n", "df", "y"])

    schema = "slice int, n long, df binary, y binary"
    parts = sorted(docs.select("text").mapInArrow(gather, schema).repartition(SLICES, "slice").mapInArrow(total, schema).collect())  # one row a slice
    if not parts:
        return 0, np.zeros(d, np.int64), np.zeros((d, RANK))
    return parts[0].n, np.concatenate([np.frombuffer(r.df, np.int64) for r in parts]), np.concatenate([np.frombuffer(r.y).reshape(-1, RANK) for r in parts])


def singular_vectors(idf: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors and singular values of the TF-IDF matrix C diag(idf), from y = C'C omega.

    C'C is close to y (omega' y)^-1 y' (Nystrom), so C diag(idf) has the singular values of diag(idf) y (omega' y)^-1/2."""
    core = random_matrix(len(idf), seed).astype(float).T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    kept = value > 1e-7 * max(value[-1], 1e-300)
    root = idf[:, None] * (y @ (vector[:, kept] / np.sqrt(value[kept])))
    w, s, _ = np.linalg.svd(root, full_matrices=False)
    real = s > 1e-7 * (s[0] if len(s) else 1)
    return w[:, real], s[real]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class Space:
    """The latent space: each word's place, the items' directions, and what verification and look-ups need."""

    def __init__(self, items: Items, n: int, df: np.ndarray, y: np.ndarray):
        self.idf = np.maximum(np.log((1 + n) / (1 + df)), 0) + 0.05
        vectors, self.values = singular_vectors(self.idf, y)
        self.terms = (self.idf[:, None] * unit(vectors)).astype(np.float32)
        flat, of = np.concatenate([np.array(ws) for ws in items.words]), np.repeat(np.arange(len(items.words)), items.length)
        self.items = unit(sums(self.terms[flat], of, len(items.words)))
        self.rare, self.anchor, first = [], [], []
        for ws in items.words:  # the answer: the fifth of the distinct words, three at least, that is rarest
            distinct = sorted(set(ws), key=lambda w: (-self.idf[w], w))
            self.rare.append(set(distinct[: max(3, -(-len(distinct) // 5))]))
            at = max(range(max(1, len(ws) - 1)), key=lambda j: sum(self.idf[w] for w in ws[j : j + 2]))
            self.anchor.append(at)
            first.append(self.pairs(np.array(ws[at : at + 2]), len(df))[0] if len(ws) > 1 else ws[0])
        key, single = np.array(first, np.int64), items.length == 1
        self.lookup = [(m, *np.unique(key[m], return_index=False, return_inverse=True)) for m in (np.flatnonzero(~single), np.flatnonzero(single))]
        self.table = np.zeros((len(items.words), SEGMENT), np.int32)
        self.table[of, np.arange(len(flat)) - np.repeat(np.cumsum(items.length) - items.length, items.length)] = flat
        bits = max(16, int(len(flat) * 32).bit_length())
        self.mask = (1 << bits) - 1
        self.member = np.zeros(1 << bits, bool)
        self.member[self.cell(of, flat)] = True

    @staticmethod
    def pairs(ids: np.ndarray, d: int) -> np.ndarray:
        return ids[:-1].astype(np.int64) * d + ids[1:]

    def cell(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where (item, word) is marked, maybe with others."""
        x = (item.astype(np.uint64) << np.uint64(32)) ^ word.astype(np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(24)) & np.uint64(self.mask)).astype(np.int64)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then those of first[1], and so on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def verbatim(items: Items, space: Space, ids: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, item, first word) of items that stand in a text word for word, each once a text."""
    end = first + lengths
    keys = (space.pairs(ids, len(items.vocab)), ids.astype(np.int64))
    for key, (own, values, of) in zip(keys, space.lookup):
        if not len(own) or not len(key):
            continue
        at = np.minimum(np.searchsorted(values, key), len(values) - 1)
        places = np.flatnonzero((values[at] == key) & (ids[: len(key)] >= 0))
        order = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[order], np.arange(len(values) + 1))
        count = begin[at[places] + 1] - begin[at[places]]
        item = own[order[spread(begin[at[places]], count)]]
        start = np.repeat(places, count) - np.array(space.anchor, np.int64)[item]
        text = np.searchsorted(first, np.repeat(places, count), side="right") - 1
        ok = (start >= first[text]) & (start + items.length[item] <= end[text])
        item, start, text = item[ok], start[ok], text[ok]
        for j in range(SEGMENT):
            going = items.length[item] > j
            if not going.any():
                break
            same = ~going | (ids[np.minimum(start + j, len(ids) - 1)] == space.table[item, j])
            item, start, text = item[same], start[same], text[same]
        _, once = np.unique(text * len(items.words) + item, return_index=True)
        yield from zip(text[once].tolist(), item[once].tolist(), start[once].tolist())


def candidates(items: Items, space: Space, ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, paraphrase: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item, first word, end, cosine) of passages whose cosine with an item reaches COSINE and that hold enough
    words of it, best cosines first."""
    starts, text = blocks(first, lengths)
    n = len(starts)
    w, block = known_words(ids, starts)
    passage = latent = block_sums(space.terms, ids, starts)
    known = count = np.bincount(block, minlength=n)
    begin = np.searchsorted(block, np.arange(n + 1))  # known words of each block
    last = np.searchsorted(text, text, side="right")  # the block after the text's last
    at, wide = np.arange(n), 1
    whole = (at == 0) | (text != np.roll(text, 1))  # a short text is one passage
    for size in np.unique(items.size[~items.exact]).tolist():
        while wide < size:  # passages grow block by block
            inside = np.flatnonzero(at + wide < last)
            passage, known = passage.copy(), known.copy()
            passage[inside] += latent[inside + wide]
            known[inside] += count[inside + wide]
            wide += 1
        own = np.flatnonzero((items.size == size) & ~items.exact)
        need = np.ceil(paraphrase * items.length - 1e-9).astype(np.int64)
        could = np.flatnonzero((whole | (at + size <= last)) & (known >= need[own].min()))
        step = max(1, CELLS // len(own))
        for part in (could[i : i + step] for i in range(0, len(could), step)):
            cos = unit(passage[part]) @ space.items[own].T
            r, c = np.nonzero(cos >= COSINE)
            p, item = part[r], own[c]
            enough = known[p] >= need[item]
            p, item, cos = p[enough], item[enough], cos[r[enough], c[enough]]
            stop = np.minimum(p + size, last[p])
            lo, hi = np.maximum(p - 1, p * (whole[p])), np.minimum(stop + 1, last[p])  # a block more on either side
            lo = np.where(whole[p], p, lo)
            length = begin[hi] - begin[lo]
            held = space.member[space.cell(np.repeat(item, length), w[spread(begin[lo], length)])]
            shared = np.bincount(np.repeat(np.arange(len(p)), length), weights=held, minlength=len(p))
            good = np.flatnonzero(shared >= need[item])
            for g in good[np.argsort(-cos[good], kind="stable")].tolist():
                t = int(text[p[g]])
                yield t, int(item[g]), int(starts[p[g]]), min(int(starts[p[g]]) + size * BLOCK, int(first[t] + lengths[t])), float(cos[g])


def verified(own: list[int], rare: set[int], around: list[int], overlap: float, paraphrase: float) -> tuple[int, bool] | None:
    """(common words, answer found) of the run of twice the item's length within around that has most of the item in order."""
    n, have = len(own), set(around)
    if sum(x in have for x in own) < paraphrase * n or lcs(own, around) < paraphrase * n:
        return None
    best = None
    mine = set(own)
    for j in range(max(1, len(around) - 2 * n + 1)):
        part = around[j : j + 2 * n]
        if j and around[j - 1] not in mine and around[j + 2 * n - 1] not in mine:
            continue  # nothing of the item came or went
        common = lcs(own, part)
        answer = len(rare & set(part)) >= 0.8 * len(rare)
        if common >= overlap * n - 1e-9 or (answer and common >= paraphrase * n - 1e-9):
            best = (common, answer) if best is None else max(best, (common, answer))
    return best


def found_in(items: Items, space: Space, texts: list[str | None], overlap: float, paraphrase: float, all_items: bool = True) -> dict[tuple[int, object], tuple]:
    """(row, item): (overlap, cosine, common words, item's words, answer found) of verified matches; unless all_items, one item a row will do."""
    best: dict[tuple[int, object], tuple] = {}
    for ids, first, lengths, doc in stretches(items, texts):
        done, rows = set(), set()

        def add(t, item, common, answer, cos, done=done, rows=rows, doc=doc):
            n, key = len(items.words[item]), (int(doc[t]), items.ids[item])
            got = (common / n, cos, common, n, answer)
            best[key] = max(best.get(key, got), got)
            done.add((t, item)), rows.add(t)

        for t, item, start in verbatim(items, space, ids, first, lengths):
            add(t, item, len(items.words[item]), True, 1.0)
        for t, item, start, stop, cos in candidates(items, space, ids, first, lengths, paraphrase):
            if (t, item) in done or (not all_items and t in rows):
                continue
            n = len(items.words[item])
            around = ids[max(int(first[t]), start - n) : min(int(first[t] + lengths[t]), stop + n)].tolist()
            got = verified(items.words[item], space.rare[item], around, overlap, paraphrase)
            if got:
                add(t, item, *got, min(1.0, cos))
    return best


def parts_of(docs: DataFrame, benchmark: DataFrame, least: int, part: int, text_col: str, item_col: str) -> Iterator[tuple]:
    """Broadcast items and latent space of each part of the benchmark, fitted over all of docs."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col("text").alias("body")).filter("item is not null and body is not null").distinct()
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.length("body")), F.lit(0))).first()
    parts = max(1, math.ceil(n / part), math.ceil(size / (400 * part)))
    for p in range(parts):
        held = bench.filter(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == p)
        items = Items(sorted((r.item, r.body) for r in held.collect()), least)  # about `part` rows
        if items.words:
            sent = spark.sparkContext.broadcast(items)
            yield sent, spark.sparkContext.broadcast(Space(items, *corpus_pass(rows, sent)))


def matches(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, paraphrase: float = 0.6, least: int = 8, part: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, cosine, lcs, item_words, answer): documents that hold an item or a paraphrase of it, by their best passage.

    The cosine of a verbatim copy is 1."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, {item_col} {item_type}, cosine double, lcs long, item_words long, answer boolean"

    def search(sent, sent_space):
        def run(batches):
            held("decontamination")
            items, space = sent.value, sent_space.value
            for b in batches:
                best = found_in(items, space, b.column(1).to_pylist(), overlap, paraphrase)
                keys = list(best)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([d for d, _ in keys], pa.int64())), pa.array([i for _, i in keys], pa.array(items.ids).type)]
                    + [pa.array([best[k][j] for k in keys], t) for j, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()), (4, pa.bool_()))],
                    names=[id_col, item_col, "cosine", "lcs", "item_words", "answer"],
                )

        return run

    out = None
    for sent, space in parts_of(docs, benchmark, least, part, text_col, item_col):
        found = docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(search(sent, space), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, paraphrase: float = 0.6, least: int = 8, part: int = 20_000, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without those that hold a benchmark item. They are searched where they are, not moved."""
    at, out = docs.columns.index(text_col), docs

    def keep(sent, sent_space):
        def run(batches):
            held("decontamination")
            items, space = sent.value, sent_space.value
            for b in batches:
                bad = {d for d, _ in found_in(items, space, b.column(at).to_pylist(), overlap, paraphrase, False)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        return run

    for sent, space in parts_of(docs, benchmark, least, part, text_col, item_col):
        out = out.mapInArrow(keep(sent, space), docs.schema)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
