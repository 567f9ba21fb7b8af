"""Best-fit packing of tokenised documents into fixed-length sequences.

Best-fit decreasing needs only the number of pieces of each length, and there are at most `capacity`
lengths. So the cluster tokenises, cuts and counts; the driver runs best-fit decreasing over that
bounded histogram, with a segment tree over remaining capacities and bins of equal contents kept as
one range; the cluster then looks each piece up by (length, rank among the pieces of that length).
The result is exactly the global best-fit decreasing packing.

Defined results: a null or empty text is the end id alone; each row is packed on its own, so repeated
rows and null ids keep all their pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import held, prepare, stored, table

#: Words kept per worker, so that memory stays bounded whatever the vocabulary.
WORD_CACHE = 400_000
#: Texts with only these characters are split into words here; others go through the tokenizer whole.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-±´-¸º»¿-ſ]")
#: The pre-tokenizer's words in such a text in lower case.
WORDS = re.compile(r"[a-zªµºß-öø-ſ]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\w\s]|_)+")
SPECIAL = "<|"


def tokenizer(path: str):
    """The tokenizer of a file and its cache of words, once a worker."""
    kept = held("packing")
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tok, words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        words.normalizer = normalizers.Sequence([])
        words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(tok.to_str())["model"].get("end_of_word_suffix")
        ends = np.zeros(tok.get_vocab_size(), bool)
        for piece, i in tok.get_vocab().items():
            ends[i] = bool(suffix) and piece.endswith(suffix)
        kept[path] = (tok, {}, words, ends)
    return kept[path]


def word_ids(words: list[str], tok, ends: np.ndarray, together: int = 200) -> list[bytes]:
    """The ids of each word. Words are encoded many at a time; pieces that end a word say where to cut."""
    texts = [" ".join(words[i : i + together]) for i in range(0, len(words), together)]
    ids = np.array([i for e in tok.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")
    cuts = np.flatnonzero(ends[ids]) + 1
    if len(cuts) != len(words):
        return [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]
    flat, to = ids.tobytes(), (4 * cuts).tolist()
    return [flat[a:b] for a, b in zip([0, *to], to)]


def encode_all(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers. Words are encoded once and looked up after that,
    which is exact because no merge crosses a word of the pre-tokenizer."""
    tok, cache, word_tok, ends = tokenizer(path)
    plain = [None if t is None or SPECIAL in t or PLAIN.search(t) else WORDS.findall(t.lower()) for t in texts]
    if len(cache) > WORD_CACHE:
        cache.clear()
    new = list(set().union(*(ws for ws in plain if ws)).difference(cache))
    cache.update(zip(new, word_ids(new, word_tok, ends)))
    get = cache.__getitem__
    out = []
    for t, ws in zip(texts, plain):
        if ws is not None:
            out.append(b"".join(map(get, ws)))
        else:
            out.append(np.asarray(tok.encode(t, add_special_tokens=False).ids if t else [], "<u4").tobytes())
    return out


def cut(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most `capacity` ids with their rank among the task's pieces of that length."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            take, piece, start, length, crc, nth = [], [], [], [], [], []
            for row, ids in enumerate(encode_all(batch.column(1).to_pylist(), path)):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    m = min(capacity, n - at)
                    take.append(row), piece.append(k), start.append(at), length.append(m)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + m)]))
                    nth.append(int(seen[m]))
                    seen[m] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(take), pa.int32()), pa.array(nth, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)


class CapacityTree:
    """A segment tree over remaining capacities 0..n; finds the smallest one at or above a length that has open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.has = [False] * (2 * self.size)

    def put(self, capacity: int, present: bool) -> None:
        i = capacity + self.size
        self.has[i] = present
        while i > 1:
            i //= 2
            self.has[i] = self.has[2 * i] or self.has[2 * i + 1]

    def at_least(self, length: int) -> int | None:
        i = length + self.size
        if self.has[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.has[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.has[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset) of the packing of counts[length] pieces.

    Pieces of a length are alike, and once one lies in the tightest bin that bin stays the tightest until it
    can't hold another; so all bins of a range of equal bins are filled in one step.
    """
    tree, open_bins, rows, bins = CapacityTree(capacity), defaultdict(deque), [], 0

    def put(left: int, start: int, n: int) -> None:
        if n and left:
            if not open_bins[left]:
                tree.put(left, True)
            open_bins[left].append((start, n))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            left = tree.at_least(length)
            if left is None:
                left = capacity
                each = left // length
                start, n = bins, -(-(total - rank) // each)
                bins += n
            else:
                each = left // length
                start, n = open_bins[left].popleft()
                if not open_bins[left]:
                    tree.put(left, False)
            placed = min(total - rank, n * each)
            rows.append((length, rank, start, each, capacity - left))
            full, rest = divmod(placed, each)
            put(left - each * length, start, full)
            if rest:
                put(left - rest * length, start + full, 1)
            put(left, start + full + (rest > 0), n - full - (rest > 0))
            rank += placed
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there; see the module's docstring."""
    spark = df.sparkSession
    prepare(spark)
    pieces = stored(cut(df, id_col, text_col, tokenizer_path, capacity, end_id), "pieces")
    by_part = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    key = np.array([(int(r[0]) << 44) + int(r[1]) for r in plan], np.int64)
    order = np.argsort(key)
    key, plan = key[order], plan[order]
    sent = spark.sparkContext.broadcast((key, plan))  # bounded by the lengths, not by the data

    def place(batches):
        key, plan = sent.value
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            p = plan[np.searchsorted(key, (length << 44) + rank, side="right") - 1] if len(length) else plan[:0]
            nth = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in (id_col, "piece", "start", "length", "ids_crc32")), pa.array(p[:, 2] + nth // p[:, 3]), pa.array(p[:, 4] + nth % p[:, 3] * length)],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(base, ["part", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
