"""Removal of byte strings that an earlier document holds, by prefix doubling over the whole corpus.

Every position's 1-, 2-, 4-, 8-, 16- and 32-byte prefix is named from the names of its two halves, the pairs
(name(i), name(i + k)) at growing offsets k. Names are 64-bit fingerprints of those pairs instead of their
ranks among all pairs, so doubling needs no exchange; the exchanges are where positions are sorted and those
that turn out unique drop out:

1. at 24 bytes, for the positions that some 50-byte window has as its least 24-byte name (its anchor). A
   window's anchor depends on its bytes alone, so equal windows have equal anchors, and an anchor's windows
   form one run. Anchors whose run is equal byte for byte in an earlier document are settled as repeats, and
   those whose 24 bytes occur in one run only as unique.
2. at the threshold, 50 bytes, for the windows of the anchors left: the pairs (name(i), name(i + 18)) of their
   32-byte names are sorted and the least document of equal ones decides.

Texts lie in packs of bounded size in a table that is bucketed by pack, so that they are never shuffled;
entries travel as blobs, a blob for each pack and bucket of names. Two different strings are taken for equal
only if 96 bits of their names agree.

Defined results: a null text is empty; rows of one id don't remove from one another; rows with a null id keep
everything and remove nothing; repeated rows are each answered; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import new_path, prepare, remove, stored, table

GRAM, LENGTH = 24, 50
SPREAD = LENGTH - GRAM + 1  # anchors a window chooses from
#: Bytes a pack, windows worked on together, and bytes of text a bucket of names.
PACK, CHUNK, BUCKET = 3 << 20, 1 << 20, 12 << 20
MASK = np.uint64((1 << 27) - 1)
LETTERS = np.random.default_rng(50).integers(0, 1 << 64, 256, np.uint64)
NOBODY = np.iinfo(np.int64).max


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The names of pairs of names."""
    x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
    x += b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def doubled(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of all GRAM-byte and of all 32-byte strings of a text."""
    x = LETTERS[body]
    for k in (1, 2, 4, 8):
        x = pair(x[:-k], x[k:], k)
    gram = pair(x[: -(GRAM - 16)], x[GRAM - 16 :], GRAM)
    return gram, pair(x[:-16], x[16:], 32)


class Runs:
    """The anchors of a stretch of windows: each one's name, its run of windows lo..hi, and the run's name."""

    def __init__(self, body: np.ndarray, ends: np.ndarray, first: int, last: int):
        """Windows first..last-1 of body, of which those that cross a text's end don't count."""
        part = body[first : min(len(body), last + LENGTH - 1)]
        self.first, n = first, len(part) - LENGTH + 1
        text = np.searchsorted(ends, np.arange(first, first + n), side="right")
        valid = np.arange(first, first + n) + LENGTH <= ends[text]
        gram, self.name = doubled(part)
        key = (gram & ~MASK) | np.arange(len(gram), dtype=np.uint64)
        for k in (1, 2, 4, 8):
            key = np.minimum(key[:-k], key[k:])
        key = np.minimum(key[: len(key) - (SPREAD - 16)], key[SPREAD - 16 :])[:n]  # the least of 27, leftmost of equals
        anchor = (key & MASK).astype(np.int64)
        w = np.flatnonzero(valid)
        new = np.ones(len(w), bool)
        new[1:] = (anchor[w[1:]] != anchor[w[:-1]]) | (w[1:] != w[:-1] + 1) | (text[w[1:]] != text[w[:-1]])
        at = np.flatnonzero(new)
        self.lo, self.hi = w[at], w[np.append(at[1:], len(w)) - 1] if len(w) else w
        self.text = text[self.lo]
        a = anchor[self.lo]
        self.gram = gram[a]
        shape = ((self.hi - self.lo) * 64 + (a - self.lo)).astype(np.uint64)
        both = pair(pair(self.name[self.lo], self.name[self.lo + 18], 1), pair(self.name[self.hi], self.name[self.hi + 18], 2), 3)
        self.run = pair(both, shape, 4)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of chosen runs, their texts, and the two names of each."""
        size = self.hi[chosen] - self.lo[chosen] + 1
        w = np.repeat(self.lo[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return w, np.repeat(self.text[chosen], size), self.name[w], self.name[w + 18]


def stretches(body: np.ndarray, ends: np.ndarray) -> Iterator[Runs]:
    for first in range(0, max(0, len(body) - LENGTH + 1), CHUNK):
        yield Runs(body, ends, first, min(first + CHUNK, len(body) - LENGTH + 1))


def least_first(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries with equal keys one of the smallest document leads: which lead, each one's leader, and whether
    its document comes after the leader's. Rows without an id neither lead others nor follow."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(k)))
    leader = np.empty(len(k), np.int64)
    leader[order] = np.repeat(order[at], size)
    lead = np.zeros(len(k), bool)
    lead[order[at]] = True
    somebody = doc != NOBODY
    return lead & somebody, leader, (doc > doc[leader]) & somebody


class Pack:
    """The entries of a pack, in the same order each time they are worked out."""

    def __init__(self, docs: list, body: bytes, ends: list[int], buckets: int):
        self.docs = np.array([NOBODY if d is None else d for d in docs], np.int64)
        self.body, self.ends, self.buckets = np.frombuffer(body, np.uint8), np.array(ends, np.int64), buckets
        self.runs = list(stretches(self.body, self.ends))
        join = lambda name, kind: np.concatenate([getattr(r, name) for r in self.runs]) if self.runs else np.zeros(0, kind)
        self.gram, self.run, self.text = join("gram", np.uint64), join("run", np.uint64), join("text", np.int64)
        lead, self.leader, self.later = least_first(self.run, self.docs[self.text])
        self.sent = np.flatnonzero(lead)

    def blobs(self, key: np.ndarray, doc: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """(bucket, columns and documents) of entries, by key."""
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            at = order[cut[b] : cut[b + 1]]
            if len(at):
                own, place = np.unique(doc[at], return_inverse=True)
                # documents come in order, so their steps are small numbers that pack well
                docs = zlib.compress(np.diff(own, prepend=0).tobytes() + np.diff(place, prepend=0).astype(np.int32).tobytes(), 1)
                yield b, b"".join([np.array([len(at), len(own), len(docs)], np.int64).tobytes(), docs, *(c[at].tobytes() for c in columns)])

    def answers(self, key: np.ndarray, found: dict[int, bytes]) -> np.ndarray:
        """What the buckets said of each entry."""
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out = np.zeros(len(key), np.uint8)
        if len(key):
            out[order] = np.concatenate([np.frombuffer(found[b], np.uint8) for b in np.unique(bucket).tolist()])
        return out

    def anchors(self) -> Iterator[tuple[int, bytes]]:
        g = self.gram[self.sent]
        yield from self.blobs(g, self.docs[self.text[self.sent]], [(g // np.uint64(self.buckets)).astype(np.uint32), self.run[self.sent]])

    def settle(self, found: dict[int, bytes]) -> None:
        """Takes in the first exchange: which runs are repeats, and which windows are open."""
        status = np.zeros(len(self.run), np.uint8)
        status[self.sent] = self.answers(self.gram[self.sent], found)
        status = np.where(self.later, 2, np.where(self.docs[self.text] == NOBODY, 0, status[self.leader]))
        self.repeat = status == 2
        sizes = np.cumsum([0, *(len(r.lo) for r in self.runs)])
        parts = [r.windows(np.flatnonzero(status[a:b] == 1)) for r, a, b in zip(self.runs, sizes, sizes[1:])]
        self.window = np.concatenate([w + r.first for (w, *_), r in zip(parts, self.runs)]) if parts else np.zeros(0, np.int64)
        text, self.x, self.y = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in ((1, np.int64), (2, np.uint64), (3, np.uint64)))
        self.window_doc = self.docs[text]
        lead, self.window_leader, self.window_later = least_first(pair(self.x, self.y, 5), self.window_doc)
        self.window_sent = np.flatnonzero(lead)

    def open_windows(self) -> Iterator[tuple[int, bytes]]:
        at = self.window_sent
        yield from self.blobs(self.x[at], self.window_doc[at], [self.x[at], (self.y[at] >> np.uint64(32)).astype(np.uint32)])

    def removed(self, found: dict[int, bytes]) -> np.ndarray:
        """Whether each byte goes."""
        hit = self.window_later.copy()
        hit[self.window_sent] |= self.answers(self.x[self.window_sent], found) == 2
        hit |= hit[self.window_leader]
        depth = np.zeros(len(self.body) + 1, np.int32)
        np.add.at(depth, self.window[hit], 1)
        np.add.at(depth, self.window[hit] + LENGTH, -1)
        sizes = np.cumsum([0, *(len(r.lo) for r in self.runs)])
        for r, a, b in zip(self.runs, sizes, sizes[1:]):
            gone = self.repeat[a:b]
            np.add.at(depth, r.lo[gone] + r.first, 1)
            np.add.at(depth, r.hi[gone] + r.first + LENGTH, -1)
        return np.cumsum(depth[:-1]) > 0


def unpacked(blob: bytes, kinds: list) -> tuple[np.ndarray, list[np.ndarray]]:
    n, m, size = np.frombuffer(blob, np.int64, 3).tolist()
    docs = zlib.decompress(blob[24 : 24 + size])
    doc = np.cumsum(np.frombuffer(docs, np.int64, m))[np.cumsum(np.frombuffer(docs, np.int32, n, 8 * m))]
    columns, at = [], 24 + size
    for k in kinds:
        columns.append(np.frombuffer(blob[at : at + n * np.dtype(k).itemsize], k))
        at += n * np.dtype(k).itemsize
    return doc, columns


def judge_anchors(blobs: list[bytes]) -> np.ndarray:
    """2: an earlier document has the same run; 1: the first of its run, but its 24 bytes occur in others; else 0."""
    got = [unpacked(b, [np.uint32, np.uint64]) for b in blobs]
    doc, gram, run = np.concatenate([d for d, _ in got]), *(np.concatenate([c[i] for _, c in got]) for i in (0, 1))
    order = np.lexsort((doc, run, gram))
    g, r, d = gram[order], run[order], doc[order]
    new_gram = np.ones(len(g), bool)
    new_gram[1:] = g[1:] != g[:-1]
    new_run = new_gram.copy()
    new_run[1:] |= r[1:] != r[:-1]
    at = np.flatnonzero(new_run)
    least = np.repeat(d[at], np.diff(np.append(at, len(g))))
    of = np.cumsum(new_gram) - 1
    several = np.bincount(of, weights=new_run)[of] > 1
    out = np.zeros(len(g), np.uint8)
    out[order] = np.where(d > least, 2, several.astype(np.uint8))
    return out


def judge_windows(blobs: list[bytes]) -> np.ndarray:
    """2: an earlier document has the same window; else 0."""
    got = [unpacked(b, [np.uint64, np.uint32]) for b in blobs]
    doc, x, y = np.concatenate([d for d, _ in got]), *(np.concatenate([c[i] for _, c in got]) for i in (0, 1))
    order = np.lexsort((doc, y, x))
    x, y, d = x[order], y[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    out = np.zeros(len(x), np.uint8)
    out[order] = np.where(d > np.repeat(d[at], np.diff(np.append(at, len(x)))), 2, 0)
    return out


def exchange(entries: DataFrame, judge, name: str) -> DataFrame:
    """(pack, answers): entries (bucket, pack, blob) of a bucket are judged together; answers go back by pack."""

    def run(batches):
        bucket, packs, blobs = None, [], []

        def said():
            out = judge(blobs)
            cut = np.cumsum([0, *(int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs)])
            parts = [out[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([bucket] * len(packs), pa.int32()), pa.array(parts, pa.binary())], names=["pack", "bucket", "blob"])

        for b in batches:
            for k, p, blob in zip(*(c.to_pylist() for c in b.columns)):
                if k != bucket and blobs:
                    yield said()
                    packs, blobs = [], []
                bucket = k
                packs.append(p), blobs.append(blob)
        if blobs:
            yield said()

    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    back = dealt.mapInArrow(run, "pack long, bucket int, blob binary")
    return stored(back.groupBy("pack").agg(F.collect_list(F.struct("bucket", "blob")).alias(name)), name)


def packs_of(docs: DataFrame) -> DataFrame:
    """Rows (pack, docs, body, ends), each of about PACK bytes of text, or one longer text."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def packed():
            ends = np.cumsum([len(t) for t in texts]).tolist()
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary()), pa.array([ends], pa.list_(pa.int64()))], names=["pack", "docs", "body", "ends"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                t = t or b""
                if texts and size + len(t) > PACK:
                    yield packed()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i), texts.append(t)
                size += len(t)
        if texts:
            yield packed()

    return docs.mapInArrow(run, "pack long, docs array<long>, body binary, ends array<long>")


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are the removed stretches of bytes."""
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    name, path = f"tessera_packs_{uuid.uuid4().hex}", new_path(spark, "packs")
    packed = packs_of(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, "pack").saveAsTable(name)
    packs = spark.table(name)
    total = packs.agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET))

    def pack_of(b, i):
        return Pack(b.column("docs")[i].as_py(), b.column("body")[i].as_py(), b.column("ends")[i].as_py(), buckets)

    def answers(b, c, i):
        return {x["bucket"]: x["blob"] for x in b.column(c)[i].as_py() or ()}

    def rows(pack, blobs):
        got = list(blobs)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([pack] * len(got), pa.int64()), pa.array([v for _, v in got], pa.binary())], names=["bucket", "pack", "blob"])

    def first(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield rows(b.column("pack")[i].as_py(), pack_of(b, i).anchors())

    def second(batches):
        for b in batches:
            for i in range(b.num_rows):
                p = pack_of(b, i)
                p.settle(answers(b, "anchors", i))
                yield rows(b.column("pack")[i].as_py(), p.open_windows())

    def last(batches):
        for b in batches:
            for i in range(b.num_rows):
                p = pack_of(b, i)
                p.settle(answers(b, "anchors", i))
                gone = p.removed(answers(b, "windows", i))
                out, start = {k: [] for k in names}, 0
                for doc, end in zip(b.column("docs")[i].as_py(), p.ends.tolist()):
                    g, text = gone[start:end], p.body[start:end]
                    edge = np.flatnonzero(np.diff(g, prepend=False, append=False)).reshape(-1, 2).tolist()
                    values = (doc, end - start, int(g.sum()), len(edge), hashlib.sha256((text[~g] if edge else text).tobytes()).hexdigest(), [{"start": x, "stop": y} for x, y in edge])
                    for k, v in zip(names, values):
                        out[k].append(v)
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, kinds)], names=names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    entry = "bucket int, pack long, blob binary"
    anchors = exchange(packs.mapInArrow(first, entry), judge_anchors, "anchors")
    opened = packs.join(anchors, "pack", "left")
    windows = exchange(opened.mapInArrow(second, entry), judge_windows, "windows")
    final = opened.join(windows, "pack", "left").mapInArrow(last, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")
    out = stored(final, "repeats")
    spark.sql(f"drop table {name}")
    remove(spark, path)
    return out


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).drop("spans")
