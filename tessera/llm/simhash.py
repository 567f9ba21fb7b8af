"""SimHash fingerprints, and groups of documents whose fingerprints differ in few bits.

Equal fingerprints form one class. Fingerprints that differ in at most `distance` bits agree in all of at
least (segments - distance) of the segments that the 64 bits are dealt into, so each choice of that many
segments is a join key: no pair is lost. The Hamming distances of every fingerprint to many
reference fingerprints are computed first and kept in a table (the pivot table); inside a key they are compared: by the
triangle inequality a pair whose coordinates
differ by more than `distance` anywhere can't be linked, and the others are verified bit by bit. Only a
spanning forest of the links leaves a task, a star for each component. Keys with very many fingerprints are dealt into blocks, and
every pair of blocks into a task of its own, so no task gathers an unbounded group.

Defined results: a null text or one without words has fingerprint zero and is linked like any other; texts
with fewer words than a shingle are one shingle; repeated rows share a class; an empty table gives no rows;
very long texts are hashed in parts;
other columns are ignored. A row with a null id has a fingerprint, and its component is the smallest id in
its group (null if there is none).
"""

from __future__ import annotations

import functools
import gc
import itertools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.session import drop_stored, held, prepare, stored, table

#: Shingles hashed at a time, so that a very long text needs little memory.
CHUNK = 1 << 16
#: Fingerprints of a key that one task compares; larger keys are dealt into blocks of about half as many.
DENSE = 256


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text over its word shingles, repeats included."""
    toks = text.lower().split()
    if not toks:
        return 0
    if len(toks) <= words:
        return xxhash.xxh64_intdigest(b" ".join(toks), seed)
    joined, sizes = b" ".join(toks), np.fromiter(map(len, toks), np.int64, len(toks))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(toks) - words + 1
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())], ">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp) with the fingerprint's 64 bits as a long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or b"", words) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, fp long")


def segments_for(distance: int, n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment: as few as leave few fingerprints a key. Any number is lossless."""
    for count in range(distance + 1, 2 * distance + 1):
        if n < (1 << (64 * (count - distance) // count)) * 8:
            break
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def pivots(n: int = 24) -> np.ndarray:
    """Reference fingerprints, spread at random but always the same."""
    return np.random.default_rng(20_24).integers(0, 1 << 64, n, np.uint64)


class Forest:
    """Nodes joined by links, as one tree for each component; the smallest node is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        rx, ry = self.root(x), self.root(y)
        if rx != ry:
            self.parent[max(rx, ry)] = min(rx, ry)

    def stars(self) -> tuple[list[int], list[int]]:
        """(root, node) of every node that isn't a root."""
        found = [(self.root(x), x) for x in list(self.parent)]
        return [r for r, x in found if r != x], [x for r, x in found if r != x]


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, coords): every fingerprint's Hamming distances to the reference fingerprints, a byte each."""

    def run(batches):
        refs = pivots()
        for b in batches:
            coords = np.bitwise_count(b.column(0).to_numpy().view(np.uint64)[:, None] ^ refs[None, :])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in coords], pa.binary())], names=["fp", "coords"])

    return fps.select("fp").mapInArrow(run, "fp long, coords binary")


def link_blocks(forest: Forest, block: np.ndarray, fp: np.ndarray, coords: np.ndarray, distance: int) -> None:
    """Joins the fingerprints linked within each block; rows are sorted by block. Pairs whose coordinates differ by more
    than the distance anywhere are discarded, the others are verified."""
    at, step, coords = np.arange(len(fp)), 1, coords.astype(np.int8)
    while True:
        at = at[at < len(fp) - step]
        at = at[block[at] == block[at + step]]
        if not len(at):
            return
        near = at
        for p in range(0, coords.shape[1], 6):  # a few pivots at a time: most pairs are gone after the first
            near = near[np.abs(coords[near, p : p + 6] - coords[near + step, p : p + 6]).max(axis=1) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        for x, y in zip(fp[near].view(np.int64).tolist(), fp[near + step].view(np.int64).tolist()):
            forest.join(x, y)
        step += 1


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links between fingerprints that join the same components as all pairs that differ in `distance` bits at most."""
    fps = stored(pivot_table(fps), "pivot-table")
    segs = segments_for(distance, fps.count())
    keep = len(segs) - distance
    keys = []
    for i, chosen in enumerate(combinations(segs, keep)):
        key = F.lit(i).cast("long")
        for first, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        keys.append(key)
    keyed = fps.select("fp", "coords", F.explode(F.array(*[F.xxhash64(k) for k in keys])).alias("key"))
    # stored first, so that its size is known: few keys are dense, and then the rows needn't be dealt out for the join
    sizes = stored(keyed.select("key").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    half = DENSE // 2
    dealt = keyed.join(sizes, "key").withColumn("blocks", F.when(F.col("n") <= DENSE, F.lit(1).cast("long")).otherwise(F.ceil(F.col("n") / half)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("block")

    def run(batches):
        held, forest = None, Forest()
        for b in itertools.chain(batches, [None]):
            t = held if b is None else pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            if t is None or not t.num_rows:
                continue
            g = t.column("block").to_numpy()
            whole = len(g) if b is None else int(np.searchsorted(g, g[-1]))  # the last block may go on
            held = t.slice(whole)
            t = t.slice(0, whole)
            coords = np.frombuffer(b"".join(t.column("coords").to_pylist()), np.uint8).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1), np.uint8)
            link_blocks(forest, g[:whole], t.column("fp").to_numpy().view(np.uint64), coords, distance)
        # one star a component: tasks mostly find the same ones, so few links are left once repeats are gone
        a, b = forest.stars()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.select(block, "fp", "coords").repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long").distinct()


def groups(df: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): see the module's docstring."""
    prepare(df.sparkSession)
    docs = stored(fingerprints(df, id_col, text_col, words), "fingerprints")
    classes = stored(docs.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    found = stored(links(classes.select("fp"), distance), "fp-links")
    parts = connected_components(found)
    placed = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    named = placed.join(least, "root").select("fp", "component")
    return docs.join(named, "fp").select(id_col, "fp", "component")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: For near copies by similarity: hashed shingles of which a sample of SAMPLE texts has several are called common, the
#: HOT most frequent ones at most. That only orders shingles, rare ones first; any order finds the same pairs.
SAMPLE, HOT = 10_000, 1 << 18
#: Counts of a profile, keys that may be broadcast, and rounds against two sets a shingle.
PROFILE, FEW, ROUNDS = 256, 1 << 20, 2
#: Prefix shingles are shuffled in so many parts by their hash, one after another, so that the disk holds one part's shuffle at a time.
PASSES = 4


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The set of a UTF-8 text's word shingles as sorted 64-bit hashes."""
    toks, digest = text.lower().split(), xxhash.xxh64_intdigest
    if not toks:
        return np.zeros(0, np.uint64)
    parts, size = [], min(words, len(toks))
    for at in range(0, len(toks) - size + 1, CHUNK):
        h = np.array([digest(t, 42) for t in toks[at : at + CHUNK + size - 1]], np.uint64)
        x = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            x = mixed(x ^ h[i : i + len(x)]) + np.uint64(0x9E3779B97F4A7C15)
        parts.append(np.unique(x))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles that several texts of a sample have."""
    n = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(max(1, -(-n // SAMPLE)))) == 0)

    def run(batches):
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t or b"", words).view(np.int64))], names=["h"])

    counts = sample.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "h").limit(HOT).toPandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def profile(shingles: np.ndarray) -> bytes:
    """How many shingles end in each of PROFILE ways, 255 at most. Two sets differ in at least as many elements as their profiles do in sum."""
    return np.minimum(np.bincount((shingles % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8).tobytes()


def near_profiles(x: np.ndarray, y: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n elements together can be so similar: then they differ in n * (1 - s) / (1 + s) at most."""
    return np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64) <= n * (1 - similarity) / (1 + similarity) + 1e-6


def profiles_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PROFILE)


def prefixes(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """(id, key, node, n, profile, prefix): a text's set as one hash, its size, its profile, and as many of its rarest
    shingles, in order, that two sets which are so similar have one of them in common. Copies within a task may have no prefix."""
    sent = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, words))

    def run(batches):
        held("near copies")
        hot, count = sent.value
        seen: set[int] = set()
        for b in batches:
            node, size, shape, prefix = [], [], [], []
            if len(seen) > CHUNK:
                seen.clear()
            for t in b.column(2).cast(pa.binary()).to_pylist():
                h = shingle_set(t or b"", words)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), 42))
                size.append(len(h))
                shape.append(profile(h))
                if node[-1] in seen:  # a copy of a text of this task: one of them stands for all
                    prefix.append(np.zeros(0, np.int64))
                    continue
                seen.add(node[-1])
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    h = h[np.argsort(np.where(hot[at] == h, count[at], 0), kind="stable")]
                prefix.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(shape, pa.binary()), lists], names=["id", "key", "node", "n", "profile", "prefix"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "key", "text").mapInArrow(run, f"id {kind}, key long, node long, n int, profile binary, prefix array<long>")


def possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and profiles allow the similarity; no pair that has it is lost."""

    def run(batches):
        for b in batches:
            near = near_profiles(profiles_of(b.column(3)), profiles_of(b.column(5)), b.column(2).to_numpy() + b.column(4).to_numpy(), similarity)
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("profile").alias(f"{x}p")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").filter(F.least("an", "bn") >= F.greatest("an", "bn") * similarity - 1e-9)
    return both.select("a", "b", "an", "ap", "bn", "bp").mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, sets: DataFrame, rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have that Jaccard similarity.

    Each a meets its partners in groups of bounded size: its text comes first, then theirs, and only one set is held."""
    pairs = stored(possible(pairs, sets, similarity), "possible-pairs")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / DENSE).alias("blocks"))
    dealt = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b", F.lit(5)), F.col("blocks")))
    asked = dealt.select(F.col("a").alias("node"), "a", "block", F.lit(0).alias("turn")).distinct().union(dealt.select("b", "a", "block", F.lit(1)))
    keys = stored(sets.join(asked.select("node").distinct(), "node", "left_semi").select("node", "key"), "wanted-sets")
    few = keys.count() <= FEW  # so many keys of 16 bytes may be sent to every task; more are joined by a shuffle of the texts
    needed = rows.join(F.broadcast(keys.select("key")), "key", "left_semi") if few else rows
    texts = needed.groupBy("key").agg(F.any_value("text").alias("text")).join(keys, "key").select("node", "text")

    def run(batches):
        at, held = None, None
        for b in batches:
            a, other = [], []
            for node, hub, block, turn, text in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4).cast(pa.binary()).to_pylist()):
                h = shingle_set(text or b"", words)
                if turn == 0:
                    at, held = (hub, block), h
                    continue
                assert at == (hub, block)
                common = len(np.intersect1d(held, h, assume_unique=True))
                if common >= (len(held) + len(h) - common) * similarity - 1e-9:
                    a.append(hub), other.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])

    meet = asked.join(texts, "node").select("node", "a", "block", "turn", "text").repartition("a", "block").sortWithinPartitions("a", "block", "turn")
    found = stored(meet.mapInArrow(run, "a long, b long"), "alike")
    drop_stored(pairs)
    return found


def shared_shingles(rows: DataFrame, similarity: float, words: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(id, key, node) of all rows; (node, key, n, profile) of each node; and, by passes, (k, node, n, at, low, high): prefix
    shingles that several nodes have, with the first and last of these."""
    found = stored(prefixes(rows, similarity, words), "prefixes")
    docs = stored(found.select("id", "key", "node"), "set-nodes")
    # size and profile are the node's, whichever row they come from
    sets = stored(found.groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.any_value("profile").alias("profile")), "sets")
    keys = found.select("node", F.col("n").cast("long").alias("n"), F.posexplode("prefix").alias("at", "k"))
    shared = []
    for turn in range(PASSES):
        released(rows.sparkSession)
        packed = keys.filter(F.pmod("k", F.lit(PASSES)) == turn).select("k", "node", (F.shiftleft("n", 32) + F.col("at")).alias("place"))
        ends = packed.groupBy("k").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
        ends = stored(ends, "shared-keys")
        released(rows.sparkSession)  # one shuffle of prefixes at a time
        both = packed.join(ends, "k").select("k", "node", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"), "low", "high")
        shared.append(stored(both.distinct(), "shared-shingles"))  # copies of one text in several tasks are one node
        drop_stored(ends)
    drop_stored(found)
    return docs, sets, shared


def together(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def released(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_shingles(shared: DataFrame, parts: DataFrame, turn: int) -> DataFrame:
    """The rows of shared whose shingle is in several groups so far, with each one's group (part), the shingle's largest
    group (main), a set of it (hub), a set of another group (out, in group out_part), and how many sets are in main or not."""
    placed = shared.select("node", "n", "at", "k").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    by_part = placed.groupBy("k", "part").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("one"))
    ends = [f(F.struct("one", "part")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    keys = by_part.groupBy("k").agg(F.max(F.struct("c", "part", "one")).alias("most"), F.sum("c").alias("c"), *ends).filter("c > most.c")
    out = F.when(F.col("lo.part") == F.col("most.part"), F.col("hi")).otherwise(F.col("lo"))
    keys = keys.select("k", F.col("most.part").alias("main"), F.col("most.one.node").alias("hub"), out.alias("o"), F.col("most.c").alias("inside"), (F.col("c") - F.col("most.c")).alias("outside"))
    keys = keys.select("k", "main", "hub", F.col("o.one.node").alias("out"), F.col("o.part").alias("out_part"), "inside", "outside")
    out = stored(placed.join(keys, "k"), "open-shingles")
    released(shared.sparkSession)
    return out


def ordered(x: str, y: str) -> Column:
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def across(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that share a shingle of left, are in different groups, and whose sizes, places of the shingle
    and profiles allow the similarity. Sets outside a shingle's largest group are dealt into blocks, those inside into
    others, so that no task gathers a large group; pairs are looked at where they meet, and only possible ones leave."""
    zero = F.lit(0).cast("long")
    rows = left.join(sets.select("node", "profile"), "node").select(
        "k", "node", "n", "at", "part", "profile", (F.col("part") == F.col("main")).alias("inner"),
        F.ceil(F.col("outside") / DENSE).alias("blocks"), F.ceil(F.col("inside") / (8 * DENSE)).alias("subs"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("inner"), F.col("subs")).otherwise(F.col("blocks"))))
    place = lambda block, sub, turn: F.struct(block.alias("block"), sub.alias("sub"), F.lit(turn).alias("turn"))
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    own = F.col("own")
    inside = F.transform(upto("blocks"), lambda b: place(b, own, 1))
    outside = F.transform(upto("subs"), lambda x: place(own, x, 0))
    earlier = F.transform(F.filter(upto("blocks"), lambda b: b < own), lambda b: place(b, zero, 1))  # each pair of blocks once
    rows = rows.withColumn("to", F.explode(F.when(F.col("inner"), inside).otherwise(F.concat(outside, earlier))))
    dealt = rows.select(F.xxhash64("k", "to.block", "to.sub").alias("group"), F.col("to.turn").alias("turn"), (F.col("to.sub") == 0).alias("first"), "node", "n", "at", "part", "profile")

    def run(batches):
        held, seen = None, set()
        for b in itertools.chain(batches, [None]):
            t = held if b is None else pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            if t is None or not t.num_rows:
                continue
            g = t.column("group").to_numpy()
            whole = len(g) if b is None else int(np.searchsorted(g, g[-1]))  # the last group may go on
            held = t.slice(whole)
            x, y = compare(t.slice(0, whole))
            new = [p for p in zip(x, y) if p not in seen]
            seen = seen if len(seen) < CHUNK else set()
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in new], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def compare(t):
        g, turn, first, node, n, at, part = (t.column(i).to_numpy() for i in range(7))
        shape = profiles_of(t.column("profile"))
        a, b, i, step = [], [], np.flatnonzero(turn == 0), 1
        while True:
            i = i[i < len(g) - step]
            i = i[g[i] == g[i + step]]
            if not len(i):
                return a, b
            j = i + step
            total = n[i] + n[j]
            ok = (part[i] != part[j]) & (node[i] != node[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= total * similarity / (1 + similarity) - 1e-6)
            ok &= first[i] | (turn[j] == 1)  # sets of one block meet once
            at_i, at_j, total = i[ok], j[ok], total[ok]
            near = near_profiles(shape[at_i], shape[at_j], total, similarity)
            x, y = node[at_i[near]], node[at_j[near]]
            a += np.minimum(x, y).tolist()
            b += np.maximum(x, y).tolist()
            step += 1

    return dealt.repartition("group").sortWithinPartitions("group", "turn").mapInArrow(run, "a long, b long").distinct()


def fingerprint_pairs(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that the SimHash groups of the texts propose: every node of a group with the group's first."""
    nodes = docs.select("key", "node").distinct()
    placed = groups(rows.select("key", "text"), id_col="key").select("key", "component").distinct().join(nodes, "key").select("node", "component").distinct()
    placed = stored(placed, "fingerprint-groups")
    hubs = placed.groupBy("component").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last").select("component", "hub")
    pairs = placed.join(hubs, "component").filter("node <> hub").select(ordered("node", "hub").alias("p")).select("p.a", "p.b")
    return stored(pairs.distinct(), "fingerprint-pairs")


def similar_groups(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """(id, key, component) of rows (id, key, text): groups of texts linked by shingle sets of at least that similarity.

    First come the pairs that SimHash groups propose, verified like all others. Fingerprints miss pairs that are so similar,
    so the rest is found exactly: sets share a shingle of their prefixes, and no pair is lost. In each of a few rounds every set
    is held against two of those it shares a shingle with, the same two for all that share it, so that most groups
    are found by few pairs; then whatever isn't in one group yet is compared in full. Every link is an exact Jaccard."""
    docs, sets, shared = shared_shingles(rows, similarity, words)
    released(rows.sparkSession)
    tried = fingerprint_pairs(rows, docs)
    released(rows.sparkSession)
    found = alike(tried, sets, rows, similarity, words)
    for turn in range(ROUNDS):
        if turn == 0:
            met = F.array(ordered("node", "low"), ordered("node", "high"))
            pairs = together(shared).select(F.explode(met).alias("p")).select("p.a", "p.b").filter("a <> b").distinct().join(tried, ["a", "b"], "left_anti")
        else:
            left = [open_shingles(some, parts, turn) for some in shared]
            met = F.filter(F.array(F.struct(ordered("node", "hub").alias("p"), F.col("main").alias("other")), F.struct(ordered("node", "out").alias("p"), F.col("out_part").alias("other"))), lambda x: x.other != F.col("part"))
            pairs = together(left).select("part", F.explode(met).alias("x")).select("x.p.a", "x.p.b").distinct().join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs.distinct(), "pairs")
        if turn:
            drop_stored(*left)
        released(rows.sparkSession)
        links = alike(pairs, sets, rows, similarity, words)
        tried, found = tried.unionByName(pairs), found.unionByName(links)
        parts = connected_components(found)
        released(rows.sparkSession)
    rest = []
    for some in shared:
        left = open_shingles(some, parts, 0)
        rest.append(stored(across(left, sets, similarity).join(tried, ["a", "b"], "left_anti"), "pairs"))
        drop_stored(some, left)
        released(rows.sparkSession)
    second = together(rest).distinct()
    if not second.isEmpty():
        parts = connected_components(found.unionByName(alike(second, sets, rows, similarity, words)))
    drop_stored(sets, *rest)
    return docs.join(parts, "node", "left").select("id", "key", F.coalesce("component", "node").alias("component"))


def dedup(df: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group: that of the smallest id (null ids last, then by a hash of the text).

    Rows go by their text: an id that several texts share doesn't tie them, and rows with a null id are compared too."""
    prepare(df.sparkSession)
    key = F.xxhash64(F.col(text_col).cast("string"))
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    found = stored(similar_groups(rows, similarity, words), "similar")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    other = ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key")))
    gone = stored(found.join(best, "component").filter(other).select(F.col("id").alias("__id"), F.col("key").alias("__gone")).distinct(), "near-copies")
    keyed = df.withColumn("__key", key)
    kept = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__gone")), "left_anti")
    if not found.groupBy("id", "key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__key"])
    return kept.select(*df.columns)
