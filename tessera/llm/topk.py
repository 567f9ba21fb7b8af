"""Exact top-k inner products by aggregation without random access.

Candidates and queries are dealt into blocks of bounded size. A task takes a block of queries and meets a group of candidate
blocks one after another, with each query's k best so far. A candidate block keeps one sorted list per dimension. A query
reads all lists in step, each from its large end where the query's component is positive and from its small
end where it is negative. At set depths a row's upper bound takes what was read of the row, and the value just read for
what the row hasn't been seen in; as long as a query has no k rows, its lower bound takes the list's far end instead. Rows that can't
reach the k-th score so far, or the k-th lower bound, go. The sums of all queries of a chunk to a depth are one matrix
product: a row counts in a list with its own value if that has been read, else with the last value read.
Reading stops when few rows can qualify, and their scores are resolved exactly; the next block is first judged at the depth that was
enough. Bounds are floats, widened by their rounding error; final scores are integers.

For vectors without structure the lists have to be read almost to their ends; the README gives figures.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take
no part; a missing component of a shorter vector counts as zero; components beyond the 64-bit range are
held at its ends, and so are scores, which are ranked by their true value; candidates with the query's own id are left out; of queries with one id the smallest
vector counts; repeated candidate rows each take a rank; very long vectors are read whole; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import prepare, stored, table

CANDIDATES, QUERIES = 2048, 32768
#: Queries whose bounds are taken at once, pairs resolved at once, tasks that are enough for all workers, and blocks after which a lesser depth is tried again.
CHUNK, PAIRS, TASKS, AGAIN = 1024, 16384, 64, 16
#: Depths, in sixteenths of the lists, at which bounds are taken.
DEPTHS = (1, 2, 4, 8, 10, 11, 12, 13, 14, 15)


def matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of integers; shorter rows are filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(width or 0, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def exact(x: np.ndarray, q: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """The integer inner products of the rows of x and q, pair by pair: held at the ends of 64 bits, and what lies beyond
    these. small: all sums are below 2 ** 53."""
    if small:
        parts = [np.einsum("ij,ij->i", x[at : at + PAIRS].astype(float), q[at : at + PAIRS].astype(float)) for at in range(0, len(x), PAIRS)]
        return np.concatenate([np.zeros(0), *parts]).astype(np.int64), np.zeros(len(x))
    found = [sum(int(a) * int(b) for a, b in zip(*r)) for r in zip(x.tolist(), q.tolist())]
    held = [max(-(2**63), min(2**63 - 1, s)) for s in found]
    return np.array(held, np.int64), np.array([float(s - h) for s, h in zip(found, held)])


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.fx = x, ids, x.astype(float)
        self.value = np.sort(self.fx, axis=0)  # each column is a list
        self.largest = np.abs(self.fx).max(axis=0, initial=0)
        self.sides: dict[tuple, np.ndarray] = {}

    def side(self, to: int, upper: bool, kind) -> np.ndarray:
        """What each row counts for in each list read to a depth from the large end, and next to it from the small end."""
        if (to, upper, kind) not in self.sides:
            x, high, low = self.fx, self.value[len(self.x) - to], self.value[to - 1]
            if upper:
                down, up = np.maximum(x, high), np.minimum(x, low)
            else:  # equal values at the depth may be unread: a row may count for the far end
                down, up = np.where(x > high, x, self.value[0]), np.where(x < low, x, self.value[-1])
            self.sides[to, upper, kind] = np.concatenate([down, up], axis=1).astype(kind).T.copy()
        return self.sides[to, upper, kind]

    def left(self, q: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Pairs (query, row) that may be among the k best, how many list entries each query read, and at which of the
        depths reading stopped. floors: a score that k other rows reach; start: the first depth at which bounds are taken."""
        n, m, used = len(self.x), len(q), (q != 0).sum(axis=1)
        fq, stopped = q.astype(float), start
        may, read = None, np.zeros(m, np.int64)
        if n > k and q.shape[1]:
            mass = np.abs(fq) @ self.largest
            kind = np.float32 if float(mass.max(initial=0)) < 2.0**100 else np.float64
            slack = mass * (2 * q.shape[1] + 8) * (2.0**-22 if kind is np.float32 else 2.0**-51)
            both = np.concatenate([np.maximum(fq, 0), np.minimum(fq, 0)], axis=1).astype(kind)
            for at in range(start, len(DEPTHS)):
                to = n * DEPTHS[at] // 16
                if not to:
                    continue
                least = floors - np.abs(floors) * 2.0**-50 if np.isfinite(floors).all() else self.lower(both, to, kind, own, k, floors, slack)
                upper = both @ self.side(to, True, kind)
                may = upper >= np.nextafter((least - slack).astype(kind), kind(-np.inf))[:, None]
                read, stopped = to * used, at
                if np.count_nonzero(may) <= 4 * k * m:
                    break
        if may is None:
            may = np.ones((m, n), bool)
        at, row = np.divmod(np.flatnonzero(may), n)  # rather than nonzero() of two dimensions, which is slow
        other = self.ids[row] != own[at]
        return at[other], row[other], read, stopped

    def lower(self, both: np.ndarray, to: int, kind, own: np.ndarray, k: int, floors: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """The k-th lower bound of each query, or its floor if that is larger."""
        bound = both @ self.side(to, False, kind)
        bound[self.ids[None, :] == own[:, None]] = -np.inf
        kth = np.partition(bound, len(self.x) - k, axis=1)[:, len(self.x) - k].astype(float) - slack
        return np.maximum(floors, kth)

    def resolve(self, q: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of pairs, and what they lack."""
        small = float(self.largest.max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(1, q.shape[1]) < 2.0**53
        parts = [exact(self.x[row[i : i + PAIRS]], q[at[i : i + PAIRS]], small) for i in range(0, len(at), PAIRS)]
        return np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]]), np.concatenate([np.zeros(0), *[p[1] for p in parts]])

    def topk(self, q: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(scores, what they lack, ids) of one query's k best rows, and how many list entries were read and how many scores resolved."""
        best = Best(q[None, :], np.array([own]), k)
        best.floors[:] = floor
        read, resolved = best.add(self)
        return best.score, best.beyond, best.ids, int(read[0]), int(resolved[0])


class Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int):
        self.q, self.own, self.k, self.floors = q, own, k, np.full(len(q), -np.inf)
        self.at, self.score, self.beyond, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.start, self.met = [0] * -(-len(q) // CHUNK), 0

    def add(self, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
        """Meets a block of candidates; returns how many list entries each query read and how many of its scores were resolved."""
        width = max(self.q.shape[1], lists.x.shape[1])
        self.q = np.pad(self.q, ((0, 0), (0, width - self.q.shape[1])))
        if lists.x.shape[1] < width:
            lists = Lists(np.pad(lists.x, ((0, 0), (0, width - lists.x.shape[1]))), lists.ids)
        read, resolved, new = np.zeros(len(self.q), np.int64), np.zeros(len(self.q), np.int64), []
        self.met += 1
        for i, first in enumerate(range(0, len(self.q), CHUNK)):
            some = slice(first, first + CHUNK)
            start = max(0, self.start[i] - 1) if self.met % AGAIN == 0 else self.start[i]
            at, row, read[some], self.start[i] = lists.left(self.q[some], self.own[some], self.k, self.floors[some], start)
            score, beyond = lists.resolve(self.q[some], at, row)
            resolved[some] = np.bincount(at, minlength=len(self.q[some]))
            worth = score.astype(float) + beyond >= (self.floors[some] - np.abs(self.floors[some]) * 2.0**-50)[at] if np.isfinite(self.floors[some]).all() else slice(None)
            new.append((at[worth] + first, score[worth], beyond[worth], lists.ids[row[worth]]))
        at, score, beyond, ids = (np.concatenate([old, *x]) for old, x in zip((self.at, self.score, self.beyond, self.ids), zip(*new)))
        order = np.lexsort((ids, -beyond, -1 - score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)  # a query's first row has place 0
        keep = place < self.k
        order = order[keep]
        self.at, self.score, self.beyond, self.ids = at[keep], score[order], beyond[order], ids[order]
        last = place[keep] == self.k - 1
        self.floors[self.at[last]] = np.maximum(self.floors[self.at[last]], self.score[last].astype(float) + self.beyond[last])
        return read, resolved


def dealt(rows: DataFrame, block, name: str) -> DataFrame:
    """Rows (id, v) by block, as arrays."""
    return rows.withColumn(name, block).groupBy(name).agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(name, F.col("rows.id").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_vecs"))


def topk(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "vec", counters: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) over integer vectors (array<bigint>); both tables have the same columns.

    counters: instead (query_id, read, resolved) of each candidate block, list entries read and scores resolved."""
    df, queries = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    cblocks = max(1, -(-df.count() // CANDIDATES))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    qblocks = max(1, -(-queries.count() // QUERIES))
    groups = max(1, min(-(-cblocks // 2), -(-TASKS // qblocks)))
    cand = stored(dealt(df, F.pmod(F.monotonically_increasing_id(), F.lit(cblocks)).cast("int"), "turn"), "candidate-blocks")
    ask = stored(dealt(queries, F.pmod(F.xxhash64("id"), F.lit(qblocks)).cast("int"), "q"), "query-blocks")

    def run(batches):
        now, best = None, None

        def rows(found):
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found[:3]), pa.array(found[3], pa.float64())], names=["query_id", "vec_id", "score", "beyond"])

        def results():
            if best is not None and not counters:
                yield rows((best.own[best.at], best.ids, best.score, best.beyond))

        for b in batches:
            for i in range(b.num_rows):
                place, turn = (b.column(0)[i].as_py(), b.column(1)[i].as_py()), b.column(2)[i].as_py()
                ids, x = b.column(3)[i].values.to_numpy(), matrix(b.column(4)[i].values)
                if place != now:
                    yield from results()
                    now, best = place, None
                if turn < 0:
                    best = Best(x, ids, k)
                elif best is not None:
                    read, resolved = best.add(Lists(x, ids))
                    if counters:
                        yield rows((best.own, resolved, read, np.zeros(len(read))))
        yield from results()

    # a task has a block of queries, and then a group of candidate blocks in turn
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = lambda n: (F.col(f"{n}_ids").alias("ids"), F.col(f"{n}_vecs").alias("vecs"))
    asked = ask.withColumn("g", each(groups)).select("q", "g", F.lit(-1).alias("turn"), *columns("q"))
    met = cand.withColumn("q", each(qblocks)).select("q", F.pmod("turn", F.lit(groups)).alias("g"), "turn", *columns("turn"))
    together = asked.unionByName(met).repartition(2 * qblocks * groups, "q", "g").sortWithinPartitions("q", "g", "turn")
    found = together.mapInArrow(run, "query_id long, vec_id long, score long, beyond double")
    if counters:
        return found.select("query_id", F.col("score").alias("read"), F.col("vec_id").alias("resolved"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """floor(scale * x) of each component, of rows whose vector is whole and finite."""
    x = F.col(vec_col)
    whole = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.filter(whole).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vec"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = scaled(table(spark, sf_dir, "embeddings"))
    return topk(rows, rows.filter("vec_id % 100 = 0"))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as vec
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
