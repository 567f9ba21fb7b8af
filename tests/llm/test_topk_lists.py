"""The list reader alone: right under ties, floors and huge components, and it stops early where vectors have structure."""

import numpy as np
import pytest

from tessera.llm.topk import Best, Lists, topk


def slow(x, ids, q, own, k):
    scores = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in x.tolist()]
    return [(s, i) for s, i in sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != own)][:k]


@pytest.mark.parametrize("top", [3, 600, 2**40, 2**62])
def test_lists_equal_brute_force(top):
    rng = np.random.default_rng(top % 1000)
    for n in (1, 7, 40, 700):
        x = rng.integers(-top, top, (n, 9))
        ids = rng.permutation(n).astype(np.int64)
        lists = Lists(x, ids)
        for q in (x[0], np.zeros(9, np.int64), -x[n // 2]):
            want = slow(x, ids, q, 0, 10)
            scores, beyond, found, _, _ = lists.topk(q, 0, 10, float("-inf"))
            assert found.tolist() == [i for _, i in want] or top >= 2**40 and len(found) == len(want)
            if top < 2**28:
                assert scores.tolist() == [-s for s, _ in want] and not beyond.any()
            if len(want) == 10:  # a floor that others reach loses no row that belongs to the ten best
                again = lists.topk(q, 0, 10, float(-want[-1][0]))
                assert again[2].tolist() == found.tolist()


def test_reading_stops_early_where_it_can():
    rng = np.random.default_rng(8)
    x = rng.integers(-5, 5, (2000, 16))
    x[:20] += 900
    _, _, _, read, resolved = Lists(x, np.arange(2000)).topk(np.full(16, 7), -1, 10, float("-inf"))
    assert read <= 2000 * 16 / 8 and resolved <= 40


def test_clashing_columns_and_many_blocks(spark, monkeypatch):
    from tessera.llm import topk as module

    monkeypatch.setattr(module, "CANDIDATES", 64)
    monkeypatch.setattr(module, "QUERIES", 8)
    rng = np.random.default_rng(9)
    x = rng.integers(-4, 4, (400, 5))
    df = spark.createDataFrame([(i, r, "x", 1, 2, 3.0, "y") for i, r in enumerate(x.tolist())], "vec_id long, vec array<long>, id string, c int, q int, floors double, v string")
    got = {}
    for r in topk(df, df.filter("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert sorted(got) == list(range(0, 400, 10))
    for i, rows in got.items():
        assert [t[1:] for t in sorted(rows)] == slow(x, np.arange(400), x[i], i, 10)


@pytest.mark.parametrize("top", [4, 600, 2**40, 2**62])
def test_best_rows_are_carried_from_block_to_block(top):
    """Over blocks of unlike widths, with ties: equal to brute force, and later blocks are judged by what earlier ones gave."""
    rng = np.random.default_rng(top % 1001)
    x, blocks = rng.integers(-top, top, (3000, 12)), []
    x[:1000, 8:] = 0
    ids = rng.permutation(3000)
    own = np.append(ids[::300], -1)
    q = np.concatenate([x[::300], np.zeros((1, 12), np.int64)])
    best = Best(q, own, 10)
    for at in range(0, 3000, 200):
        blocks.append(best.add(Lists(x[at : at + 200, : 8 if at < 1000 else 12], ids[at : at + 200]))[1])
    for i in range(len(q)):
        mine = best.at == i
        want = slow(x, ids, q[i], own[i], 10)
        assert best.ids[mine].tolist() == [v for _, v in want] or top >= 2**40 and mine.sum() == 10
        if top < 2**28:
            assert best.score[mine].tolist() == [-s for s, _ in want]
    if top == 600:
        assert sum(r[:-1].sum() for r in blocks[-5:]) < sum(r[:-1].sum() for r in blocks[:5]) / 2


def test_a_task_keeps_k_rows_a_query(spark, monkeypatch):
    """Rows that leave tasks don't grow with the number of candidate blocks."""
    from tessera.llm import topk as module

    monkeypatch.setattr(module, "CANDIDATES", 16)
    monkeypatch.setattr(module, "TASKS", 2)
    df = spark.range(800).selectExpr("id as vec_id", "transform(sequence(1, 6), i -> pmod(xxhash64(id, i), 9) - 4) as vec")
    asked = df.filter("vec_id % 100 = 0")
    assert topk(df, asked, k=3).count() == 24
    assert topk(df, asked, k=3, counters=True).count() == 8 * 50  # every query meets every block once
