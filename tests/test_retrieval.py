"""Candidates by blocks and shards equal the selection from all scored pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import blocking, entities, retrieval

EVERY = blocking.CHANNELS


def entity_rows(rng, prefix, n):
    words = ["harbor", "harbour", "alpha", "beta", "gamma", "delta", "maple", "oak", "stone", "river", "x1", "co"]
    weights = [30, 20, 12, 8, 5, 3, 3, 2, 2, 1, 1, 1]
    rows = []
    for i in range(n):
        name = " ".join(rng.choices(words, weights, k=rng.randint(0, 4)))
        streets = " ".join(rng.choices(["maple", "oaken", "river", "maple"], k=rng.randint(0, 3)))
        address = rng.choice([None, "", f"{rng.randint(1, 9)} {streets} road {rng.randint(1, 4)} {10000 + rng.randint(0, 5)}"])
        rows.append((f"{prefix}-{i}", rng.choice([i, i // 3]), name, address, rng.choice(["US", "US", "US", "France", "", None, "  "])))
    return rows


def sides(spark, rng, queries, targets):
    kind = "entity_id string, doc_ord long, business_name string, business_address string, country string"
    return [entities.normalise(spark.createDataFrame(r, kind)).cache() for r in (queries, targets)]


@pytest.mark.parametrize("shard,block", [(1 << 15, 1 << 11), (7, 4)])
def test_equals_the_selection_from_all_pairs(spark, monkeypatch, shard, block):
    monkeypatch.setattr(retrieval, "SHARD", shard)
    monkeypatch.setattr(retrieval, "SMALL", block)
    rng = random.Random(shard)
    # S2-0 twice at one place: its keys count twice; one partition where every target has one token, whose points are zero
    targets = [*entity_rows(rng, "S2", 150), ("S2-900", 5, "harbor maple", "3 maple road 2 10001", "US"), ("S2-900", 5, "harbor maple", "3 maple road 2 10001", "US"), ("S2-901", 1, "solo", None, "Chile"), ("S2-902", 2, "solo", None, "Chile")]
    queries = [*entity_rows(rng, "S1", 60), ("S1-900", 1, "solo", None, "Chile"), ("S1-901", 1, "nothing alike", None, "Peru")]
    s1, tg = sides(spark, rng, queries, targets)
    for channels, ks in ((blocking.DEFAULT_CHANNELS, (12,)), (EVERY, (2, 40))):
        scored = blocking.scores(s1, tg, channels).cache()
        for k in ks:
            want = sorted(tuple(r) for r in blocking.select_reserved(scored, k).select("s1_id", "rank", "target_id", "doc_ord", "combined").collect())
            got = sorted(tuple(r) for r in blocking.candidates(s1, tg, k, channels).select("s1_id", "rank", "target_id", "doc_ord", "combined").collect())
            assert got == want and want
    tokens = blocking.scores(s1, tg, ["name_tokens"])
    order = Window.partitionBy("s1_id").orderBy(F.desc("combined"), "doc_ord", "target_id")
    want = tokens.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    assert sorted(tuple(r) for r in want.select("s1_id", "target_id", "rank", "combined").collect()) == sorted(tuple(r) for r in blocking.token_topk(s1, tg, 5).collect())
    assert {(r.s1_id, r.combined) for r in blocking.candidates(s1, tg, 5, ["name_tokens"]).filter("s1_id = 'S1-900'").collect()} == {("S1-900", 0.0)}


def test_makes_no_row_for_each_hit(spark):
    """Alike entities: the pairs are n * n, what is written before the candidates is not."""
    n = 600
    s1, tg = sides(spark, None, [(f"S1-{i}", i, "harbor maple", None, "US") for i in range(n)], [(f"S2-{i}", i, "harbor maple", None, "US") for i in range(n)])
    asked, postings = blocking._sides(s1, tg, blocking.DEFAULT_CHANNELS)
    rows = []
    keep = retrieval.stored

    def counted(df, name):
        out = keep(df, name)
        rows.append((name, out.count()))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval, "stored", counted)
        found = retrieval.retrieve(asked, postings, lambda p: blocking.usable_keys(p, tg), retrieval.reserved_slots(12), 12)
        assert found.count() == 12 * n and max(c for _, c in rows) <= 12 * n


def test_empty_sides(spark):
    s1, tg = sides(spark, None, [("S1-1", 0, "harbor", None, "US")], [("S2-1", 0, "alpha", None, "US")])
    assert blocking.candidates(s1, tg, 12).count() == 0
    assert blocking.candidates(s1.limit(0), tg, 12, fallback=True).count() == 0 and blocking.token_topk(s1, tg.limit(0), 12).count() == 0
