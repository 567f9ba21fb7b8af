"""Links found only near the limit, against all pairs, and clashing columns of pages."""

import random

from test_edges import components

from tessera.llm import simhash, warc
from tessera.llm.components import connected_components


def test_links_at_the_limit_against_all_pairs(spark):
    """Chains of fingerprints four bits apart, and pairs five bits apart that must not link."""
    rng, values = random.Random(31), []
    for i in range(120):
        x = rng.getrandbits(64)
        values.append(x)
        for step in range(rng.randint(1, 4)):
            for b in rng.sample(range(64), 4 if i % 2 else 5):
                x ^= 1 << b
            values.append(x)
    fps = {v - (1 << 64) if v >> 63 else v: v for v in values}
    part = {r.node: r.component for r in connected_components(simhash.links(spark.createDataFrame([(k,) for k in fps], "fp long"))).collect()}
    want = components(fps)
    groups = lambda of: sorted(sorted(k for k in fps if of(k) == g) for g in {of(k) for k in fps})
    assert groups(lambda k: part.get(k, k)) == groups(lambda k: want[k])


def test_pivot_table_holds_distances(spark):
    rng = random.Random(32)
    fps = [rng.getrandbits(63) for _ in range(50)]
    refs = [int(p) for p in simhash.pivots()]
    for r in simhash.pivot_table(spark.createDataFrame([(x,) for x in fps], "fp long")).collect():
        assert list(r.coords) == [(r.fp ^ p).bit_count() for p in refs]


def test_pages_with_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a", 9, "d", "k"), (2, "v", "a", 9, "d", "k"), (3, None, None, 9, "d", "k")], "id long, url string, payload string, first long, digest string, kind string")
    got = {r.id: (r.kind, r.refers_to) for r in warc.plan_revisits(df).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None)}
    assert warc.write(df, f"file://{tmp_path}/c").count() == 3
