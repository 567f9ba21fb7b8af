import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking, entities, metrics, select, trainset
from tessera.plans import linkage
from tessera.sources import tsv
from tessera.streaming import records


def test_sweep_equals_recomputation(spark):
    rng = random.Random(3)
    ids = [f"S1-{i}" for i in range(30)]
    truth = [(s, f"S2-{rng.randint(0, 9)}") for s in ids if rng.random() < 0.7 for _ in range(rng.randint(1, 3))]
    scored = [(s, f"S2-{j}", round(rng.random(), 2)) for s in ids for j in rng.sample(range(10), 4)]
    spine = spark.createDataFrame([(s, None) for s in ids], "s1_id string, country string")
    t, p = spark.createDataFrame(truth, "s1_id string, target_id string"), spark.createDataFrame(scored, "s1_id string, target_id string, match_prob double")
    got = {r.tau: r.macro_f05 for r in metrics.sweep(p, t, spine, metrics.tau_table(spark, [0.1, 0.35, 0.5, 0.9])).collect()}
    for tau, score in got.items():
        total = 0.0
        for s in ids:
            gt, pred = {x for a, x in truth if a == s}, {x for a, x, q in scored if a == s and q >= tau}
            tp = len(gt & pred)
            total += (1.0 if not pred else 0.0) if not gt else (1.25 * tp / (0.25 * len(gt) + len(pred)) if tp else 0.0)
        assert score == pytest.approx(total / len(ids), abs=1e-9)


def test_thresholds_without_data(spark):
    spine = spark.createDataFrame([("S1-1", "US"), ("S1-2", "US")], "s1_id string, country string")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, target_id string")
    none = spark.createDataFrame([], "s1_id string, target_id string, match_prob double")
    assert metrics.best_threshold(none, truth, spine.limit(0)) == (1.0, 0.0)
    assert metrics.best_threshold(none, truth, spine) == (1.0, 0.5)
    with pytest.raises(ValueError):
        metrics.explicit_grid(0.5, 0.4, 0.1)


def test_entity_f05(spark):
    rows = [(1, 1, 2), (1, 2, 1), (0, 0, 0), (0, 1, 0), (0, 0, 1)]
    df = spark.createDataFrame(rows, "t int, p int, g int").select(metrics.entity_f05(F.col("t"), F.col("p"), F.col("g")).alias("f"))
    assert [round(r.f, 6) for r in df.collect()] == [0.833333, 0.555556, 1, 0, 0]


def test_prune_spreads_over_the_rest(spark):
    rows = [("S1-1", f"S2-{i}", i, 0) for i in range(41)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, rank int, label int")
    assert sorted(r["rank"] for r in trainset.prune_negatives(df).collect()) == [*range(20), 20, 22, 24, 27, 29, 31, 33, 36, 38, 40]
    with pytest.raises(ValueError):
        trainset.prune_negatives(df, -1)


def test_select_prefix_and_threshold(spark):
    rows = [("S1-1", "S2-1", 0.5), ("S1-1", "X9-1", 0.9), ("S1-1", "s2-1", 0.9), ("S1-1", "S3-1", 0.4), ("S1-2", "S3-1", 0.3)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, match_prob double")
    assert [(r.s1_id, r.target_id) for r in select.select_pairs(df, 0.5).collect()] == [("S1-1", "S2-1")]
    taus = spark.createDataFrame([("S1-2", 0.3)], "s1_id string, tau double")
    assert select.select_pairs(df, 0.5, threshold_by_s1=taus).count() == 2


def test_partitions_and_channels(spark):
    rows = [("S1-1", 0, "Johnson Johnston", "12 maple maple road", "US"), ("S1-2", 1, None, None, None), ("S1-3", 2, "X", "", "  "), ("S1-4", 3, "Y", "1 a", "")]
    df = entities.normalise(spark.createDataFrame(rows, "entity_id string, doc_ord long, business_name string, business_address string, country string"))
    assert [r.part_key for r in entities.partitions(df).collect()] == ["US", entities.UNKNOWN]
    keys = [(r.channel, r.key) for r in blocking.channel_keys(df).filter("entity_id = 'S1-1'").collect()]
    assert keys.count(("prefix", "john$")) == 2 and keys.count(("compound_address", "a_maple_12")) == 2
    asked = [(r.channel, r.key) for r in blocking.channel_keys(df, query=True).filter("entity_id = 'S1-1'").collect()]
    assert asked.count(("compound_address", "a_maple_12")) == 1
    with pytest.raises(ValueError):
        blocking.usable(["nothing"])


def test_reserved_selection_against_a_sequential_model(spark):
    rng = random.Random(4)
    rows = []
    for s in range(40):
        for t in rng.sample(range(60), rng.randint(1, 30)):
            fam = {f: round(rng.choice([0.5, 1.0, 2.0, 4.0]) * rng.randint(1, 3), 2) if rng.random() < 0.4 else None for f in ("core", "token", "number", "postal", "address")}
            rows.append((f"S1-{s}", f"S2-{t}", t, *fam.values(), round(sum((v or 0.0 for v in fam.values()), 0.0), 9)))
    df = spark.createDataFrame(rows, "s1_id string, target_id string, doc_ord long, core double, token double, number double, postal double, address double, combined double")
    got = {}
    for r in blocking.select_reserved(df, 12).orderBy("s1_id", "rank").collect():
        got.setdefault(r.s1_id, []).append(r.doc_ord)
    for s in {r[0] for r in rows}:
        mine, picked = {r[2]: r for r in rows if r[0] == s}, set()
        for at, by, n in ((3, 3, 4), (5, 5, 2), (6, 6, 2), (7, 8, 4), (8, 8, 12)):
            n = n if at != 8 else 12 - len(picked)
            left = sorted((t for t, r in mine.items() if r[at] is not None and t not in picked), key=lambda t: (-mine[t][by], t))
            picked |= set(left[:n])
        assert got[s] == sorted(picked, key=lambda t: (-mine[t][8], t))


def write_tsvs(folder, n=60):
    rng = random.Random(5)
    stems = ["Alpha", "Bravo", "Cobalt", "Delta", "Ember", "Falcon", "Granite", "Harbor", "Indigo", "Juniper", "Krypton", "Lumen"]
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    s1, s2, s3, gt = head, head, head, "s1_id\tids\n"
    for i in range(n):
        name, addr, country = f"{rng.choice(stems)} {rng.choice(stems)} {i}x", f"{100 + i} {rng.choice(stems)} road {10000 + 7 * i}", rng.choice(["US", "France", "NA"])
        s1 += f"S1-{i}\t{name} Inc\t{addr}\t{country}\n"
        s2 += f"S2-{i}\t{name.upper()}\t{addr}\t{country}\n"
        s3 += f"S3-{i}\t\"{rng.choice(stems)} \"\"{rng.choice(stems)}\"\"\"\tnull\t{country}\n"
        gt += f"S1-{i}\tS2-{i}\n" if i % 3 else f"S1-{i}\n"
    for name, text in (("source1", s1), ("source2", s2), ("source3", s3), ("ground_truth", gt + "\n")):
        (folder / f"{name}.tsv").write_text(text)


def test_sources(spark, tmp_path):
    write_tsvs(tmp_path, 6)
    df = tsv.read_source(spark, f"file://{tmp_path}/source3.tsv")
    assert df.count() == 6 and df.filter("business_address is null").count() == 6
    assert '"' in df.first().business_name
    assert tsv.read_source(spark, f"file://{tmp_path}/source1.tsv", ["entity_id"], 2).count() == 2
    (tmp_path / "t.tsv").write_text("s\tids\nS1-1\t S2-1, ,S3-2 \n\nS1-2\nS1-1\tS2-9,S2-9\n")
    spine, pairs = tsv.read_truth(spark, f"file://{tmp_path}/t.tsv")
    assert sorted(r[0] for r in spine.collect()) == ["S1-1", "S1-2"] and [tuple(r) for r in pairs.collect()] == [("S1-1", "S2-9")]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tsv").write_text((tmp_path / "source1.tsv").read_text())
    q = records.stream_source(spark, f"file://{folder}").writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 6


def test_metadata(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert tsv.read_metadata(spark, path) == (0.5, {})
    tsv.write_metadata(spark, path, {"best_tau": 0.7, "country_thresholds": {"US": 0.8}})
    assert tsv.read_metadata(spark, path) == (0.7, {"US": 0.8})
    assert tsv.read_metadata(spark, path, 0.9) == (0.9, {})


def test_files_to_files(spark, tmp_path):
    write_tsvs(tmp_path)
    base = f"file://{tmp_path}"
    found = linkage.run_validation(spark, base, f"{base}/model", params={"rounds": 5, "max_depth": 3}, top_k=12, min_country=5, val_fraction=0.4)
    assert found["candidate_recall"] == 1 and found["candidate_oracle_macro_f05"] == 1
    counts = linkage.run_prediction(spark, base, f"{base}/out", f"{base}/model", top_k=12)
    assert counts["total"] == 60 and counts["matched"] + counts["singletons"] == 60
    lines = [line for p in sorted((tmp_path / "out/candidates").glob("part-*")) for line in p.read_text().split("\n")[:-1]]
    assert lines[0] == "source1_entity_id\tcandidate_entity_ids" and [x.split("\t")[0] for x in lines[1:]] == [f"S1-{i}" for i in range(60)]
    folder = tmp_path / "arriving"
    folder.mkdir()
    (folder / "a.tsv").write_text((tmp_path / "source1.tsv").read_text())
    _, targets = linkage.load(spark, base)
    fitted, (tau, _) = linkage.model.load(spark, f"{base}/model/model"), tsv.read_metadata(spark, f"{base}/model/metadata")
    q = records.link_stream(records.stream_source(spark, f"file://{folder}"), targets, fitted, f"{base}/linked", f"{base}/ck", tau, 12)
    assert q.awaitTermination(120) is not False and q.exception() is None
    streamed = spark.read.parquet(f"{base}/linked").select("s1_id").distinct().count()
    assert streamed == linkage.run_prediction(spark, base, f"{base}/out2", f"{base}/model", threshold=tau, top_k=12)["matched"]
    with pytest.raises(FileNotFoundError):
        linkage.model.load(spark, f"{base}/nowhere")


def test_auc_and_log_loss(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (0, 0.2), (1, 0.25)]
    df = spark.createDataFrame(rows, "label int, match_prob double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert linkage.model.auc(df).first()[0] == pytest.approx(want)
    assert linkage.model.log_loss(df).first()[0] == pytest.approx(sum(-math.log(p if y else 1 - p) for y, p in rows) / 6)


def test_columns_by_name_and_fields_over_lines(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("country\tentity_id\textra\tbusiness_address\tbusiness_name\nUS\tS1-1\tz\tNA\tAcme\n")
    assert tuple(tsv.read_source(spark, f"file://{tmp_path}/o.tsv").first()) == ("S1-1", "Acme", None, "US")
    (tmp_path / "q.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"two\nlines"\ta\tUS\nS1-2\tb\tc\tUS\n')
    assert [r.business_name for r in tsv.read_source(spark, f"file://{tmp_path}/q.tsv").orderBy("entity_id").collect()] == ["two\nlines", "b"]
    (tmp_path / "m.tsv").write_text("entity_id\tcountry\nS1-1\tUS\n")
    with pytest.raises(ValueError, match="business_name"):
        tsv.read_source(spark, f"file://{tmp_path}/m.tsv")
    assert tsv.read_source(spark, f"file://{tmp_path}/m.tsv", ["country"]).first().country == "US"
