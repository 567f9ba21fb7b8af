import random

import corpus_pipeline as P
from tessera.session import stored


def test_stages_on_planted_rows(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 6))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [(i, say(150)) for i in range(60)]
    item = say(30)
    rows = clean + [(100, clean[0][1]), (101, clean[1][1] + " end"), (102, say(40) + " " + item + " " + say(40)), (103, say(60) + " mail me@here.example.com " + say(5)), (104, None), (105, "")]
    toxic = [(200 + i, say(30) + " zzgrub zzmuck " + say(9)) for i in range(40)]
    d = f"file://{tmp_path}"
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + toxic], cols).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 200)) for i, _ in rows + toxic], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, d), name)
        ids[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == list(P.COLUMNS)
            docs = out
    base = {i for i, _ in rows}
    assert ids["toxicity"] == base
    assert ids["simhash_near_dedup"] == base - {100, 101, 105}
    assert ids["decontamination"] == ids["pii"] == ids["packing"] == base - {100, 101, 102, 105}
    assert "[EMAIL]" in docs.filter("doc_id = 103").first().text
    whole = P.run(spark, d)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == ids["packing"]


def test_near_copies_go_through_simhash(spark, monkeypatch):
    """SimHash groups propose pairs first, and they are verified: texts with one fingerprint but unlike shingles both stay."""
    from tessera.llm import simhash

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 6))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    rows = [*enumerate(texts), (50, texts[3].replace(" ", "  ")), (51, texts[4] + " end"), (60, None), (61, "")]
    rows += [(70, "one two three four five six"), (71, "one two three four five six seven eight nine ten")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    proposed, verified, pairs, alike = [], [], simhash.fingerprint_pairs, simhash.alike

    def seen(*args):
        proposed.append(pairs(*args))
        return proposed[-1]

    def checked(some, *args):
        verified.append(some)
        return alike(some, *args)

    monkeypatch.setattr(simhash, "fingerprint_pairs", seen)
    monkeypatch.setattr(simhash, "alike", checked)
    monkeypatch.setattr(simhash, "fingerprint", lambda text, words, of=simhash.fingerprint: 5 if text.startswith(b"one") else of(text, words))
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == set(range(20)) | {60, 70, 71}
    assert len(proposed) == 1 and proposed[0].count() >= 2 and verified[0] is proposed[0]


def test_empty_tables(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).count() == 0
