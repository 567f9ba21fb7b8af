"""Training and prediction from files to files, with the command line.

    python -m tessera.plans.linkage --train --predict --train-dir DIR --test-dir DIR --output-dir DIR
    python -m tessera.plans.linkage --validate --train-dir DIR [--ablations]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocking, diagnostics, entities, features, metrics, model, select, trainset
from tessera.session import prepare, stored
from tessera.sources import tsv

TOP_K, SEED, DEFAULT_TAU = 300, 42, 0.50


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entities, targets) in normal form, stored once as every stage reads them."""
    s1 = tsv.with_position(tsv.read_source(spark, f"{folder}/source1.tsv"))
    targets = tsv.read_targets(spark, f"{folder}/source2.tsv", f"{folder}/source3.tsv")
    return stored(entities.normalise(s1), "s1"), stored(entities.normalise(targets), "targets")


def training_features(s1: DataFrame, targets: DataFrame, truth: DataFrame, top_k: int = TOP_K) -> DataFrame:
    cands = stored(blocking.candidates(s1, targets, top_k), "train-candidates")
    pairs = trainset.prune_negatives(trainset.label_pairs(trainset.inject_positives(cands, truth, s1, targets), truth))
    return stored(features.pair_features(pairs, s1, targets), "train-features")


def tau_by_entity(s1: DataFrame, by_country: dict[str, float]) -> DataFrame | None:
    if not by_country:
        return None
    taus = F.create_map(*[F.lit(x) for kv in by_country.items() for x in kv])
    return s1.select(F.col("entity_id").alias("s1_id"), F.try_element_at(taus, F.coalesce("country", F.lit(""))).alias("tau")).filter("tau is not null")


def run_training(spark: SparkSession, train_dir: str, model_dir: str, sample_size: int | None = 250_000, val_fraction: float = 0.20, tune: bool = False, cv_folds: int = 5, n_trials: int = 4, params: dict | None = None, top_k: int = TOP_K, min_country: int = 1000, threshold_range=None) -> dict:
    """Fits, calibrates and saves; returns the metadata, whose best_tau is the pooled threshold."""
    prepare(spark)
    s1, targets = load(spark, train_dir)
    _, truth = tsv.read_truth(spark, f"{train_dir}/ground_truth.tsv")
    truth = stored(truth, "truth")
    s1 = entities.random_sample(s1, sample_size)
    split = stored(entities.stratified_split(s1, val_fraction), "split")
    fit, val = split.filter("not is_validation").drop("is_validation"), split.filter("is_validation").drop("is_validation")
    train = training_features(fit, targets, truth, top_k)
    weight = trainset.class_weight(train).first().weight
    if tune:
        fitted, won, cv = model.tune(train, n_trials, cv_folds, weight)
    else:
        fitted, won, cv = model.train(train, weight, params), params or {}, {}
    model.save(fitted, f"{model_dir}/model")
    cands = stored(blocking.candidates(val, targets, top_k), "val-candidates")
    scored = stored(model.score(fitted, features.pair_features(cands.select("s1_id", "target_id"), val, targets)), "val-scores")
    spine = val.select(F.col("entity_id").alias("s1_id"), "country")
    known = truth.join(spine, "s1_id", "left_semi")
    if scored.isEmpty():
        tau, f05, by_country = DEFAULT_TAU, 0.0, {}
    else:
        tau, f05 = metrics.best_threshold(scored, known, spine, threshold_range)
        by_country = metrics.country_thresholds(scored, known, spine, tau, min_country)
    pooled = f05
    picked = select.select_pairs(scored, tau, threshold_by_s1=tau_by_entity(val, by_country))
    report = metrics.micro_report(spine, picked, known).first()
    if by_country:
        f05 = metrics.macro_f05(spine, picked, known).first().macro_f05
    recall = diagnostics.candidate_recall(cands, known).first().recall
    meta = {"best_tau": tau, "country_thresholds": by_country, "best_macro_f05": f05, "pooled_macro_f05": pooled, "precision": report.precision, "recall": report.recall, "singleton_accuracy": report.singleton_accuracy, "candidate_recall": recall, "val_sample_size": val.count(), "total_sample_size": s1.count(), "cv_tuning_performed": tune, "winning_hyperparams": won, "cv_metrics": cv}
    tsv.write_metadata(spark, f"{model_dir}/metadata", meta)
    return meta | {"frames": (val, targets, known, cands, picked)}


def run_prediction(spark: SparkSession, test_dir: str, output_dir: str, model_dir: str, threshold: float | None = None, top_k: int = TOP_K) -> dict:
    """Writes the candidates and the matches of all entities; returns the counts of the summary."""
    prepare(spark)
    tau, by_country = tsv.read_metadata(spark, f"{model_dir}/metadata", threshold)
    s1, targets = load(spark, test_dir)
    fitted = model.load(spark, f"{model_dir}/model")
    cands = stored(blocking.candidates(s1, targets, top_k), "candidates")
    scored = select.probability_floor(model.score(fitted, features.pair_features(cands.select("s1_id", "target_id"), s1, targets)))
    picked = stored(select.select_pairs(scored, tau, threshold_by_s1=tau_by_entity(s1, by_country)), "matches")
    spine = stored(tsv.in_file_order(s1.select(F.col("entity_id").alias("s1_id"), "doc_ord")).select("s1_id", "ord"), "spine")
    tsv.write_submission(tsv.candidate_submission(spine, cands), f"{output_dir}/candidates")
    tsv.write_submission(tsv.match_submission(spine, picked), f"{output_dir}/matches")
    return metrics.prediction_summary(spine, picked).first().asDict()


def run_validation(spark: SparkSession, train_dir: str, model_dir: str, ablations: bool = False, **options) -> dict:
    """Hold-out metrics, one threshold per calibrated country, and the diagnostic tables."""
    meta = run_training(spark, train_dir, model_dir, **options)
    val, targets, truth, cands, picked = meta.pop("frames")
    spine = val.select(F.col("entity_id").alias("s1_id"))
    out = {k: meta[k] for k in ("best_tau", "precision", "recall", "singleton_accuracy", "candidate_recall", "pooled_macro_f05")} | {"macro_f05": meta["best_macro_f05"]}
    out["full_candidate_coverage"] = diagnostics.full_coverage(cands, truth).first().coverage
    out["candidate_oracle_macro_f05"] = metrics.macro_f05(spine, diagnostics.oracle_predictions(cands, truth), truth).first().macro_f05
    out |= {f"threshold_{c or 'unknown'}": t for c, t in meta["country_thresholds"].items()}
    tables = {"countries": diagnostics.country_report(val, cands, picked, truth), "misses": diagnostics.miss_signatures(cands, truth, val, targets), "crossings": diagnostics.cross_country(truth, val, targets)}
    if ablations:
        tables |= {"channels": diagnostics.channel_ablation(val, targets, truth), "caps": diagnostics.cap_ablation(val, targets, truth)}
    return out | {"tables": tables}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for flag in ("--train", "--predict", "--validate", "--tune", "--ablations"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--sample-size", "--train-sample-size", type=int, default=250_000)
    p.add_argument("--whole-data", "--all-data", action="store_true")
    p.add_argument("--val-fraction", type=float, default=0.20)
    p.add_argument("--cv-folds", type=int, default=5)
    p.add_argument("--n-trials", type=int, default=4)
    p.add_argument("--train-dir", default="train")
    p.add_argument("--test-dir", default="test")
    p.add_argument("--output-dir", default="output")
    p.add_argument("--model-dir", default="model")
    p.add_argument("--threshold", type=float)
    p.add_argument("--threshold-range", type=float, nargs=3)
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    options = {"sample_size": None if o.whole_data else o.sample_size, "val_fraction": o.val_fraction, "tune": o.tune, "cv_folds": o.cv_folds, "n_trials": o.n_trials, "threshold_range": o.threshold_range}
    if o.validate:
        found = run_validation(spark, o.train_dir, o.model_dir, o.ablations, **options)
        for table in found.pop("tables").values():
            table.show(100, False)
        print(found)
        return
    if o.train or not o.predict:
        meta = run_training(spark, o.train_dir, o.model_dir, **options)
        meta.pop("frames")
        print(meta)
    if o.predict or not o.train:
        print(run_prediction(spark, o.test_dir, o.output_dir, o.model_dir, o.threshold))


if __name__ == "__main__":
    main()
