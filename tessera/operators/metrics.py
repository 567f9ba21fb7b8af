"""Macro F0.5, threshold search and reports. Every mean starts from the list of entities, so that those
without pairs count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def entity_f05(tp: Column, n_pred: Column, n_gt: Column) -> Column:
    """F0.5 of one entity: 1 for nothing predicted where nothing is true, 0 for no hit."""
    return F.when((n_gt == 0) & (n_pred == 0), 1.0).when((n_gt == 0) | (n_pred == 0) | (tp == 0), 0.0).otherwise(1.25 * tp / (0.25 * n_gt + n_pred))


def entity_counts(spine: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, the spine's other columns, n_pred, n_gt, tp)."""
    pred = predicted.select("s1_id", "target_id").distinct().withColumn("__p", F.lit(1))
    true = truth.select("s1_id", "target_id").distinct().withColumn("__g", F.lit(1))
    both = pred.join(true, ["s1_id", "target_id"], "full").groupBy("s1_id").agg(
        F.count("__p").alias("n_pred"), F.count("__g").alias("n_gt"), F.count(F.when(F.col("__p").isNotNull() & F.col("__g").isNotNull(), 1)).alias("tp")
    )
    return spine.join(both, "s1_id", "left").fillna(0, ["n_pred", "n_gt", "tp"])


def macro_f05(spine: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (entities, macro_f05); 0 for no entities."""
    counts = entity_counts(spine.select("s1_id"), predicted, truth)
    score = F.avg(entity_f05(F.col("tp"), F.col("n_pred"), F.col("n_gt")))
    return counts.agg(F.count("*").alias("entities"), F.coalesce(score, F.lit(0.0)).alias("macro_f05"))


def valid_pairs(scored: DataFrame, spine: DataFrame) -> DataFrame:
    """(s1_id, target_id, match_prob): the best probability of each pair of a known entity and an S2 or S3 target."""
    ok = F.col("target_id").startswith("S2-") | F.col("target_id").startswith("S3-")
    kept = scored.filter(ok & F.col("match_prob").isNotNull()).join(spine.select("s1_id"), "s1_id", "left_semi")
    return kept.groupBy("s1_id", "target_id").agg(F.max("match_prob").alias("match_prob"))


def score_steps(scored: DataFrame, truth: DataFrame, spine: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, match_prob, gain): what the sum of entity scores gains as the threshold falls to each probability."""
    true = truth.select("s1_id", "target_id").distinct()
    n_gt = true.groupBy("s1_id").agg(F.count("*").alias("n_gt"))
    steps = valid_pairs(scored, spine).join(true.withColumn("__g", F.lit(1)), ["s1_id", "target_id"], "left")
    steps = steps.groupBy("s1_id", "match_prob").agg(F.count("*").alias("p"), F.count("__g").alias("t"))
    steps = steps.join(n_gt, "s1_id", "left").fillna(0, ["n_gt"])
    down = Window.partitionBy("s1_id").orderBy(F.desc("match_prob")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("cp", F.sum("p").over(down)).withColumn("ct", F.sum("t").over(down))
    after = entity_f05(F.col("ct"), F.col("cp"), F.col("n_gt"))
    before = entity_f05(F.col("ct") - F.col("t"), F.col("cp") - F.col("p"), F.col("n_gt"))
    steps = steps.withColumn("gain", after - before)
    if by:
        steps = steps.join(spine.select("s1_id", *by), "s1_id")
    return steps.groupBy(*by, "match_prob").agg(F.sum("gain").alias("gain"))


def tau_table(spark: SparkSession, taus: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in sorted(set(taus))], "tau double")


def sweep(scored: DataFrame, truth: DataFrame, spine: DataFrame, taus: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, tau, entities, macro_f05) at every threshold of taus, a table of some dozens of rows.

    Entities' scores change only where a pair is let in, so one pass gives all thresholds."""
    true = truth.select("s1_id").distinct().withColumn("__g", F.lit(1))
    base = spine.join(true, "s1_id", "left").groupBy(*by).agg(F.count("*").alias("entities"), F.count(F.when(F.col("__g").isNull(), 1)).alias("base"))
    grid = base.crossJoin(F.broadcast(taus))  # thresholds times countries
    steps = score_steps(scored, truth, spine, by)
    on = [grid[c].eqNullSafe(steps[c]) for c in by] + [steps["match_prob"] >= grid["tau"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = grid.join(steps, cond, "left").groupBy(*[grid[c] for c in by], grid["tau"], grid["entities"], grid["base"]).agg(F.sum("gain").alias("gain"))
    return joined.select(*by, "tau", "entities", F.when(F.col("entities") > 0, (F.col("base") + F.coalesce("gain", F.lit(0.0))) / F.col("entities")).otherwise(0.0).alias("macro_f05"))


def coarse_grid() -> list[float]:
    return [0.10 + 0.05 * i for i in range(18)]


def fine_grid(center: float) -> list[float]:
    """Thresholds around the coarse winner, without those of the coarse grid."""
    lo, hi, step = max(0.05, center - 0.06), min(0.995, center + 0.06), 0.005
    fine, i = [], 0
    while (t := lo + i * step) < hi + step / 2:
        fine.append(t)
        i += 1
    return [t for t in fine if all(abs(t - c) > 1e-4 for c in coarse_grid())]


def explicit_grid(start: float, stop: float, step: float) -> list[float]:
    if step <= 0 or stop < start:
        raise ValueError("a threshold range needs a positive step and a stop at or beyond its start")
    out, i = [], 0
    while (t := start + i * step) < stop + step * 0.5:
        out.append(t)
        i += 1
    return out


def best_threshold(scored: DataFrame, truth: DataFrame, spine: DataFrame, threshold_range: tuple[float, float, float] | None = None) -> tuple[float, float]:
    """(tau, macro F0.5): coarse, then fine around the winner; the lowest of equals in a sweep, and a later
    sweep only if it is better. (1, 0) for no entities, (1, share without true pairs) for no pairs."""
    spark = spine.sparkSession
    if spine.isEmpty():
        return 1.0, 0.0
    if valid_pairs(scored, spine).isEmpty():
        nothing = scored.limit(0)
        return 1.0, macro_f05(spine, nothing, truth).first().macro_f05
    best = (0.50, -1.0)

    def run(taus: list[float], best: tuple[float, float]) -> tuple[float, float]:
        for r in sweep(scored, truth, spine, tau_table(spark, taus)).orderBy("tau").collect():
            if r.macro_f05 > best[1]:
                best = (r.tau, r.macro_f05)
        return best

    if threshold_range is not None:
        return run(explicit_grid(*threshold_range), best)
    best = run(coarse_grid(), best)
    return run(fine_grid(best[0]), best)


def country_thresholds(scored: DataFrame, truth: DataFrame, spine: DataFrame, pooled: float, min_entities: int = 1000) -> dict[str, float]:
    """Thresholds of countries with enough entities whose own best threshold beats the pooled one there.

    spine has (s1_id, country); a null country has the key ''."""
    spark = spine.sparkSession
    spine = spine.select("s1_id", F.coalesce("country", F.lit("")).alias("country"))
    counts = spine.groupBy("country").count().filter(F.col("count") >= min_entities)
    spine = spine.join(counts, "country", "left_semi")

    def run(taus: list[float]) -> list:
        return sweep(scored, truth, spine, tau_table(spark, taus), by=("country",)).orderBy("country", "tau").collect()

    best: dict[str, tuple[float, float]] = {}
    coarse = run(coarse_grid())
    for r in coarse:
        if r.macro_f05 > best.get(r.country, (0, -1.0))[1]:
            best[r.country] = (r.tau, r.macro_f05)
    if not best:
        return {}
    wanted = {c: set(fine_grid(t)) for c, (t, _) in best.items()}
    for r in run(sorted({t for ts in wanted.values() for t in ts} | {pooled})):
        if r.tau in wanted[r.country] and r.macro_f05 > best[r.country][1]:
            best[r.country] = (r.tau, r.macro_f05)
        if r.tau == pooled:
            best.setdefault(f"pooled {r.country}", (r.tau, r.macro_f05))
    return {c: t for c, (t, s) in best.items() if not c.startswith("pooled ") and s > best[f"pooled {c}"][1]}


def micro_report(spine: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of counts, precision with and without false pairs of entities that have no true one, recall and
    the share of those entities left empty."""
    c = entity_counts(spine.select("s1_id"), predicted, truth)
    has = F.col("n_gt") > 0
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = c.agg(
        F.count("*").alias("entities"), total(F.when(has, F.col("tp"))).alias("tp"), total(F.when(has, F.col("n_pred") - F.col("tp"))).alias("fp_matched"),
        total(F.when(~has, F.col("n_pred"))).alias("fp_singleton"), total(F.when(has, F.col("n_gt") - F.col("tp"))).alias("fn"),
        F.count(F.when(~has, 1)).alias("singletons"), F.count(F.when(~has & (F.col("n_pred") == 0), 1)).alias("singletons_correct"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fm, fs, fn = (F.col(x) for x in ("tp", "fp_matched", "fp_singleton", "fn"))
    return sums.select("*", share(tp, tp + fm + fs).alias("precision"), share(tp, tp + fm).alias("precision_matched"), share(tp, tp + fn).alias("recall"), share(F.col("singletons_correct"), F.col("singletons")).alias("singleton_accuracy"))


def prediction_summary(spine: DataFrame, predicted: DataFrame) -> DataFrame:
    n = predicted.groupBy("s1_id").agg(F.count("*").alias("n"))
    return spine.select("s1_id").join(n, "s1_id", "left").agg(F.count("*").alias("total"), F.count("n").alias("matched"), (F.count("*") - F.count("n")).alias("singletons"))
