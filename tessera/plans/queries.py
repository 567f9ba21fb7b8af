"""One registered query for each operator of the linkage engine, with its oracle where SQL has one.

Queries run over whole tables. top_k is small so that the reserved slots bind, and a rounded name Jaccard stands
in for the model's probability wherever a threshold is applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.similarity import jaro_winkler_udf
from tessera.operators import blocking, diagnostics, entities, features, metrics, model, select, trainset
from tessera.plans import fixtures
from tessera.plans import oracles as O
from tessera.session import prepare, stored
from tessera.sources import tsv

TOP_K, TAU = 12, 0.3
Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def joined(c: str) -> F.Column:
    return F.array_join(c, " ").alias(c)


# --- normal forms


def _field(name: str, expr, sql: str) -> None:
    @query(name, f"with {O.NORMAL} select entity_id, {sql} from n")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return entities.normalise(fixtures.records(spark, d)).select("entity_id", expr())


_field("er_clean_text", lambda: F.col("name"), "name")
_field("er_core_name", lambda: F.col("core"), "core")
_field("er_name_tokens", lambda: joined("tokens"), "array_to_string(tokens, ' ') as tokens")
_field("er_clean_address", lambda: F.col("addr"), "addr")
_field("er_numbers", lambda: joined("raw_numbers"), "array_to_string(raw_numbers, ' ') as raw_numbers")
_field("er_trigrams", lambda: joined("tri"), "array_to_string(tri, ' ') as tri")
_field("er_street_words", lambda: joined("streets"), "array_to_string(streets, ' ') as streets")


@query("er_postal", f"with {O.NORMAL} select entity_id, raw_postal, postal, array_to_string(numbers, ' ') as numbers from n")
def er_postal(spark: SparkSession, d: str) -> DataFrame:
    return entities.normalise(fixtures.records(spark, d)).select("entity_id", "raw_postal", "postal", joined("numbers"))


@query("er_partitions", f"with {O.NORMAL} select part_key, count(*) as n from n group by 1")
def er_partitions(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.records(spark, d).select(entities.part_key(F.col("country")).alias("part_key")).groupBy("part_key").agg(F.count("*").alias("n"))


# --- index


@query("er_index_stats", f"with {O.POSTINGS} select part_key, channel, key, n from stats")
def er_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return blocking.index_stats(blocking.channel_keys(fixtures.sides(spark, d)[1]))


def _channel(name: str, channel: str) -> None:
    # the index keeps repeats, so they are counted
    @query(name, f"with {O.POSTINGS} select part_key, key, entity_id, count(*) as times from post where channel = '{channel}' group by all")
    def run(spark: SparkSession, d: str) -> DataFrame:
        keys = blocking.channel_keys(fixtures.sides(spark, d)[1]).filter(F.col("channel") == channel)
        return keys.groupBy("part_key", "key", "entity_id").agg(F.count("*").alias("times"))


for _name, _c in (("core", "core_name"), ("tokens", "name_tokens"), ("prefix", "prefix"), ("postal", "postal"), ("number", "number"), ("compound", "compound_address")):
    _channel(f"er_channel_{_name}", _c)


# --- retrieval


@query(
    "er_block_tokens_topk",
    f"with {O.POSTINGS},\n{O.scored(('name_tokens',))} select s1_id, target_id, rank, combined from (select s1_id, target_id, cast(row_number() over (partition by s1_id order by combined desc, doc_ord) as int) as rank, combined from sc) where rank <= {TOP_K}",
)
def er_block_tokens_topk(spark: SparkSession, d: str) -> DataFrame:
    return blocking.token_topk(*fixtures.sides(spark, d), TOP_K)


def _cands(spark: SparkSession, d: str, top_k: int = TOP_K, channels=blocking.DEFAULT_CHANNELS) -> DataFrame:
    return blocking.candidates(*fixtures.sides(spark, d), top_k, channels)


@query("er_block_reserved_topk", f"with {O.candidates(TOP_K)} select s1_id, target_id, rank, combined from cand")
def er_block_reserved_topk(spark: SparkSession, d: str) -> DataFrame:
    return _cands(spark, d).select("s1_id", "target_id", "rank", "combined")


FALLBACK = (
    f"with {O.candidates(TOP_K)},\nuq as (select * replace ('__UNKNOWN__' as part_key) from qk where part_key <> '__UNKNOWN__'),\n"
    + O.scored(O.DEFAULT, "fsc", "uq") + ",\n" + O.reserved(10, "fc", "fsc")
    + """, more as (select f.s1_id, f.target_id, cast(row_number() over (partition by f.s1_id order by f.rank) + coalesce(l.last, 0) as int) as rank
  from fc f left join (select s1_id, max(rank) as last from cand group by 1) l on f.s1_id = l.s1_id
  where not exists (select 1 from cand c where c.s1_id = f.s1_id and c.target_id = f.target_id))
select s1_id, target_id, rank from cand union all select s1_id, target_id, rank from more"""
)


@query("er_block_fallback", FALLBACK)
def er_block_fallback(spark: SparkSession, d: str) -> DataFrame:
    return blocking.candidates(*fixtures.sides(spark, d), TOP_K, fallback=True).select("s1_id", "target_id", "rank")


VARIANTS = {"default": O.DEFAULT, "with_prefix": (*O.DEFAULT, "prefix")} | {f"without_{c}": tuple(x for x in O.DEFAULT if x != c) for c in O.DEFAULT}
ABLATION = f"with {O.POSTINGS},\n" + ",\n".join(f"{O.scored(v, f'sc_{k}')},\n{O.reserved(TOP_K, f'c_{k}', f'sc_{k}')}" for k, v in VARIANTS.items())
ABLATION += "\n" + " union all ".join(f"select '{k}' as variant, count(*) as gt_pairs, count(c.s1_id) as retrieved, round(count(c.s1_id)::double / count(*), 9) as recall from gt left join c_{k} c using (s1_id, target_id)" for k in VARIANTS)


@query("er_ablation_channels", ABLATION)
def er_ablation_channels(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = (stored(x, "er-side") for x in fixtures.sides(spark, d))
    out = diagnostics.channel_ablation(s1, targets, fixtures.truth(spark, d), TOP_K)
    return out.select("variant", "gt_pairs", "retrieved", F.round("recall", 9).alias("recall"))


CAPS = f"with {O.candidates(TOP_K)},\n{O.reserved(20, 'wide')}\n" + " union all ".join(
    f"select '{v}' as variant, (select count(*) from gt) as gt_pairs, (select count(*) from gt join {t} c using (s1_id, target_id) where c.rank <= {k}) as retrieved, (select count(*) from {t} where rank <= {k}) as pairs"
    for v, t, k in (("cap_6", "cand", 6), ("cap_12", "cand", 12), ("cap_20", "wide", 20))
)


@query("er_ablation_caps", CAPS)
def er_ablation_caps(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = (stored(x, "er-side") for x in fixtures.sides(spark, d))
    return diagnostics.cap_ablation(s1, targets, fixtures.truth(spark, d), (6, 12), 20, TOP_K).select("variant", "gt_pairs", "retrieved", "pairs")


# --- training pairs

INJECTED = f"""{O.candidates(TOP_K)},
missed as (select g.s1_id, g.target_id, t.doc_ord from gt g join s1 a on a.entity_id = g.s1_id join tg t on t.entity_id = g.target_id
  where a.part_key = t.part_key and not exists (select 1 from cand c where c.s1_id = g.s1_id and c.target_id = g.target_id)),
inj as (select s1_id, target_id, rank from cand union all
  select m.s1_id, m.target_id, cast(row_number() over (partition by m.s1_id order by m.doc_ord) + coalesce(l.last, 0) as int)
  from missed m left join (select s1_id, max(rank) as last from cand group by 1) l on l.s1_id = m.s1_id),
lab as (select i.*, case when g.s1_id is null then 0 else 1 end as label from inj i left join gt g on g.s1_id = i.s1_id and g.target_id = i.target_id)"""


def _injected(spark: SparkSession, d: str, top_k: int = TOP_K) -> DataFrame:
    s1, targets = fixtures.sides(spark, d)
    return trainset.inject_positives(blocking.candidates(s1, targets, top_k), fixtures.truth(spark, d), s1, targets)


@query("er_inject", f"with {INJECTED} select s1_id, target_id, rank from inj")
def er_inject(spark: SparkSession, d: str) -> DataFrame:
    return _injected(spark, d)


@query("er_label", f"with {INJECTED} select s1_id, target_id, rank, cast(label as int) as label from lab")
def er_label(spark: SparkSession, d: str) -> DataFrame:
    out = trainset.label_pairs(_injected(spark, d), fixtures.truth(spark, d))
    return out.select("s1_id", "target_id", "rank", F.col("label").cast("int").alias("label"))


PRUNED = f"""with {INJECTED},
o as (select *, row_number() over (partition by s1_id, label order by rank) - 1 as i, count(*) over (partition by s1_id, label) as n from lab)
select s1_id, target_id, rank, cast(label as int) as label from o
where label = 1 or n <= 8 or i < 5 or list_contains(list_transform(range(3), lambda k: 5 + cast(round_even(k * (n - 5 - 1) / 2.0, 0) as bigint)), i)"""


@query("er_prune", PRUNED)
def er_prune(spark: SparkSession, d: str) -> DataFrame:
    out = trainset.prune_negatives(trainset.label_pairs(_injected(spark, d), fixtures.truth(spark, d)), 8, 5)
    return out.select("s1_id", "target_id", "rank", F.col("label").cast("int").alias("label"))


@query("er_class_weight", f"with {INJECTED} select cast(sum(label) as bigint) as positives, cast(sum(1 - label) as bigint) as negatives, least(greatest(sum(1 - label)::double / greatest(sum(label), 1), 1.0), 5.0) as weight from lab")
def er_class_weight(spark: SparkSession, d: str) -> DataFrame:
    return trainset.class_weight(trainset.label_pairs(_injected(spark, d), fixtures.truth(spark, d)))


SPLIT = f"with {O.ER}, r as (select entity_id, country, row_number() over (partition by country order by md5(entity_id), entity_id) as r, count(*) over (partition by country) as n from er where entity_id like 'S1-%') select entity_id, country, r <= ceil(n * 0.2) as is_validation from r"


@query("er_split", SPLIT)
def er_split(spark: SparkSession, d: str) -> DataFrame:
    return entities.stratified_split(fixtures.records(spark, d).filter("entity_id like 'S1-%'").select("entity_id", "country"), 0.2)


@query("er_sample", f"with {O.ER} select entity_id from er order by md5(entity_id), entity_id limit 100")
def er_sample(spark: SparkSession, d: str) -> DataFrame:
    return entities.random_sample(fixtures.records(spark, d).select("entity_id"), 100)


@query("er_folds", f"with {O.ER} select entity_id, cast(cast('0x' || substr(md5(entity_id), 1, 8) as bigint) % 5 as int) as fold from er")
def er_folds(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.records(spark, d).select("entity_id", entities.fold(F.col("entity_id"), 5).alias("fold"))


# --- features

SIDES = f"""{O.candidates(TOP_K)},
sd as (select c.s1_id, c.target_id, a.core as c1, b.core as c2, a.addr as a1, b.addr as a2, a.toks as t1, b.toks as t2, a.tri as g1, b.tri as g2, a.addr_toks as at1, b.addr_toks as at2,
  a.postal as p1, b.postal as p2, a.numbers as m1, b.numbers as m2 from cand c join s1 a on a.entity_id = c.s1_id join tg b on b.entity_id = c.target_id)"""
SET_FEATURES = f"""with {SIDES} select s1_id, target_id,
  case when c1 = c2 and c1 <> '' then 1.0::double else 0.0 end as exact_match, case when t1 = t2 and len(t1) > 0 then 1.0::double else 0.0 end as token_exact,
  round({O.JACCARD.format(a="t1", b="t2")}, 9) as name_jaccard, round({O.JACCARD.format(a="g1", b="g2")}, 9) as trigram_jaccard,
  round(case when greatest(length(c1), length(c2)) > 0 then least(length(c1), length(c2))::double / greatest(length(c1), length(c2)) else 0.0 end, 9) as name_len_ratio,
  round(case when len(t1) > 0 and len(t2) > 0 then len(list_intersect(t1, t2))::double / least(len(t1), len(t2)) else 0.0 end, 9) as token_containment,
  abs(len(t1) - len(t2))::double as token_count_diff, round({O.JACCARD.format(a="at1", b="at2")}, 9) as addr_jaccard,
  (case when a1 = '' then 0.5 else 0.0 end + case when a2 = '' then 0.5 else 0.0 end)::double as addr_missing,
  case when p1 = '' or p2 = '' then 0.0::double when p1 = p2 then 1.0 else -1.0 end as postal_match,
  round(case when len(m1) = 0 and len(m2) = 0 then 0.5::double when len(m1) = 0 or len(m2) = 0 then 0.0 else {O.JACCARD.format(a="m1", b="m2")} end, 9) as num_match from sd"""


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides and the candidates, each made once."""
    s1, targets = (stored(x, "er-side") for x in fixtures.sides(spark, d))
    return s1, targets, stored(blocking.candidates(s1, targets, TOP_K), "er-candidates")


def _pair_sides(spark: SparkSession, d: str, base=None) -> DataFrame:
    s1, targets, cands = base or _base(spark, d)
    return features.pair_sides(cands.select("s1_id", "target_id"), s1, targets)


@query("er_features_set", SET_FEATURES)
def er_features_set(spark: SparkSession, d: str) -> DataFrame:
    return _pair_sides(spark, d).select("s1_id", "target_id", *[F.round(c, 9).alias(n) for n, c in features.set_features().items()])


@query("er_jw", f"with {SIDES} select s1_id, target_id, round(case when c1 = '' or c2 = '' then 0.0::double else jaro_winkler_similarity(c1, c2) end, 6) as jw_sim from sd")
def er_jw(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return _pair_sides(spark, d).select("s1_id", "target_id", F.round(jaro_winkler_udf("l_core", "r_core"), 6).alias("jw_sim"))


@query("er_features_fuzzy")
def er_features_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    s1, targets = fixtures.sides(spark, d)
    return features.pair_features(blocking.candidates(s1, targets, TOP_K).select("s1_id", "target_id"), s1, targets)


# --- selection and metrics, with a score in place of the model

SCORED = f"{SIDES},\nsp as (select s1_id, target_id, round({O.JACCARD.format(a='t1', b='t2')}, 6) as match_prob from sd)"
SPINE = "spine as (select entity_id as s1_id, country from s1)"


def _scored(spark: SparkSession, d: str, base=None) -> DataFrame:
    return _pair_sides(spark, d, base).select("s1_id", "target_id", F.round(features.set_features()["name_jaccard"], 6).alias("match_prob"))


def _spine(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.records(spark, d).filter("entity_id like 'S1-%'").select(F.col("entity_id").alias("s1_id"), "country")


@query("er_select", f"with {SCORED}, {SPINE} select s.s1_id, coalesce(string_agg(p.target_id, ',' order by p.target_id), '') as ids from spine s left join (select * from sp where match_prob >= {TAU}) p on p.s1_id = s.s1_id group by 1")
def er_select(spark: SparkSession, d: str) -> DataFrame:
    spine = _spine(spark, d).withColumnRenamed("s1_id", "entity_id")
    return select.on_spine(spine, select.select_pairs(_scored(spark, d), TAU)).select("s1_id", F.array_join("ids", ",").alias("ids"))


@query("er_probability_floor", f"with {SCORED} select s1_id, target_id, match_prob from sp where match_prob >= 0.05")
def er_probability_floor(spark: SparkSession, d: str) -> DataFrame:
    return select.probability_floor(_scored(spark, d))


@query("er_select_per_source", f"with {SCORED} select s1_id, target_id, match_prob from (select *, row_number() over (partition by s1_id, substr(target_id, 1, 2) order by match_prob desc, target_id) as r from sp) where r <= 2 and match_prob >= {TAU}")
def er_select_per_source(spark: SparkSession, d: str) -> DataFrame:
    return select.select_pairs(_scored(spark, d), TAU, max_per_source=2)


COUNTS = f"""with {SCORED}, {SPINE},
pr as (select distinct s1_id, target_id from sp where match_prob >= {TAU}),
ec as (select s.s1_id, s.country, (select count(*) from pr p where p.s1_id = s.s1_id) as p, (select count(*) from gt g where g.s1_id = s.s1_id) as g,
  (select count(*) from pr p join gt g on g.s1_id = p.s1_id and g.target_id = p.target_id where p.s1_id = s.s1_id) as t,
  (select count(*) from cand p join gt g on g.s1_id = p.s1_id and g.target_id = p.target_id where p.s1_id = s.s1_id) as hit from spine s)"""
ENTITY = O.F05.format(p="p", g="g", t="t")


@query("er_entity_f05", f"{COUNTS} select s1_id, p as n_pred, g as n_gt, t as tp, round({ENTITY}, 9) as f05 from ec")
def er_entity_f05(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.entity_counts(_spine(spark, d).select("s1_id"), select.select_pairs(_scored(spark, d), TAU), fixtures.truth(spark, d))
    return c.select("s1_id", "n_pred", "n_gt", "tp", F.round(metrics.entity_f05(F.col("tp"), F.col("n_pred"), F.col("n_gt")), 9).alias("f05"))


@query("er_macro_f05", f"{COUNTS} select count(*) as entities, round(avg({ENTITY}), 9) as macro_f05 from ec")
def er_macro_f05(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.macro_f05(_spine(spark, d), select.select_pairs(_scored(spark, d), TAU), fixtures.truth(spark, d))
    return out.select("entities", F.round("macro_f05", 9).alias("macro_f05"))


TAUS = [0.05 + 0.05 * i for i in range(19)]


def _sweep_sql(by: str) -> str:
    keep, group = (f"s.{by}, ", f"coalesce({by}, '') as {by}, ") if by else ("", "")
    return f"""with {SCORED}, {SPINE}, taus as (select unnest({TAUS!r}::double[]) as tau),
e as (select s.s1_id, {keep}x.tau, (select count(*) from sp p where p.s1_id = s.s1_id and p.match_prob >= x.tau) as p, (select count(*) from gt g where g.s1_id = s.s1_id) as g,
  (select count(*) from sp p join gt g on g.s1_id = p.s1_id and g.target_id = p.target_id where p.s1_id = s.s1_id and p.match_prob >= x.tau) as t from spine s, taus x)
select {group}round(tau, 6) as tau, count(*) as entities, round(avg({ENTITY}), 9) as macro_f05 from e group by all"""


@query("er_sweep", _sweep_sql(""))
def er_sweep(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.sweep(stored(_scored(spark, d), "er-scored"), stored(fixtures.truth(spark, d), "er-truth"), _spine(spark, d), metrics.tau_table(spark, TAUS))
    return out.select(F.round("tau", 6).alias("tau"), "entities", F.round("macro_f05", 9).alias("macro_f05"))


@query("er_country_sweep", _sweep_sql("country"))
def er_country_sweep(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.sweep(stored(_scored(spark, d), "er-scored"), stored(fixtures.truth(spark, d), "er-truth"), _spine(spark, d), metrics.tau_table(spark, TAUS), ("country",))
    return out.select(F.coalesce("country", F.lit("")).alias("country"), F.round("tau", 6).alias("tau"), "entities", F.round("macro_f05", 9).alias("macro_f05"))


COUNTRY_TAU = _sweep_sql("country")
COUNTRY_TAU = f"select country, min(tau) as tau, max(macro_f05) as macro_f05 from (select *, max(macro_f05) over (partition by country) as best from ({COUNTRY_TAU})) where macro_f05 = best group by 1"


@query("er_country_tau", COUNTRY_TAU)
def er_country_tau(spark: SparkSession, d: str) -> DataFrame:
    """Each country's best threshold of a grid, the lowest of equals."""
    swept = er_country_sweep(spark, d)
    return swept.groupBy("country").agg(F.min_by("tau", F.struct(-F.col("macro_f05"), "tau")).alias("tau"), F.max("macro_f05").alias("macro_f05"))


@query("er_threshold_search")
def er_threshold_search(spark: SparkSession, d: str) -> DataFrame:
    """The coarse and fine search, pooled and by country."""
    scored, truth, spine = (stored(x, "er-search") for x in (_scored(spark, d), fixtures.truth(spark, d), _spine(spark, d)))
    tau, f05 = metrics.best_threshold(scored, truth, spine)
    rows = [("pooled", tau, f05)] + [(c or "unknown", t, None) for c, t in metrics.country_thresholds(scored, truth, spine, tau, 20).items()]
    return spark.createDataFrame(rows, "scope string, tau double, macro_f05 double")


MICRO = f"""{COUNTS}, r as (select count(*) as entities, coalesce(sum(t) filter (g > 0), 0)::bigint as tp, coalesce(sum(p - t) filter (g > 0), 0)::bigint as fp_matched, coalesce(sum(p) filter (g = 0), 0)::bigint as fp_singleton,
  coalesce(sum(g - t) filter (g > 0), 0)::bigint as fn, count(*) filter (g = 0) as singletons, count(*) filter (g = 0 and p = 0) as singletons_correct from ec)
select *, round(case when tp + fp_matched + fp_singleton > 0 then tp::double / (tp + fp_matched + fp_singleton) else 0 end, 9) as precision, round(case when tp + fp_matched > 0 then tp::double / (tp + fp_matched) else 0 end, 9) as precision_matched,
  round(case when tp + fn > 0 then tp::double / (tp + fn) else 0 end, 9) as recall, round(case when singletons > 0 then singletons_correct::double / singletons else 0 end, 9) as singleton_accuracy from r"""


@query("er_micro_report", MICRO)
def er_micro_report(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.micro_report(_spine(spark, d), stored(select.select_pairs(_scored(spark, d), TAU), "er-picked"), stored(fixtures.truth(spark, d), "er-truth"))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("er_prediction_summary", f"{COUNTS} select count(*) as total, count(*) filter (p > 0) as matched, count(*) filter (p = 0) as singletons from ec")
def er_prediction_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.prediction_summary(_spine(spark, d), select.select_pairs(_scored(spark, d), TAU))


def _submission(name: str, column: str, table: str, make, pairs) -> None:
    sql = f"with {SCORED} select s.entity_id as source1_entity_id, coalesce(string_agg(distinct p.target_id, ',' order by p.target_id), '') as {column}, s.ord from (select entity_id, row_number() over (order by doc_ord) as ord from s1) s left join ({table}) p on p.s1_id = s.entity_id group by 1, 3"

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        s1 = fixtures.records(spark, d).filter("entity_id like 'S1-%'").select(F.col("entity_id").alias("s1_id"), "doc_ord")
        return make(tsv.in_file_order(s1).select("s1_id", "ord"), pairs(spark, d))


_submission("er_submission", "matched_entity_ids", f"select * from sp where match_prob >= {TAU}", tsv.match_submission, lambda s, d: select.select_pairs(_scored(s, d), TAU))
_submission("er_candidate_submission", "candidate_entity_ids", "select * from cand", tsv.candidate_submission, _cands)


# --- diagnostics


@query("er_recall", f"with {O.candidates(TOP_K)} select count(*) as gt_pairs, count(c.s1_id) as retrieved, round(count(c.s1_id)::double / count(*), 9) as recall from gt left join cand c using (s1_id, target_id)")
def er_recall(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.candidate_recall(_cands(spark, d), fixtures.truth(spark, d)).withColumn("recall", F.round("recall", 9))


@query("er_coverage", f"{COUNTS} select count(*) as entities, count(*) filter (hit = g) as covered, round(count(*) filter (hit = g)::double / count(*), 9) as coverage from ec where g > 0")
def er_coverage(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.full_coverage(_cands(spark, d), fixtures.truth(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query("er_oracle_f05", f"{COUNTS} select count(*) as entities, round(avg({O.F05.format(p='hit', g='g', t='hit')}), 9) as macro_f05 from ec")
def er_oracle_f05(spark: SparkSession, d: str) -> DataFrame:
    truth = fixtures.truth(spark, d)
    out = metrics.macro_f05(_spine(spark, d), diagnostics.oracle_predictions(_cands(spark, d), truth), truth)
    return out.select("entities", F.round("macro_f05", 9).alias("macro_f05"))


@query("er_cross_country", f"with {O.NORMAL} select count(*) filter (b.entity_id is not null and coalesce(a.country, '') <> coalesce(b.country, '')) as cross_country, count(*) filter (b.entity_id is null) as missing_target from gt g join s1 a on a.entity_id = g.s1_id left join tg b on b.entity_id = g.target_id")
def er_cross_country(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = fixtures.sides(spark, d)
    return diagnostics.cross_country(fixtures.truth(spark, d), s1, targets)


MISSES = f"""with {O.candidates(2)},
m as (select g.*, coalesce(a.country, '__UNKNOWN__') as country, a.name as n1, b.name as n2, a.business_address as a1, b.business_address as a2 from gt g join s1 a on a.entity_id = g.s1_id join tg b on b.entity_id = g.target_id
  where not exists (select 1 from cand c where c.s1_id = g.s1_id and c.target_id = g.target_id)),
k1 as (select *, {O._strip("n1")} as x1, {O._strip("n2")} as x2 from m), k2 as (select * replace ({O._strip("x1")} as x1, {O._strip("x2")} as x2) from k1), k3 as (select * replace ({O._strip("x1")} as x1, {O._strip("x2")} as x2) from k2),
k4 as (select *, case when x1 = '' then n1 else x1 end as c1, case when x2 = '' then n2 else x2 end as c2, {O._postal("a1", True)} as p1, {O._postal("a2", True)} as p2 from k3),
k5 as (select *, list_filter(string_split(c1, ' '), lambda w: length(w) >= 2 and not regexp_full_match(w, '[0-9]+')) as t1, list_filter(string_split(c2, ' '), lambda w: length(w) >= 2 and not regexp_full_match(w, '[0-9]+')) as t2,
  {O._numbers("a1", "p1")} as m1, {O._numbers("a2", "p2")} as m2 from k4)
select country, count(*) as missed_pairs, count(*) filter (c1 <> '' and c1 = c2) as exact_core_name, count(*) filter (list_has_any(t1, t2)) as name_token_overlap, count(*) filter (p1 <> '' and p1 = p2) as postal_match,
  count(*) filter (list_has_any(m1, m2)) as address_number_overlap from k5 group by 1"""


@query("er_miss_signatures", MISSES)
def er_miss_signatures(spark: SparkSession, d: str) -> DataFrame:
    s1, targets = fixtures.sides(spark, d)
    return diagnostics.miss_signatures(blocking.candidates(s1, targets, 2), fixtures.truth(spark, d), s1, targets)


REPORT = f"""{COUNTS} select case when grouping(c) = 1 then '*' else c end as country, count(*) as entities, round(coalesce(sum(hit)::double / nullif(sum(g), 0), 0), 9) as candidate_recall,
  round(coalesce((count(*) filter (g > 0 and hit = g))::double / nullif(count(*) filter (g > 0), 0), 0), 9) as full_coverage, round(coalesce((sum(t) filter (g > 0))::double / nullif(sum(p) filter (g > 0), 0), 0), 9) as precision,
  round(coalesce((sum(t) filter (g > 0))::double / nullif(sum(g) filter (g > 0), 0), 0), 9) as recall, round(coalesce((count(*) filter (g = 0 and p = 0))::double / nullif(count(*) filter (g = 0), 0), 0), 9) as singleton_accuracy,
  round(avg({ENTITY}), 9) as macro_f05 from (select *, coalesce(country, '__UNKNOWN__') as c from ec) group by rollup (c)"""


@query("er_country_report", REPORT)
def er_country_report(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    picked = stored(select.select_pairs(_scored(spark, d, base), TAU), "er-picked")
    out = diagnostics.country_report(base[0], base[2], picked, fixtures.truth(spark, d))
    return out.select(F.coalesce("country", F.lit("*")).alias("country"), *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "country"])


# --- model


def _training(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    s1, targets = (stored(x, "er-side") for x in fixtures.sides(spark, d))
    truth = stored(fixtures.truth(spark, d), "er-truth")
    pairs = trainset.prune_negatives(trainset.label_pairs(trainset.inject_positives(blocking.candidates(s1, targets, TOP_K), truth, s1, targets), truth))
    return stored(features.pair_features(pairs, s1, targets), "er-train")


@query("er_train_score")
def er_train_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _training(spark, d)
    return model.score(model.train(rows, 3.0, {"rounds": 5, "max_depth": 3}, early_stop=False), rows)


@query("er_cv")
def er_cv(spark: SparkSession, d: str) -> DataFrame:
    loss, area = model.cross_validate(_training(spark, d), {"rounds": 3, "max_depth": 3}, 2)
    return spark.createDataFrame([(loss, area)], "oof_log_loss double, oof_auc double")


def queries() -> dict:
    return {k: fn for k, (fn, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in Q.items() if sql}
