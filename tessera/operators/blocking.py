"""Candidate pairs by inverted index: each channel's keys are rows, retrieval is an equi-join and one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.operators.entities import UNKNOWN

CHANNELS = ("core_name", "name_tokens", "prefix", "postal", "number", "compound_address")
DEFAULT_CHANNELS = tuple(c for c in CHANNELS if c != "prefix")
#: The longest posting list that a channel still uses, and its points.
LONGEST = {"core_name": 5000, "name_tokens": 30000, "prefix": 5000, "postal": 5000, "number": 5000, "compound_address": 1000}
CORE, POSTAL, POSTAL_NUMBER, STREET_NUMBER, NUMBER, PREFIX = 4.0, 1.5, 3.5, 2.5, 1.0, 0.5


def channel_keys(df: DataFrame, query: bool = False) -> DataFrame:
    """(part_key, entity_id, doc_ord, channel, key), with repeats: a posting per name token's prefix, and per
    street word and number. Queries leave repeated street words out before they take three."""
    streets = F.slice(F.array_distinct("streets") if query else F.col("streets"), 1, 3)
    prefixes = F.transform(F.filter("tokens", lambda t: F.length(t) >= 5), lambda t: F.concat(F.substring(t, 1, 4), F.lit("$")))
    no_key = F.array().cast("array<string>")
    one = lambda c: F.when(F.col(c) != "", F.array(F.col(c))).otherwise(no_key)
    with_postal = F.when(F.col("raw_postal") != "", F.transform("raw_numbers", lambda n: F.concat(F.lit("p_"), "raw_postal", F.lit("_"), n))).otherwise(no_key)
    with_street = F.flatten(F.transform("raw_numbers", lambda n: F.transform(streets, lambda s: F.concat(F.lit("a_"), s, F.lit("_"), n))))
    by_channel = {"core_name": one("core"), "name_tokens": F.col("tokens"), "prefix": prefixes, "postal": one("raw_postal"), "number": F.col("raw_numbers"), "compound_address": F.concat(with_postal, with_street)}
    pairs = F.flatten(F.array(*[F.transform(v, _tagged(c)) for c, v in by_channel.items()]))
    rows = df.filter("part_key is not null").select("part_key", "entity_id", "doc_ord", F.explode(pairs).alias("p"))
    return rows.select("part_key", "entity_id", "doc_ord", "p.channel", "p.key")


def _tagged(channel: str):
    return lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key"))


def index_stats(postings: DataFrame) -> DataFrame:
    """(part_key, channel, key, n): postings of each key."""
    return postings.groupBy("part_key", "channel", "key").agg(F.count("*").alias("n"))


def usable(channels) -> list[str]:
    unknown = set(channels) - set(CHANNELS)
    if unknown:
        raise ValueError(f"unknown blocking channels: {sorted(unknown)}")
    return list(channels)


def usable_keys(postings: DataFrame, targets: DataFrame) -> DataFrame:
    """(part_key, channel, key, points) of the keys whose posting lists aren't too long."""
    sizes = targets.filter("part_key is not null").groupBy("part_key").agg(F.count("*").alias("docs"))
    longest = F.create_map(*[F.lit(x) for kv in LONGEST.items() for x in kv])
    stats = index_stats(postings).filter(F.col("n") <= longest[F.col("channel")]).join(sizes, "part_key")
    idf = F.log((F.col("docs") + 1) / (F.col("n") + 1))
    points = (
        F.when(F.col("channel") == "core_name", F.lit(CORE)).when(F.col("channel") == "name_tokens", idf).when(F.col("channel") == "prefix", PREFIX * idf)
        .when(F.col("channel") == "postal", F.lit(POSTAL)).when(F.col("channel") == "number", NUMBER + idf)
        .when(F.col("key").startswith("p_"), F.lit(POSTAL_NUMBER)).otherwise(F.lit(STREET_NUMBER))
    )
    return stats.select("part_key", "channel", "key", points.alias("points"))


def _sides(queries: DataFrame, targets: DataFrame, channels) -> tuple[DataFrame, DataFrame]:
    """The queries' keys and the targets' postings in some channels."""
    chosen = usable(channels)
    asked = channel_keys(queries, query=True).filter(F.col("channel").isin(chosen)).select("part_key", "channel", "key", F.col("entity_id").alias("s1_id"))
    return asked, channel_keys(targets).filter(F.col("channel").isin(chosen))


def scores(queries: DataFrame, targets: DataFrame, channels=DEFAULT_CHANNELS) -> DataFrame:
    """(s1_id, target_id, doc_ord, score by family, combined) of every pair that shares a usable key.

    A row for every hit is shuffled: this is for looking at scores. Candidates come from retrieval, which makes no pairs."""
    asked, postings = _sides(queries, targets, channels)
    weighted = asked.join(usable_keys(postings, targets), ["part_key", "channel", "key"])
    hits = weighted.join(postings.withColumnRenamed("entity_id", "target_id"), ["part_key", "channel", "key"])
    family = {"core": ["core_name"], "token": ["name_tokens", "prefix"], "number": ["number"], "postal": ["postal"], "address": ["compound_address"]}
    sums = [F.sum(F.when(F.col("channel").isin(c), F.col("points"))).alias(f) for f, c in family.items()]
    out = hits.groupBy("s1_id", "target_id", "doc_ord").agg(*sums)
    total = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in family), F.lit(0.0))
    return out.select("s1_id", "target_id", "doc_ord", *[F.round(f, 9).alias(f) for f in family], F.round(total, 9).alias("combined"))


def select_reserved(scored: DataFrame, top_k: int = 300) -> DataFrame:
    """(s1_id, target_id, doc_ord, rank, combined): slots for core names, numbers, postal codes and addresses in
    turn, then the best of the rest; ranked by combined score, ties by position."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    df = scored.repartition("s1_id").withColumn("__in", F.lit(False))  # one exchange for all windows: they all divide an entity's rows
    for has, by, slots in (("core", "core", top_k // 3), ("number", "number", top_k // 6), ("postal", "postal", top_k // 6), ("address", "combined", top_k // 3)):
        w = Window.partitionBy("s1_id", "__in", F.col(has).isNotNull()).orderBy(F.desc(by), "doc_ord", "target_id")
        df = df.withColumn("__in", F.col("__in") | (F.col(has).isNotNull() & ~F.col("__in") & (F.row_number().over(w) <= slots)))
    rest = Window.partitionBy("s1_id", "__in").orderBy(F.desc("combined"), "doc_ord", "target_id")
    whole = Window.partitionBy("s1_id")
    df = df.withColumn("__n", F.sum(F.col("__in").cast("int")).over(whole))
    df = df.withColumn("__r", F.row_number().over(rest)).filter(F.col("__in") | (F.col("__r") <= top_k - F.col("__n")))
    order = Window.partitionBy("s1_id").orderBy(F.desc("combined"), "doc_ord", "target_id")
    return df.select("s1_id", "target_id", "doc_ord", F.row_number().over(order).alias("rank"), "combined")


def reserved(queries: DataFrame, targets: DataFrame, top_k: int, channels=DEFAULT_CHANNELS) -> DataFrame:
    """What select_reserved takes of scores(), without making all pairs."""
    return retrieval.retrieve(*_sides(queries, targets, channels), lambda postings: usable_keys(postings, targets), retrieval.reserved_slots(top_k), top_k)


def candidates(queries: DataFrame, targets: DataFrame, top_k: int = 300, channels=DEFAULT_CHANNELS, fallback: bool = False) -> DataFrame:
    """Ranked candidates of each query within its partition; with fallback, also those of the unknown partition
    that aren't there yet, ranked after the others."""
    found = reserved(queries, targets, top_k, channels)
    if not fallback:
        return found
    elsewhere = queries.filter(f"part_key is not null and part_key <> '{UNKNOWN}'").withColumn("part_key", F.lit(UNKNOWN))
    more = reserved(elsewhere, targets.filter(f"part_key = '{UNKNOWN}'"), max(10, top_k // 5), channels)
    last = found.groupBy("s1_id").agg(F.max("rank").alias("last"))
    new = more.join(found, ["s1_id", "target_id"], "left_anti").join(last, "s1_id", "left")
    order = Window.partitionBy("s1_id").orderBy("rank")
    new = new.withColumn("rank", (F.row_number().over(order) + F.coalesce("last", F.lit(0))).cast("int"))
    return found.unionByName(new.select("s1_id", "target_id", "doc_ord", "rank", "combined"))


def token_topk(queries: DataFrame, targets: DataFrame, top_k: int) -> DataFrame:
    """The best candidates by shared name tokens alone."""
    found = retrieval.retrieve(*_sides(queries, targets, ["name_tokens"]), lambda postings: usable_keys(postings, targets), [], top_k)
    return found.select("s1_id", "target_id", "rank", "combined")
