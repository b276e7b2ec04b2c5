"""Corpus-wide statistics, category codes and vocabulary, all as small lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, MAX_CATEGORIES, Settings
from tidewatch.functions import scalar as S
from tidewatch.functions import sequences as Q
from tidewatch.operators.profiles import exploded
from tidewatch.session import settle

CATEGORIES = {
    "entity_type": "entity_type",
    "auth_method": "auth_method",
    "geo_country": "geo_country",
    "device_protocol": "device_protocol",
    "device_os": "device_os",
    "resource_accessed": "resource_accessed",
}


@dataclass(frozen=True)
class Corpus:
    """``counts``: (dim, value, n, n_entities); the totals are single numbers."""

    counts: DataFrame
    n_events: int
    n_entities: int
    token_total: int
    ngram_total: int
    min_token_count: int = 3


def corpus_counts(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Occurrences and distinct entities per value. Two-step counting keeps hot values cheap:
    (value, entity) pairs first, then values."""
    long = exploded(events, ["entity_id"], settings.ngram_n, ("resource", "device_os", "country", "token", "ngram"))
    long = long.filter("value is not null")
    pairs = long.groupBy("dim", "value", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("dim", "value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_entities"))


def fit_corpus(events: DataFrame, settings: Settings = DEFAULTS) -> Corpus:
    counts = settle(corpus_counts(events, settings))  # read by several joins, each of which would count again
    totals = events.agg(F.count(F.lit(1)), F.countDistinct("entity_id")).first()
    bags = {r["dim"]: r["n"] for r in counts.filter(F.col("dim").isin("token", "ngram")).groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    return Corpus(counts, totals[0], totals[1], bags.get("token", 0), bags.get("ngram", 0), settings.min_token_count)


def surprisal(n: Column, total: int) -> Column:
    """-ln of the share, an unseen value counting as one occurrence."""
    floor = 1.0 / max(1, total)
    return -F.log(F.greatest(F.coalesce(n, F.lit(0)) / F.lit(float(max(1, total))), F.lit(floor)))


def frequencies(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Share of events and of entities per resource, operating system and country."""
    c = fit_corpus(events, settings)
    t = c.counts.filter(F.col("dim").isin("resource", "device_os", "country"))
    return t.select(
        "dim", "value", "n",
        (F.col("n") / c.n_events).alias("share"),
        (F.col("n_entities") / c.n_entities).alias("entity_share"),
        surprisal(F.col("n"), c.n_events).alias("surprisal"),
    )


def category_codes(events: DataFrame, caps: dict = MAX_CATEGORIES, min_count: int = 1, cohorts: int = 6) -> DataFrame:
    """(field, value, code, n): frequency rank from 1; code 0 is kept for unseen values. A field without a cap keeps all.

    Cohort codes come from the configured cohort count, not from data.
    """
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), S.normalise_category(F.col(c)).alias("value")) for f, c in CATEGORIES.items()]
    )
    counts = (
        events.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
        .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    )
    cap = F.lit(None).cast("int")
    for f, k in caps.items():
        cap = F.when(F.col("field") == f, F.lit(k)).otherwise(cap)
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("code", F.row_number().over(w)).filter(cap.isNull() | (F.col("code") <= cap))
    ranked = ranked.select("field", "value", "code", "n")
    names = sorted([str(i) for i in range(cohorts)] + ["unknown"])
    fixed = events.sparkSession.createDataFrame(
        [("cohort", v, i + 1, 1) for i, v in enumerate(names)], "field string, value string, code int, n bigint"
    )
    return ranked.unionByName(fixed)


def encode_categories(rows: DataFrame, codes: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``<field>_code`` (0 when unseen or missing) and ``<field>_novel``.

    The code table has at most the sum of the caps in rows (374), so it travels as one map.
    """
    lookup = {r["k"]: r["code"] for r in codes.select(F.concat_ws("\u0001", "field", "value").alias("k"), "code").collect()}
    literal = F.create_map(*[F.lit(x) for kv in sorted(lookup.items()) for x in kv]) if lookup else F.create_map().cast("map<string,int>")
    out = rows
    for f in fields:
        key = F.concat(F.lit(f + "\u0001"), S.normalise_category(F.col(f)))
        code = F.coalesce(literal[key], F.lit(0))
        out = out.withColumn(f"{f}_code", code).withColumn(f"{f}_novel", code == 0)
    return out


def decode_categories(rows: DataFrame, codes: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``<field>_value`` from ``<field>_code``; null for 0 and codes that were never given out.

    Every field has its own join: with a cap the table is small and Spark broadcasts it, without one it may be large.
    """
    out = rows
    for f in fields:
        own = codes.filter(F.col("field") == f).select(F.col("code").alias(f"{f}_code"), F.col("value").alias(f"{f}_value"))
        out = out.join(own, f"{f}_code", "left")
    return out


def vocabulary(corpus: Corpus) -> DataFrame:
    """(token, id, n): ids from 3 by (-count, token); rarer tokens stay out and read as unknown."""
    kept = corpus.counts.filter((F.col("dim") == "token") & (F.col("n") >= corpus.min_token_count))
    # Prefix buckets would be needed beyond ~10M distinct tokens; commands are a small language.
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "value")
    return kept.select(F.col("value").alias("token"), (F.row_number().over(w) + 2).cast("bigint").alias("id"), "n")


def encode_sequences(events: DataFrame, vocab: DataFrame, settings: Settings = DEFAULTS, id: str = "event_id") -> DataFrame:
    """Adds ``sequence_ids``: BOS + token ids, last 20 kept, left-padded with 0."""
    tokens = events.select(id, F.posexplode(Q.clean(F.col("command_sequence"))).alias("pos", "token"))
    coded = tokens.join(vocab.select("token", F.col("id").alias("_id")), "token", "left")
    ids = coded.groupBy(id).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_id", F.lit(Q.UNK_ID)).cast("int").alias("i")))).alias("_ids")
    )
    joined = events.join(ids, id, "left")
    plain = F.transform(F.coalesce("_ids", F.array().cast("array<struct<pos:int,i:int>>")), lambda s: s["i"])
    full = F.concat(F.array(F.lit(Q.BOS_ID)), plain)
    return joined.withColumn("sequence_ids", Q.pad_left(full, settings.sequence_len)).drop("_ids")


def decode(coded: DataFrame, vocab: DataFrame, id: str = "event_id") -> DataFrame:
    """Adds ``decoded``: the tokens behind ``sequence_ids``, reserved ids left out."""
    ids = coded.select(id, F.posexplode("sequence_ids").alias("pos", "_id"))
    named = ids.join(vocab.select("token", F.col("id").alias("_id")), "_id")
    back = named.groupBy(id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("decoded")
    )
    return coded.join(back, id, "left")


def unknown_ratio(sequence_ids: Column) -> Column:
    """Share of unknown tokens among the real ones of an encoded sequence."""
    real = F.filter(sequence_ids, lambda i: (i != Q.PAD_ID) & (i != Q.BOS_ID))
    return Q.share(real, lambda i: i == Q.UNK_ID)


def sequence_rarity(events: DataFrame, corpus: Corpus, id: str = "event_id", ngram_n: int = 2) -> DataFrame:
    """Mean token rarity, mean n-gram rarity and global n-gram novelty of every event's commands."""
    long = exploded(events, [id], ngram_n, ("token", "ngram")).join(
        corpus.counts.select("dim", "value", F.col("n").alias("known")), ["dim", "value"], "left"
    )
    kept = f"if(dim = 'token' and known < {corpus.min_token_count}, 0, coalesce(known, 0))"
    total = f"if(dim = 'token', {max(1, corpus.token_total) + 1}D, {max(1, corpus.ngram_total) + 1}D)"
    rare = long.selectExpr(id, "dim", "known", f"-ln(greatest({kept}, 1) / {total}) AS x")
    out = rare.groupBy(id).agg(
        F.expr("coalesce(avg(if(dim = 'token', x, null)), 0D) AS token_rarity"),
        F.expr("coalesce(avg(if(dim = 'ngram', x, null)), 0D) AS ngram_rarity"),
        F.expr("coalesce(avg(if(dim = 'ngram', if(known is null, 1D, 0D), null)), 0D) AS ngram_novelty"),
    )
    return events.select(id).join(out, id, "left").na.fill(0.0)
