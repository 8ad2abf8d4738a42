"""Company names against a registry of legal names, and what is known of a company as claims.

A name is its set of significant words. Names with equal sets are one row
before any join, so copies never multiply. Words are looked up in an inverted
index, by the rarest word of a name; where that one is in more than `hot`
registered sets, by its two rarest words together. No name meets another that
shares no such key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import names_all, tokens
from ..plans.stage import written

HOT = 10_000


def word_sets(names: DataFrame, key: str, name: str, keep: str) -> DataFrame:
    """One row per set of significant words: words (sorted), `keep` and the name of the smallest key."""
    rows = names.select(F.array_sort(tokens(F.col(name))).alias("words"), F.struct(F.col(key).alias("k"), F.col(name).alias("v")).alias("o")).where(F.size("words") > 0)
    return rows.groupBy("words").agg(F.min("o").alias("o")).select("words", F.col("o.k").alias(keep), F.col("o.v").alias("legal_name"))


def word_counts(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def by_rarity(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Add `rare`: (n, word) of each known word of a set, the rarest first."""
    each = sets.select("words", F.explode("words").alias("word")).join(counts, "word")
    rare = each.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("rare"))  # as many as the name has words
    return sets.join(rare, "words", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<struct<n:bigint,word:string>>")))


def legal_matches(companies: DataFrame, registry: DataFrame, hot: int = HOT) -> DataFrame:
    """Per company the registered name that holds all its words, with the share of that name's words it has.

    companies: company_id, name. registry: entity_id, legal_name. The largest share wins, then the smallest
    entity_id. Companies without a match have nulls and a reason."""
    asked = companies.select("company_id", "name", F.array_sort(tokens(F.col("name"))).alias("words"))
    known = written(word_sets(registry, "entity_id", "legal_name", "entity_id"), "names")
    counts = written(word_counts(known), "words")
    sets = by_rarity(asked.where(F.size("words") > 0).select("words").distinct(), counts)
    sets = sets.where(F.size("rare") == F.size("words"))  # a word that no registered name has rules out all
    first, second = F.get("rare", F.lit(0)), F.get("rare", F.lit(1))
    alone = F.size("rare") == 1
    pair = F.concat_ws(" ", F.array_sort(F.array(first["word"], second["word"])))
    keyed = sets.select("words", alone.alias("alone"), F.when(alone | (first["n"] <= hot), first["word"]).otherwise(pair).alias("key"))
    better = lambda share: F.max(F.struct(share.alias("confidence"), (-F.col("entity_id")).alias("low"), "entity_id", "legal_name"))
    # one word: its best name is an aggregate of the index, however many names have it
    singles = keyed.where("alone").join(known.select(F.explode("words").alias("key"), F.size("words").alias("size"), "entity_id", "legal_name").groupBy("key").agg(better(1 / F.col("size")).alias("b")), "key").select("words", "b")
    index = by_rarity(known, counts).select("entity_id", "legal_name", F.col("words").alias("theirs"), "rare")
    cold = F.transform(F.filter("rare", lambda r: r["n"] <= hot), lambda r: r["word"])
    warm = F.array_sort(F.transform(F.filter("rare", lambda r: r["n"] > hot), lambda r: r["word"]))
    pairs = F.flatten(F.transform(warm, lambda a: F.transform(F.filter(warm, lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))
    index = index.withColumn("key", F.explode(F.concat(cold, pairs))).drop("rare")
    both = keyed.where("not alone").join(index, "key").where(names_all(F.col("words"), F.col("theirs")))
    several = both.groupBy("words").agg(better(F.size("words") / F.size("theirs")).alias("b"))
    out = asked.join(singles.unionByName(several), "words", "left")
    reason = F.when(F.size("words") == 0, "the name has no significant word").when(F.col("b").isNull(), "no registered name holds every word of the name")
    return out.select("company_id", "name", "b.entity_id", "b.legal_name", "b.confidence", reason.alias("rejection_reason"))


def similar_names(companies: DataFrame, registry: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of word sets whose common words weigh at least the share `least` of all their words.

    A word weighs ln(1 + sets / sets that have it). Two such sets share one of the rarest words of each: the
    prefix that is left when the rest weighs less than `least` of the set. Only prefixes are joined."""
    known = written(word_sets(registry, "entity_id", "legal_name", "entity_id"), "names")
    asked = companies.select(F.array_sort(tokens(F.col("name"))).alias("words"), "company_id").where(F.size("words") > 0).groupBy("words").agg(F.min("company_id").alias("company_id"), F.count("*").alias("companies"))
    every = written(known.select("words").unionByName(asked.select("words")).distinct(), "sets")
    counts = word_counts(every)
    total = every.agg(F.count("*").alias("sets"))
    weights = written(counts.join(F.broadcast(total)).select("word", F.log(1 + F.col("sets") / F.col("n")).alias("w")), "weights")  # total is one row
    each = every.select("words", F.explode("words").alias("word")).join(weights, "word")
    rows = each.groupBy("words").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("v"), "word"))).alias("rare"), F.sum("w").alias("weight"))
    beyond = lambda k: F.aggregate(F.slice("rare", k + 1, F.size("rare")), F.lit(0.0), lambda s, r: s - r["v"])
    prefix = F.filter("rare", lambda r, k: beyond(k) >= least * F.col("weight") - 1e-9)
    rows = written(rows.select("words", "weight", F.transform(prefix, lambda r: r["word"]).alias("prefix"), F.map_from_entries(F.transform("rare", lambda r: F.struct(r["word"], -r["v"]))).alias("w")), "weighed")
    left = asked.join(rows, "words").select("company_id", "companies", "words", "weight", "w", F.explode("prefix").alias("key"))
    right = known.join(rows, "words").select("entity_id", "legal_name", F.col("words").alias("theirs"), F.col("weight").alias("their_weight"), F.explode("prefix").alias("key"))
    common = F.aggregate(F.array_intersect("words", "theirs"), F.lit(0.0), lambda s, x: s + F.col("w")[x])
    score = common / (F.col("weight") + F.col("their_weight") - common)
    both = left.join(right, "key").withColumn("similarity", score).where(F.col("similarity") >= least - 1e-12)
    return both.groupBy("company_id", "entity_id").agg(F.first("companies").alias("companies"), F.first("legal_name").alias("legal_name"), F.first("similarity").alias("similarity"))


def rank_confidence(place: Column, strategies: int) -> Column:
    """Confidence of the strategy at a place (from 0): 1 for the first, down towards a half."""
    return F.round(1.0 - place / strategies * 0.5, 4)


def website_claims(companies: DataFrame, proposals: DataFrame, probes: DataFrame, strategies: list[str]) -> DataFrame:
    """Claims on the website of each company: company_id, source, value, status, confidence, rejection_reason.

    proposals: company_id, source, hostname; probes: hostname, reachable, reason. Hosts are tried by the order
    of their strategies (then by name) until one answers: that one is CONFIRMED, those tried before REFUTED, those after
    UNVERIFIED, as is a host that no probe knows. A strategy without proposal is NOT_FOUND."""
    places = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(s).alias("source")) for k, s in enumerate(strategies)])
    grid = companies.select("company_id", F.inline(places))
    best = proposals.groupBy("company_id", "source").agg(F.min("hostname").alias("hostname"))
    rows = grid.join(best, ["company_id", "source"], "left").join(probes.select("hostname", "reachable", "reason"), "hostname", "left")
    before = Window.partitionBy("company_id").orderBy("place", "hostname").rowsBetween(Window.unboundedPreceding, -1)
    won = F.coalesce(F.max(F.col("reachable").cast("int")).over(before), F.lit(0)) == 1
    status = F.when(F.col("hostname").isNull(), "NOT_FOUND").when(won | F.col("reachable").isNull(), "UNVERIFIED").when(F.col("reachable"), "CONFIRMED").otherwise("REFUTED")
    confidence = F.when(F.col("hostname").isNull(), 0.0).otherwise(rank_confidence(F.col("place"), len(strategies)))
    rows = rows.select("company_id", "source", F.col("hostname").alias("value"), status.alias("status"), confidence.alias("confidence"), "reason")
    return rows.withColumn("rejection_reason", F.when(F.col("status") == "REFUTED", F.col("reason")).when(F.col("status") == "NOT_FOUND", "the strategy proposed nothing")).drop("reason")


def legal_claims(matches: DataFrame, source: str) -> DataFrame:
    """Claims on the legal name, from `legal_matches`: CONFIRMED with its share of words, or NOT_FOUND with the reason."""
    found = F.col("entity_id").isNotNull()
    return matches.select(
        "company_id", F.lit(source).alias("source"), F.col("legal_name").alias("value"), F.when(found, "CONFIRMED").otherwise("NOT_FOUND").alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "rejection_reason",
    )


def resolution_rates(claims: DataFrame) -> DataFrame:
    """Per attribute: companies, companies with a confirmed claim, and by which source how many."""
    won = F.col("status") == "CONFIRMED"
    each = claims.groupBy("attribute", "company_id").agg(F.max(won.cast("int")).alias("won"), F.min(F.when(won, F.col("source"))).alias("source"))
    return each.groupBy("attribute", "source").agg(F.count("*").alias("companies"), F.sum("won").alias("resolved"))
