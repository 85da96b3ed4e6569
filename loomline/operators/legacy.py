"""Where legacy entities went: the cross-reference from them to keys, the migration report, and the ids that keys answer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import registry
from loomline.functions.codes import bridge_grade
from loomline.operators import ledger
from loomline.session import stored
from loomline.sources import log


def tenants(members: DataFrame, groupings: DataFrame) -> DataFrame:
    """key, entity, source: whose grouping claims(code, product, source) land on a key's codes. Product lane only."""
    own = ledger.in_lane(members).where("lane = 'product'").select("key", "code")
    return own.join(groupings.select("code", F.col("product").alias("entity"), "source"), "code").select("key", "entity", "source").distinct()


def key_to_legacy(members: DataFrame, groupings: DataFrame) -> DataFrame:
    """key, entities of every product key; none where no grouping claim lands."""
    found = tenants(members, groupings).groupBy("key").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    keys = ledger.in_lane(members).where("lane = 'product'").select("key").distinct()
    return keys.join(found, "key", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<bigint>")))


def xref(members: DataFrame, groupings: DataFrame) -> DataFrame:
    """entity, primary, keys, relation, others of each legacy entity, from all grouping claims, past ones too.

    split: its claims land on several keys; the primary has a CNK, else a GTIN, more sources, a lower number. merged: on one key with
    other entities, of which one shares a national code with it; merged-suspect: with others that share none, so that barcodes alone
    may have joined them. stable: on a key of its own. Entities that share a key are compared by counting who has a code, not in pairs.
    """
    said = stored(groupings.select("code", "product", "source").distinct())
    placed = stored(tenants(members, said))
    own = ledger.in_lane(members).where("lane = 'product'").withColumn("scheme", registry.scheme_of(F.col("code")))
    spine = own.groupBy("key").agg(F.max(F.when(F.col("scheme") == "cnk", 2).when(F.col("scheme") == "gtin", 1).otherwise(0)).alias("spine"))
    backed = placed.groupBy("key").agg(F.countDistinct("source").alias("sources"), F.countDistinct("entity").alias("tenants"))
    number = ledger.key_number(F.col("key"))
    best = F.max_by("key", F.struct("spine", "sources", (-F.col("n")).alias("n")))
    keys = placed.select("key", "entity").distinct().join(spine, "key").join(backed, "key").withColumn("n", number)
    by_entity = keys.groupBy("entity").agg(best.alias("primary"), F.array_sort(F.collect_set(F.struct("n", "key"))).alias("k"), F.max("tenants").alias("tenants"))
    national = said.where(bridge_grade(registry.scheme_of(F.col("code"))) == "national").select(F.col("product").alias("entity"), "code").distinct()
    on_key = placed.select("key", "entity").distinct().join(national, "entity")
    met = on_key.groupBy("key", "code").agg(F.count("*").alias("holders")).where("holders > 1")
    trusted = on_key.join(met, ["key", "code"], "left_semi").select("entity").distinct().withColumn("trusted", F.lit(True))
    split, alone = F.size("k") > 1, F.col("tenants") == 1
    relation = F.when(split, "split").when(alone, "stable").when(F.col("trusted"), "merged").otherwise("merged-suspect")
    return by_entity.join(trusted, "entity", "left").select("entity", "primary", F.transform("k", lambda x: x["key"]).alias("keys"), relation.alias("relation"), F.when(split, F.lit(0)).otherwise(F.col("tenants") - 1).alias("others"))


def resolve(entities: DataFrame, found: DataFrame) -> DataFrame:
    """entity, key, relation, keys for each asked entity; ``unknown`` without a key where the cross-reference has none."""
    known = found.select("entity", F.col("primary").alias("key"), "relation", F.when(F.col("relation") == "split", F.col("keys")).alias("keys"))
    return entities.select("entity").join(known, "entity", "left").withColumn("relation", F.coalesce("relation", F.lit("unknown")))


def migration_diff(found: DataFrame, collisions: DataFrame) -> DataFrame:
    """category, subject, keys, primary, relation, confidence, needs_review: a finding for each entity of xref() and each code that several
    keys hold (code, keys)."""
    suspect = F.col("relation") == "merged-suspect"
    category = F.when(F.col("relation") == "stable", "confirmed").when(F.col("relation") == "split", "split").otherwise("merged")
    placed = found.select(category.alias("category"), F.col("entity").cast("string").alias("subject"), "keys", "primary", F.when(suspect, "merged").otherwise(F.col("relation")).alias("relation"), F.when(suspect, "low").otherwise("high").alias("confidence"), suspect.alias("needs_review"))
    clashing = collisions.select(F.lit("collision").alias("category"), F.col("code").alias("subject"), "keys", F.lit(None).cast("string").alias("primary"), F.lit("collision").alias("relation"), F.lit("low").alias("confidence"), F.lit(True).alias("needs_review"))
    return placed.unionByName(clashing)


def diff_counts(findings: DataFrame) -> DataFrame:
    """confirmed, merged, split, collision, needs_review: one row, also of no findings."""
    n = lambda name: F.count_if(F.col("category") == name).alias(name)
    return findings.agg(n("confirmed"), n("merged"), n("split"), n("collision"), F.count_if("needs_review").alias("needs_review"))


def diff_summary(findings: DataFrame, limit: int = 1000) -> str:
    """The report as text: counts, and the findings to review (the first ``limit``, as a report is read by people)."""
    c = diff_counts(findings).first()
    lines = ["Migration diff"] + [f"  {n + ':':<14}{c[m]}" for n, m in (("confirmed", "confirmed"), ("merged", "merged"), ("split", "split"), ("collision", "collision"), ("needs review", "needs_review"))]
    open_ = findings.where("needs_review").orderBy("category", "subject").limit(limit).collect()
    lines += ["", f"Needs review ({c.needs_review}):" if open_ else "No findings need review."]
    for r in open_:
        lines.append(f"  - {r.category} {r.subject}: {', '.join(r['keys'])} (confidence {r.confidence})")
    return "\n".join(lines)


def votes(members: DataFrame, groupings: DataFrame) -> DataFrame:
    """key, entity, n: how many grouping claims of a key's codes name each entity."""
    return members.select("key", "code").join(groupings.select("code", F.col("product").alias("entity")), "code").groupBy("key", "entity").agg(F.count("*").alias("n"))


def inherited(voted: DataFrame) -> DataFrame:
    """key, legacy_id, votes: the entity with most votes, the lowest of equals."""
    return voted.groupBy("key").agg(F.max_by("entity", F.struct("n", -F.col("entity"))).alias("legacy_id"), F.max("n").alias("votes"))


def allocate(members: DataFrame, groupings: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """key, legacy_id, inherited for each key that assigned(key, legacy_id) lacks.

    A key inherits the entity its codes' claims vote for; of several keys that would inherit one, the least by text does. The others and
    keys without votes get new ids above every id ever assigned or voted, keys without votes first, each in order of the key's text;
    numbers are dealt in parallel.
    """
    named = groupings.where("product IS NOT NULL")
    voted = stored(votes(members, named))
    left = members.select("key").distinct()
    tops = [named.select(F.col("product").alias("id"))]
    if assigned is not None:
        left = left.join(assigned, "key", "left_anti")
        tops.append(assigned.select(F.col("legacy_id").alias("id")))
    whole = tops[0] if len(tops) == 1 else tops[0].union(tops[1])
    floor = whole.agg(F.max("id")).first()[0] or 0
    place = F.row_number().over(W.partitionBy("legacy_id").orderBy("key"))
    wanted = stored(left.join(inherited(voted).select("key", "legacy_id"), "key", "left"))
    some = wanted.where("legacy_id IS NOT NULL").withColumn("place", place)
    none = log.numbered(wanted.where("legacy_id IS NULL").select("key"), ["key"], floor + 1, "legacy_id")
    after = floor + none.count()
    again = log.numbered(some.where("place > 1").select("key"), ["key"], after + 1, "legacy_id")
    kept = some.where("place = 1").select("key", "legacy_id", F.lit(True).alias("inherited"))
    new = lambda df: df.select("key", F.col("legacy_id").cast("bigint").alias("legacy_id"), F.lit(False).alias("inherited"))
    return kept.union(new(none)).union(new(again))


def lands_on(ids: DataFrame, assigned: DataFrame, merges: DataFrame) -> DataFrame:
    """legacy_id, key, merged_from: the key that each asked id answers to today, after all merges(key, into); an absorbed id keeps
    answering. Of several keys with one id, the least by text answers; unknown ids have no key."""
    first = assigned.groupBy("legacy_id").agg(F.min("key").alias("first"))
    ends = ledger.redirects(merges).select(F.col("key").alias("first"), "survivor")
    found = ids.select("legacy_id").join(first, "legacy_id", "left").join(ends, "first", "left")
    return found.select("legacy_id", F.coalesce("survivor", "first").alias("key"), F.when(F.col("survivor").isNotNull(), F.col("first")).alias("merged_from"))
