"""Golden records: what survives of the claims about each key's codes, and what its edges reach.

Members have (lane, key, code); live claims are those of mapping.live(). A policy ranks sources: a table priority(dimension, source, rank),
a function of the columns (dimension, source) to a rank, or None, which leaves every source unranked, so that differing ones tie.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import registry
from loomline.operators import ledger, survivorship

Policy = DataFrame | Callable[[Column, Column], Column] | None



def tagged_text(value: Column) -> Column:
    return F.concat_ws(":", value["t"], value["s"])


def with_rank(entries: DataFrame, policy: Policy, dimension: str = "field") -> DataFrame:
    if policy is None:
        return entries.withColumn("rank", F.lit(survivorship.UNRANKED))
    if callable(policy):
        return entries.withColumn("rank", policy(F.col(dimension), F.col("source")))
    return survivorship.ranked(entries, policy, dimension)


def of_lane(members: DataFrame, lane: str) -> DataFrame:
    return members.where(F.col("lane") == lane).select("key", "code")


def owners(members: DataFrame, lane: str) -> DataFrame:
    """code, owner: the key of a lane that a code belongs to, the least where several hold it."""
    return of_lane(members, lane).groupBy("code").agg(F.min("key").alias("owner"))


def owned(rows: DataFrame, code: str, members: DataFrame, lane: str, name: str) -> DataFrame:
    """Add the owner of a code under ``name``; a code that no key holds stands for itself."""
    index = owners(members, lane).select(F.col("code").alias(code), F.col("owner").alias("__owner"))
    return rows.join(index, code, "left").withColumn(name, F.coalesce("__owner", code)).drop("__owner")


def on_keys(claims: DataFrame, members: DataFrame) -> DataFrame:
    """Claims with the keys that hold their code; a code that two keys hold is claimed of both."""
    return claims.join(members.select("lane", "key", "code"), "code")


def decisions(entries: DataFrame, keys: list[str], policy: Policy, dimension: str = "field") -> DataFrame:
    """survivorship.decide() of claims(keys, source, value, order): each source's latest, ranked by the policy."""
    latest = survivorship.latest_per_source(entries.select(*keys, "source", "value", "order"), keys, [F.col("order")])
    return survivorship.decide(with_rank(latest, policy, dimension), keys)


def overridden(decided: DataFrame, picks: DataFrame | None, keys: list[str]) -> DataFrame:
    """Decisions with a steward's picks(keys, picked, by) in place of what the claims say."""
    if picks is None:
        return decided
    both = decided.join(picks.select(*keys, "picked", "by"), keys, "left")
    mine = F.col("by").isNotNull()
    value = F.when(mine, F.col("picked")).otherwise(F.col("value"))
    winner = F.when(mine, F.concat(F.lit("steward:"), "by")).otherwise(F.col("winner").cast("string"))
    return both.select(*keys, value.alias("value"), winner.alias("winner"), F.when(mine, "resolved_by_steward").otherwise(F.col("status")).alias("status"), "candidates")


def attributes(members: DataFrame, live: DataFrame, policy: Policy = None, picks: DataFrame | None = None) -> DataFrame:
    """lane, key, field, value, winner, status, candidates: the records of every lane, from the attribute claims of their codes."""
    keys = ["lane", "key", "field"]
    rows = on_keys(live.where("kind = 'attribute'").select("code", "source", "field", "value", "order"), members)
    return overridden(decisions(rows, keys, policy), picks, keys)


def lane_records(members: DataFrame, live: DataFrame, lane: str, policy: Policy = None) -> DataFrame:
    """key, codes, attributes of one lane's records, which stand by themselves."""
    own = members.where(F.col("lane") == lane)
    held = own.groupBy("key").agg(F.array_sort(F.collect_set(registry.code_order(F.col("code")))).alias("c")).select("key", F.transform("c", lambda x: x["code"]).alias("codes"))
    said = attributes(own, live, policy).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value", "winner", "status"))).alias("attributes"))
    return held.join(said, "key", "left")


def products(members: DataFrame, live: DataFrame, policy: Policy = None, picks: DataFrame | None = None) -> DataFrame:
    """key, product, winner, status, candidates. Whatever the ranks, a key whose claims name two products is contested: it has none until
    a steward picks(key, picked, by) one. A key without a claim has none and nothing to review."""
    rows = on_keys(live.where("kind = 'grouping'").select("code", "source", F.col("product").alias("value"), "order"), members.where("lane = 'product'"))
    decided = contested(rows.select("key", "source", "value", "order"), ["key"], policy)
    whole = members.where("lane = 'product'").select("key").distinct().join(decided, "key", "left").withColumn("status", F.coalesce("status", F.lit("resolved")))
    return overridden(whole, picks, ["key"]).withColumnRenamed("value", "product")


def contested(entries: DataFrame, keys: list[str], policy: Policy = None) -> DataFrame:
    """Decisions of (keys, source, value, order) that stand only if all the entries, of whatever rank and age, name one value."""
    several = entries.groupBy(*keys).agg((F.min("value") != F.max("value")).alias("several"))
    decided = decisions(entries.withColumn("field", F.lit("product")), [*keys, "field"], policy).drop("field").join(several, keys)
    open_ = F.col("several")
    return decided.select(*keys, F.when(~open_, F.col("value")).alias("value"), F.when(~open_, F.col("winner")).alias("winner"), F.when(open_, "needs_review").otherwise(F.col("status")).alias("status"), "candidates")


def collisions(members: DataFrame, live: DataFrame) -> DataFrame:
    """key, products: keys whose grouping claims name more than one product."""
    rows = on_keys(live.where("kind = 'grouping'").select("code", "product"), members.where("lane = 'product'"))
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("product")).alias("products")).where(F.size("products") > 1)


def media(members: DataFrame, live: DataFrame, policy: Policy = None) -> DataFrame:
    """key, place, asset, role, source, uri: each asset once a key, as the best-ranked source tells it; primary ones first, then by asset."""
    rows = on_keys(live.where("kind = 'media'").select("code", "source", "asset", "role", "uri", "order", F.lit("media").alias("dimension")), members.where("lane = 'product'"))
    ranked = with_rank(rows, policy, "dimension")
    best = ranked.groupBy("key", "asset").agg(F.min_by(F.struct("role", "source", "uri"), F.struct("rank", "source", "order")).alias("m")).select("key", "asset", "m.*")
    return best.select("key", F.struct((F.coalesce("role", F.lit("")) != "primary").alias("other"), "asset").alias("place"), "asset", "role", "source", "uri")


def edges(live: DataFrame, relation: str) -> DataFrame:
    return live.where((F.col("kind") == "edge") & (F.col("relation") == relation)).select(F.col("code").alias("from"), "to", "source", "order")


def categories(members: DataFrame, live: DataFrame) -> DataFrame:
    """key, category: the collections that any source says a code of the key is in."""
    rows = edges(live, "member_of").select(F.col("from").alias("code"), F.col("to").alias("category"))
    return on_keys(rows, members.where("lane = 'product'")).select("key", "category").distinct()


def substances(members: DataFrame, live: DataFrame) -> DataFrame:
    """key, substance, codes, sources: what each product contains; a substance is the key that owns its code now, or else the code."""
    rows = on_keys(edges(live, "contains").withColumnRenamed("from", "code"), members.where("lane = 'product'"))
    found = owned(rows, "to", members, "substance", "substance")
    return found.groupBy("key", "substance").agg(F.array_sort(F.collect_set("to")).alias("codes"), F.array_sort(F.collect_set("source")).alias("sources"))


def descriptions(members: DataFrame, live: DataFrame, contained: DataFrame | None = None) -> DataFrame:
    """key, description, via, asserted_by: what describes the product (``direct``), or a substance it contains, in two steps and no more,
    without the pairs that an edge suppresses. Nothing is copied, so a new edge shows at once."""
    contained = substances(members, live) if contained is None else contained
    told = owned(edges(live, "describes"), "from", members, "description", "description").select("description", "to", "source")
    product = members.where("lane = 'product'")
    direct = on_keys(told.withColumnRenamed("to", "code"), product).select("key", "description", F.lit("direct").alias("via"), "source")
    about = owned(told, "to", members, "substance", "substance").select("substance", "description", "source")
    through = contained.select("key", "substance").join(about, "substance").select("key", "description", F.concat(F.lit("substance:"), "substance").alias("via"), "source")
    hidden = on_keys(owned(edges(live, "suppress"), "from", members, "description", "description").select("description", F.col("to").alias("code")), product).select("key", "description").distinct()
    return direct.union(through).join(hidden, ["key", "description"], "left_anti").groupBy("key", "description", "via").agg(F.array_sort(F.collect_set("source")).alias("asserted_by"))


def depicted(members: DataFrame, live: DataFrame, policy: Policy = None) -> DataFrame:
    """key, asset, role, source, uri: media records that depict a product, with what their own attributes say; a record without a role is
    secondary."""
    rows = on_keys(edges(live, "depicts").withColumnRenamed("to", "code"), members.where("lane = 'product'")).withColumn("dimension", F.lit("media"))
    ranked = with_rank(owned(rows.select("key", "from", "source", "order", "dimension"), "from", members, "media", "asset"), policy, "dimension")
    best = ranked.groupBy("key", "asset").agg(F.min_by("source", F.struct("rank", "source", "order")).alias("source"))
    # A code that no record owns yet is a record of itself.
    records = members.where("lane = 'media'").unionByName(best.join(members.where("lane = 'media'").select(F.col("key").alias("asset")), "asset", "left_anti").select(F.lit("media").alias("lane"), F.col("asset").alias("key"), F.col("asset").alias("code")).distinct())
    said = attributes(records, live.where("field IN ('role', 'uri')"), policy)
    own = said.groupBy(F.col("key").alias("asset")).agg(F.max(F.when(F.col("field") == "role", F.col("value.s"))).alias("role"), F.max(F.when(F.col("field") == "uri", F.col("value.s"))).alias("uri"))
    return best.join(own, "asset", "left").select("key", "asset", F.coalesce("role", F.lit("secondary")).alias("role"), "source", "uri")


def public_ids(members: DataFrame, live: DataFrame, scheme: str = "cnk", policy: Policy = None) -> DataFrame:
    """key, canonical, aliases, status: a key's one code of a scheme, or of several the one whose sources rank best; null, for review, if
    they tie or nobody asserts them. Keys without such a code have no row."""
    held = members.where(registry.scheme_of(F.col("code")) == scheme).select("key", "code").distinct()
    asserted = live.where("kind = 'identity'").select("source", F.explode("codes").alias("code")).distinct()
    entries = held.join(asserted, "code").select("key", "source", "code", F.lit(scheme).alias("field"))
    # A source may assert several of a key's codes; its greatest counts, as of equal orders the greatest value does.
    latest = entries.groupBy("key", "field", "source").agg(F.max("code").alias("value"))
    decided = survivorship.decide(with_rank(latest, policy), ["key", "field"]).select("key", "value", "status")
    all_ = held.groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("codes")).join(decided, "key", "left")
    one = F.size("codes") == 1
    canonical = F.when(one, F.get("codes", F.lit(0))).otherwise(F.col("value"))
    status = F.when(one, "resolved").otherwise(F.coalesce("status", F.lit("needs_review")))
    return all_.select("key", canonical.alias("canonical"), F.filter("codes", lambda x: ~x.eqNullSafe(canonical)).alias("aliases"), status.alias("status"))


def public_id_collisions(members: DataFrame, scheme: str = "cnk") -> DataFrame:
    """code, keys: codes of a scheme that more than one key holds, which none should."""
    held = members.where(registry.scheme_of(F.col("code")) == scheme)
    return held.groupBy("code").agg(F.array_sort(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)


@dataclass(frozen=True)
class Catalog:
    """A projection of claims onto keys, as tables; records() nests them."""

    members: DataFrame
    attributes: DataFrame
    products: DataFrame
    media: DataFrame
    depicted: DataFrame
    categories: DataFrame
    substances: DataFrame
    descriptions: DataFrame
    public_ids: DataFrame

    def variants(self) -> DataFrame:
        """key, product, product_status, codes, public_id, attributes, categories, media, substances, descriptions: a row for each key of the
        product lane."""
        listed = lambda df, what, name: df.groupBy("key").agg(F.array_sort(F.collect_list(what)).alias(name))
        codes = self.members.where("lane = 'product'").groupBy("key").agg(F.array_sort(F.collect_set(registry.code_order(F.col("code")))).alias("c")).select("key", F.transform("c", lambda x: x["code"]).alias("codes"))
        shown = self.media.select("key", "asset", "role", "source", "uri", F.struct(F.lit(0), (F.coalesce("role", F.lit("")) != "primary")).alias("p")).unionByName(self.depicted.select("key", "asset", "role", "source", "uri", F.struct(F.lit(1), F.lit(False)).alias("p")))
        described = self.descriptions.select("key", F.struct((F.col("via") != "direct").alias("far"), "via", "description", "asserted_by").alias("d"))
        out = self.products.select("key", "product", F.col("status").alias("product_status")).join(codes, "key")
        for more in (
            self.public_ids.select("key", F.struct("canonical", "aliases", "status").alias("public_id")),
            listed(self.attributes.where("lane = 'product'"), F.struct("field", "value", "winner", "status", "candidates"), "attributes"),
            listed(self.categories, F.col("category"), "categories"),
            listed(shown, F.struct("p", "asset", "role", "source", "uri"), "media"),
            listed(self.substances, F.struct("substance", "codes", "sources"), "substances"),
            listed(described, F.col("d"), "descriptions"),
        ):
            out = out.join(more, "key", "left")
        return out

    def records(self) -> DataFrame:
        """product, keys: products with their variants' keys, in order of the keys' numbers; contested and nameless variants come under no
        product, each key by itself."""
        own = self.products.select("product", "key", ledger.key_number(F.col("key")).alias("n"))
        named = own.where("product IS NOT NULL").groupBy("product").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("v"))
        return named.select("product", F.transform("v", lambda x: x["key"]).alias("keys")).unionByName(own.where("product IS NULL").select("product", F.array("key").alias("keys")))


def project(members: DataFrame, live: DataFrame, policy: Policy = None, picks: DataFrame | None = None, product_picks: DataFrame | None = None, scheme: str = "cnk") -> Catalog:
    """The catalogue of live claims over members. ``picks`` (lane, key, field, picked, by) and ``product_picks`` (key, picked, by) are what
    stewards decided."""
    contained = substances(members, live)
    return Catalog(
        members, attributes(members, live, policy, picks), products(members, live, policy, product_picks), media(members, live, policy), depicted(members, live, policy),
        categories(members, live), contained, descriptions(members, live, contained), public_ids(members, live, scheme, policy),
    )
