"""Queries of the batch fold over the driver's tables: histories to golden records, the cross-reference, reports, reads and the timeline.

Each order is one raw delta of its customer's history: its organisation (by the order's number) says the customer's code again, and a name,
a weight and a brand. Two neighbouring customers share a barcode. The even one has a national code; in every fifth pair both have their
own, so that the guard keeps them apart, and in another fifth both have the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import registry
from loomline.operators import catalog, golden, ledger, legacy, mapping, parity, policy, reads, steward, timeline, writes
from loomline.plans.catalogue import query, table
from loomline.session import spread, stored
from loomline.sources import envelope, store
from loomline.streaming import feed

DAY = 86_400


def history(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    org, pair = 1 + k % 2, F.floor(c / 2)
    said = F.when((org == 1) & ((c % 2 == 0) | (pair % 5 >= 3)), F.format_string('["1","cnk:1","%07d"],', F.when(pair % 5 == 3, pair * 2).otherwise(c))).otherwise("")
    code = F.format_string('["2","ean:%d","ean_%d"],', org, F.lit(5_400_000_000_000) + pair)
    rest = F.format_string('["1","name:fr:%d","n%d"],["1","weight:%d","%d.5_kg"],["2","brands:%d","b%d"],["1","updatedAt",%d]', org, k % 3, org, k % 5, org, k % 4, k * DAY)
    line = F.concat(F.format_string('{"id":%d,"tag":null,"entity":%d,"events":[', k, c), said, code, rest, F.format_string('],"created_at":%d,"created_by":7}', k * DAY))
    return spread(table(spark, d, "orders").select("o_orderkey", "o_custkey")).select(line.alias("line"))


def events(spark, d) -> DataFrame:
    return mapping.as_history(envelope.decode(envelope.deltas_of(history(spark, d))), "shop")


HISTORY = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey // 2 AS p, 1 + o_orderkey % 2 AS org FROM orders),
has AS (SELECT DISTINCT p, CASE WHEN p % 5 = 3 THEN 2 * p ELSE c END AS cnk FROM o WHERE org = 1 AND (c % 2 = 0 OR p % 5 >= 3)),
cl AS (SELECT p, cnk FROM has UNION ALL SELECT DISTINCT p, NULL FROM o WHERE p NOT IN (SELECT p FROM has)),
g AS (SELECT p, CASE WHEN cnk IS NOT NULL THEN 'cnk:' || lpad(cnk::VARCHAR, 7, '0') END AS cc, 'gtin:' || lpad((5400000000000 + p)::VARCHAR, 14, '0') AS gtin FROM cl),
keyed AS (SELECT *, row_number() OVER (ORDER BY coalesce(cc, gtin)) AS n FROM g),
keys AS (SELECT p, cc, gtin, n, 'SK_' || n AS key, concat_ws(',', cc, gtin) AS codes FROM keyed)"""
SAID = """last AS (SELECT p, org, max(k) AS k FROM o GROUP BY ALL),
says AS (SELECT p, org, 'name:fr' AS field, 's:n' || k % 3 AS value FROM last UNION ALL SELECT p, org, 'weight', 'i:' || ((k % 5) * 1000 + 500) FROM last),
dec AS (SELECT p, field, count(DISTINCT value) > 1 AS tie, min(org) AS winner, arg_min(value, org) AS value FROM says GROUP BY ALL),
att AS (SELECT p, string_agg(field || '=' || CASE WHEN tie THEN '?' ELSE value || '@' || winner END, ',' ORDER BY field) AS attributes FROM dec GROUP BY p)"""
GROUPED = """began AS (SELECT p, c, org, min(k) AS k FROM o GROUP BY ALL), owner AS (SELECT p, org, arg_max(c, k) AS c FROM began GROUP BY ALL),
coded AS (SELECT began.p, 'cnk:' || lpad((CASE WHEN p % 5 = 3 THEN 2 * p ELSE c END)::VARCHAR, 7, '0') AS cc, arg_max(c, k) AS c FROM began WHERE org = 1 AND (c % 2 = 0 OR p % 5 >= 3) GROUP BY ALL),
named AS (SELECT key, owner.c FROM keys JOIN owner USING (p) UNION ALL SELECT key, coded.c FROM keys JOIN coded USING (cc)),
prod AS (SELECT key, CASE WHEN min(c) = max(c) THEN min(c) END AS product, CASE WHEN min(c) = max(c) THEN 'resolved' ELSE 'needs_review' END AS product_status FROM named GROUP BY key)"""


@query(f"""WITH {HISTORY}, {SAID}, {GROUPED}, cat AS (SELECT p, string_agg(DISTINCT 'brands:b' || k % 4, ',' ORDER BY 'brands:b' || k % 4) AS categories FROM o GROUP BY p)
SELECT key, codes, product, product_status, cc AS public_id, attributes, categories FROM keys JOIN prod USING (key) JOIN att USING (p) JOIN cat USING (p)""")
def golden_records(spark, d):
    found = golden.golden_records(events(spark, d)).variants()
    value = lambda a: F.when(a["status"] == "needs_review", F.concat(a["field"], F.lit("=?"))).otherwise(F.concat(a["field"], F.lit("="), catalog.tagged_text(a["value"]), F.lit("@"), a["winner"]))
    return found.select("key", F.array_join("codes", ",").alias("codes"), "product", "product_status", F.col("public_id.canonical").alias("public_id"), F.array_join(F.transform("attributes", value), ",").alias("attributes"), F.array_join("categories", ",").alias("categories"))


@query(f"WITH {HISTORY} SELECT 'minted' AS type, key, codes, '' AS keys FROM keys UNION ALL SELECT 'merge_proposed', NULL, string_agg(cc, ',' ORDER BY cc) || ',' || min(gtin), string_agg(key, '+' ORDER BY key) FROM keys GROUP BY p HAVING count(*) > 1 "
       "UNION ALL SELECT 'identity_conflict', NULL, min(gtin), '' FROM keys GROUP BY p HAVING count(*) > 1")
def identity_events(spark, d):
    told = golden.from_events(events(spark, d)).events()
    return told.select("type", "key", F.array_join("codes", ",").alias("codes"), F.array_join("keys", "+").alias("keys"))


@query(f"WITH {HISTORY}, x AS (SELECT key, unnest(string_split(codes, ',')) AS code FROM keys) SELECT key, code FROM x")
def ledger_fold(spark, d):
    """Members folded from the identity events: the ledger is what its log says."""
    return ledger.fold(golden.from_events(events(spark, d)).events()).select("key", "code")


XREF = HISTORY + """,
placed AS (SELECT DISTINCT key, n, p, o.c FROM keys JOIN o USING (p)), tn AS (SELECT key, count(*) AS tenants FROM placed GROUP BY key),
nat AS (SELECT DISTINCT p, c, CASE WHEN p % 5 = 3 THEN 2 * p ELSE c END AS cnk FROM o WHERE org = 1 AND (c % 2 = 0 OR p % 5 >= 3)),
trusted AS (SELECT c FROM nat SEMI JOIN (SELECT p, cnk FROM nat GROUP BY ALL HAVING count(*) > 1) USING (p, cnk)),
x AS (SELECT c AS entity, 'SK_' || min(n) AS "primary", string_agg(key, ',' ORDER BY n) AS keys, count(*) AS m, max(tenants) AS tenants FROM placed JOIN tn USING (key) GROUP BY c),
xref AS (SELECT entity, "primary", keys, CASE WHEN m > 1 THEN 'split' WHEN tenants = 1 THEN 'stable' WHEN entity IN (SELECT c FROM trusted) THEN 'merged' ELSE 'merged-suspect' END AS relation FROM x)"""


def fold_of(spark, d) -> golden.Rederivation:
    return golden.from_events(events(spark, d))


def groupings(folded: golden.Rederivation) -> DataFrame:
    return folded.claims.where("kind = 'grouping'").select("code", "product", "source")


@query(f"WITH {XREF} SELECT * FROM xref")
def xref_relation(spark, d):
    folded = fold_of(spark, d)
    return legacy.xref(folded.members, groupings(folded)).select("entity", "primary", F.array_join("keys", ",").alias("keys"), "relation")


@query(f"""WITH {XREF} SELECT count_if(relation = 'stable') AS confirmed, count_if(relation IN ('merged', 'merged-suspect')) AS merged, count_if(relation = 'split') AS split,
(SELECT count(*) FROM (SELECT p FROM keys GROUP BY p HAVING count(*) > 1)) AS collision, count_if(relation = 'merged-suspect') + (SELECT count(*) FROM (SELECT p FROM keys GROUP BY p HAVING count(*) > 1)) AS needs_review FROM xref""")
def migration_diff(spark, d):
    folded = fold_of(spark, d)
    return legacy.diff_counts(legacy.migration_diff(legacy.xref(folded.members, groupings(folded)), catalog.public_id_collisions(folded.members, "gtin")))


@query(f"WITH {HISTORY} SELECT min(gtin) AS code, string_agg(key, ',' ORDER BY key) AS keys FROM keys GROUP BY p HAVING count(*) > 1")
def id_collisions(spark, d):
    return catalog.public_id_collisions(fold_of(spark, d).members, "gtin").select("code", F.array_join("keys", ",").alias("keys"))


@query(f"WITH {HISTORY} SELECT DISTINCT c AS entity, org::VARCHAR AS source, min(k) OVER (PARTITION BY c, org) * 86400 AS from_at, concat_ws(',', CASE WHEN org = 1 AND (c % 2 = 0 OR p % 5 >= 3) THEN 'cnk:' || lpad((CASE WHEN p % 5 = 3 THEN 2 * p ELSE c END)::VARCHAR, 7, '0') END, 'gtin:' || lpad((5400000000000 + p)::VARCHAR, 14, '0')) AS codes FROM o")
def history_periods(spark, d):
    return mapping.periods(events(spark, d)).where("to_at IS NULL").select("entity", "source", "from_at", F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {HISTORY}, l AS (SELECT DISTINCT p, c, org FROM o), n AS (SELECT l.*, 1 + (org = 1 AND (c % 2 = 0 OR p % 5 >= 3))::INT AS codes FROM l)
SELECT 'identity' AS kind, (SELECT count(*) FROM n) AS claims UNION ALL SELECT 'grouping', (SELECT sum(codes)::BIGINT FROM n) UNION ALL SELECT 'attribute', (SELECT sum(2 * codes)::BIGINT FROM o JOIN n USING (p, c, org)) UNION ALL SELECT 'edge', (SELECT sum(codes)::BIGINT FROM o JOIN n USING (p, c, org))""")
def claim_counts(spark, d):
    whole = stored(mapping.periods(events(spark, d)))
    return mapping.claims(events(spark, d), whole).groupBy("kind").agg(F.count("*").alias("claims"))


def odd_events(spark, d) -> DataFrame:
    """An event of a user is one of a history: every fifth names a code and the others speak of it, or of nothing."""
    k = F.col("event_id")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % 5).cast("int") + 1)
    text = F.struct(F.lit("s").alias("t"), k.cast("string").alias("s"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("entity"), F.lit("app").alias("source_system"), k.alias("order"), (k * 60).alias("recorded_at"), (k * 60).alias("valid_from"),
        F.when(k % 5 == 3, F.lit(None)).otherwise((k % 3).cast("string")).alias("source"), pick("set", "set", "remove", "set", "add").alias("op"), pick("identity", "attribute", "edge", "attribute", "media").alias("kind"),
        F.when(k % 5 == 0, "cnk").alias("scheme"), F.when(k % 5 == 0, F.col("user_id").cast("string")).alias("code"), F.when(F.col("event_id") % 5 % 2 == 1, "note").alias("field"), F.lit(None).cast("string").alias("locale"),
        pick(None, None, "brands", None, "films").alias("collection"), F.when(k % 5 > 0, text).alias("value"),
    )


@query("""WITH e AS (SELECT event_id AS k, user_id AS u, event_id % 5 AS m, event_id % 3 AS s FROM events), i AS (SELECT u, s, min(k) AS k FROM e WHERE m = 0 GROUP BY ALL), f AS (SELECT u, min(k) AS k FROM i GROUP BY u)
SELECT e.u AS entity, e.k AS "order", CASE WHEN m = 2 THEN 'unsupported_edge_op' WHEN m = 4 THEN 'unknown_lane_collection' WHEN m = 3 THEN 'unsourced' ELSE 'source_held_no_code' END AS reason FROM e LEFT JOIN i ON i.u = e.u AND i.s = e.s LEFT JOIN f ON f.u = e.u
WHERE m IN (2, 4) OR m = 3 AND coalesce(f.k > e.k, TRUE) OR m = 1 AND i.k IS NULL""")
def rejected_events(spark, d):
    rows = odd_events(spark, d)
    return mapping.rejected(rows, stored(mapping.periods(rows))).select("entity", "order", "reason")


SCORES = policy.Context(field_scores={"name:fr": {"g": 5, "2": 9}, "weight": {"2": 3}}, group_of={"1": "g"}, product_orgs=("1",), source_order=("1", "2"))


@query(f"""WITH {HISTORY}, {SAID}, one AS (SELECT p, field, max(value) FILTER (org = 1) AS a, max(value) FILTER (org = 2) AS b FROM says GROUP BY ALL)
SELECT key, field, a AS with_penalty, b AS without_penalty FROM keys JOIN one USING (p) WHERE a IS NOT NULL AND b IS NOT NULL""")
def policy_penalty_flips(spark, d):
    """The second organisation is an outsider: only the penalty keeps its higher scores from winning."""
    folded = fold_of(spark, d)
    return policy.penalty_flips(folded.members, folded.live, SCORES).select("key", "field", catalog.tagged_text(F.col("with.value")).alias("with_penalty"), catalog.tagged_text(F.col("without.value")).alias("without_penalty"))


@query(f"""WITH {HISTORY}, {SAID}, one AS (SELECT key, min(p) AS p FROM keys GROUP BY key)
SELECT CASE WHEN tie THEN 'unresolved' WHEN p % 4 = 0 THEN 'value_mismatch' WHEN p % 4 = 1 THEN 'engine_only' ELSE 'match' END AS verdict, count(*) AS n FROM one JOIN dec USING (p) GROUP BY ALL
UNION ALL SELECT 'applier_only', count(*) FROM one UNION ALL SELECT 'match in sets', (SELECT count(*) FROM keys) + (SELECT count(cc) FROM keys) + (SELECT sum(n)::BIGINT FROM (SELECT count(DISTINCT k % 4) AS n FROM keys JOIN o USING (p) GROUP BY key))""")
def parity_verdicts(spark, d):
    """A snapshot against itself with some attributes changed, some gone and one more."""
    folded = fold_of(spark, d)
    found = catalog.project(folded.members, folded.live)
    number = F.col("key").alias("key"), ledger.key_number(F.col("key")).alias("entity")
    pair = folded.members.where(registry.scheme_of(F.col("code")) == "gtin").select(ledger.key_number(F.col("key")).alias("entity"), (registry.value_of(F.col("code")).cast("bigint") - 5_400_000_000_000).alias("p"))
    engine = stored(parity.snapshot(found, folded.members.select(*number).distinct()))
    m = F.col("p") % 4
    other = engine.join(pair, "entity").where((F.col("lane") != "attribute") | F.col("candidates").isNotNull() | (m != 1))
    value = F.when((F.col("lane") == "attribute") & (m == 0), F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    other = other.select("entity", "lane", "name", value.alias("value"), F.lit(None).cast("string").alias("candidates"))
    more = pair.select("entity", F.lit("attribute").alias("lane"), F.lit("zz").alias("name"), F.lit("s:x").alias("value"), F.lit(None).cast("string").alias("candidates"))
    compared = parity.compare(engine, other.unionByName(more))
    label = F.when((F.col("verdict") == "match") & (F.col("lane") != "attribute"), "match in sets").otherwise(F.col("verdict"))
    return compared.groupBy(label.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"WITH {HISTORY}, a AS (SELECT DISTINCT c FROM o) SELECT c AS legacy_id, key, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS merged FROM (SELECT c, c AS k FROM a) JOIN (SELECT n, 'SK_' || (n - (n % 2 = 0)::INT) AS key FROM keys) ON n = k")
def legacy_reads(spark, d):
    """Every customer's number as a legacy id that the key of that number had; even keys were merged into the one before."""
    folded = fold_of(spark, d)
    keys = folded.members.where("lane = 'product'").select("key").distinct().withColumn("n", ledger.key_number(F.col("key")))
    assigned = keys.select("key", F.col("n").alias("legacy_id"))
    merges = keys.where("n % 2 = 0").select("key", F.concat(F.lit("SK_"), F.col("n") - 1).alias("into"))
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("legacy_id")).distinct()
    found = legacy.lands_on(asked, assigned, merges).where("key IS NOT NULL")
    return found.select("legacy_id", "key", F.when(F.col("merged_from").isNotNull(), 1).otherwise(0).alias("merged"))


@query(f"WITH {HISTORY} SELECT DISTINCT o.c AS value, key FROM o JOIN keys ON cc = 'cnk:' || lpad(o.c::VARCHAR, 7, '0')")
def code_reads(spark, d):
    folded = fold_of(spark, d)
    asked = table(spark, d, "orders").select(F.lit("cnk").alias("scheme"), F.format_string(" %07d ", "o_custkey").alias("value")).distinct()
    return reads.by_code(asked, folded.members).select(F.expr("cast(substring(code, 5) AS bigint)").alias("value"), "key")


@query(f"""WITH {HISTORY}, r AS (SELECT n, key FROM keys)
SELECT key, CASE WHEN n % 3 = 0 THEN 'merged' ELSE 'active' END AS status, CASE WHEN n % 3 = 0 THEN 'SK_' || (n - 1) ELSE key END AS canonical FROM r UNION ALL SELECT 'SK_' || (n + 100000000), 'unknown', NULL FROM r""")
def key_statuses(spark, d):
    folded = fold_of(spark, d)
    keys = folded.members.select("key").distinct().withColumn("n", ledger.key_number(F.col("key")))
    merges = keys.where("n % 3 = 0").select("key", F.concat(F.lit("SK_"), F.col("n") - 1).alias("into"))
    asked = keys.select("key").union(keys.select(F.concat(F.lit("SK_"), F.col("n") + 100_000_000)))
    left = folded.members.join(merges.select("key"), "key", "left_anti")
    return reads.statuses(asked, folded.events(), left, merges)


@query(f"""WITH {HISTORY} SELECT keys.key AS owner, string_agg(DISTINCT org::VARCHAR, ',' ORDER BY org::VARCHAR) AS sources, code FROM (SELECT key, p, unnest(string_split(codes, ',')) AS code, cc FROM keys) keys
JOIN o USING (p) WHERE starts_with(code, 'gtin') OR org = 1 AND (c % 2 = 0 OR p % 5 >= 3) AND code = 'cnk:' || lpad((CASE WHEN p % 5 = 3 THEN 2 * p ELSE c END)::VARCHAR, 7, '0') GROUP BY keys.key, code""")
def steward_codes(spark, d):
    folded = fold_of(spark, d)
    return steward.codes_with_sources(folded.members, folded.live).select(F.col("key").alias("owner"), F.array_join("sources", ",").alias("sources"), "code")


def two_batches(spark, d) -> tuple[store.Store, list[dict]]:
    """The present claims of half of the customers taken into a store, then of all, then of all again."""
    rows = stored(events(spark, d))
    kept = store.Store(spark, feed.scratch(spark))
    listed = stored(mapping.periods(rows))
    whole = mapping.placed_claims(rows, listed).withColumnRenamed("order", "index")
    half = whole.where(F.floor(F.col("place.entity") / 2) % 2 == 0)
    return kept, [writes.take(kept, batch.drop("place"), compact=True) for batch in (half, whole, whole)]


@query(f"WITH {HISTORY} SELECT p, codes FROM keys")
def store_members(spark, d):
    """What a store holds after batches that overlap: every pair's codes, whichever batch they came with."""
    kept, _ = two_batches(spark, d)
    held = kept.read("members").groupBy("key").agg(F.array_sort(F.collect_set(registry.code_order(F.col("code")))).alias("c"))
    codes = F.transform("c", lambda x: x["code"])
    gtin = F.get(F.filter(codes, lambda x: F.startswith(x, F.lit("gtin:"))), F.lit(0))
    return held.select((registry.value_of(gtin).cast("bigint") - 5_400_000_000_000).alias("p"), F.array_join(codes, ",").alias("codes"))


@query(f"WITH {HISTORY}, n AS (SELECT p % 2 = 0 AS first, count(*) AS keys FROM keys GROUP BY ALL) SELECT 0 AS drift, (SELECT count(*) FROM keys) AS keys, TRUE AS replayed_nothing, TRUE AS only_new")
def store_rebuild(spark, d):
    """The store's tables against those folded anew from its log; a batch sent again is accepted in no part."""
    kept, answers = two_batches(spark, d)
    keys = kept.read("members").select("key").distinct().count()
    return spark.createDataFrame([(writes.drift(kept).count(), keys, answers[2]["accepted"] == 0, answers[1]["skipped"] == answers[0]["accepted"])], "drift int, keys bigint, replayed_nothing boolean, only_new boolean")


@query(f"WITH {HISTORY}, d AS (SELECT p, min(k) AS k FROM o GROUP BY p) SELECT k::INT AS day, count(*) AS minted FROM d GROUP BY ALL")
def timeline_firsts(spark, d):
    """The days on which pairs of customers first have a key, by the fold over all days."""
    told = timeline.fold_forward(golden.identity_claims(events(spark, d)))
    first = told.where("type = 'minted'").withColumn("p", F.expr("cast(substring(element_at(filter(codes, c -> c LIKE 'gtin:%'), 1), 6) AS bigint)")).groupBy("p").agg(F.min("day").alias("day"))
    return first.groupBy("day").agg(F.count("*").alias("minted"))


@query(f"WITH {HISTORY} SELECT p, count(*) AS keys, string_agg(codes, ';' ORDER BY codes) AS codes FROM keys GROUP BY p")
def timeline_members(spark, d):
    """Keys at the end of time, folded day by day: the codes of each pair's keys are those of the batch fold."""
    told = timeline.fold_forward(golden.identity_claims(events(spark, d)))
    held = ledger.fold(told).groupBy("key").agg(F.array_sort(F.collect_set(registry.code_order(F.col("code")))).alias("c")).select(F.transform("c", lambda x: x["code"]).alias("c"))
    pair = F.expr("cast(substring(element_at(filter(c, x -> x LIKE 'gtin:%'), 1), 6) AS bigint)") - 5_400_000_000_000
    return held.select(pair.alias("p"), F.array_join("c", ",").alias("codes")).groupBy("p").agg(F.count("*").alias("keys"), F.array_join(F.array_sort(F.collect_list("codes")), ";").alias("codes"))
