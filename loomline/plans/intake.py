"""Queries over sources, the event log, streams, validation and stewardship, with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import codes, dimensions
from loomline.operators import records, slots, stewardship, survivorship, validate
from loomline.plans.catalogue import CLAIMS, CURRENT, ORDER, RANKED, claims, current, priority, query, table
from loomline.sources import envelope, log, trade
from loomline.streaming import feed


def delta_lines(spark, d) -> DataFrame:
    """Raw deltas as JSON lines, one for each event: codes, a deleted entry, a localised attribute, a member, or a touch only."""
    k, m = F.col("event_id"), F.col("event_id") % 6
    event = (
        F.when(m == 0, F.format_string('["1","cnk:12","%d"],', k))
        .when(m == 1, F.format_string('["2","eanGtin13:34","eanGtin13_%d"],', k))
        .when(m == 2, F.lit('["4","eanGtin13",34],'))
        .when(m == 3, F.format_string('["1","name:fr:12",%d],', k))
        .when(m == 4, F.format_string('["2","brands:12","%d"],', k))
        .otherwise("")
    )
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    line = F.format_string('{"id":%d,"tag":null,"entity":%d,"events":[%s["1","updatedAt",%d]],"created_at":%d,"created_by":7}', k, F.col("user_id"), event, sec + m, sec)
    return table(spark, d, "events").select(line.alias("line"))


DELTAS = "e AS (SELECT event_id, user_id, event_id % 6 AS m, floor(epoch(ts))::BIGINT AS sec FROM events)"


@query(f"""WITH {DELTAS} SELECT user_id AS entity, event_id AS delta, sec AS recorded_at, CASE WHEN m IN (1, 4) THEN 'add' WHEN m = 2 THEN 'delete' ELSE 'set' END AS op,
CASE WHEN m < 3 THEN 'identity' WHEN m = 3 THEN 'attribute' ELSE 'edge' END AS kind, CASE WHEN m IN (1, 2) THEN '34' ELSE '12' END AS source,
CASE m WHEN 0 THEN 'cnk' WHEN 1 THEN 'eanGtin13' WHEN 2 THEN 'eanGtin13' END AS scheme, CASE WHEN m < 2 THEN event_id::VARCHAR END AS code, CASE WHEN m = 3 THEN 'name' END AS field, CASE WHEN m = 3 THEN 'fr' END AS locale,
CASE WHEN m = 4 THEN 'brands' END AS collection, CASE m WHEN 3 THEN 'i:' || event_id WHEN 4 THEN 's:' || event_id END AS value FROM e WHERE m < 5""")
def delta_decode(spark, d):
    events = envelope.decode(envelope.deltas_of(delta_lines(spark, d)))
    value = F.when(F.col("value").isNotNull(), F.concat_ws(":", "value.t", "value.s"))
    return events.select("entity", "delta", "recorded_at", "op", "kind", "source", "scheme", "code", "field", "locale", "collection", value.alias("value"))


@query(f"WITH {DELTAS} SELECT user_id AS entity, max(sec + m) AS last_touched_at, count(*) FILTER (m = 5) AS dropped_meta_count FROM e GROUP BY user_id")
def delta_touched(spark, d):
    return envelope.touched(envelope.deltas_of(delta_lines(spark, d)))


def envelopes(spark, d) -> DataFrame:
    """A history of one or two events for each event, some of them malformed."""
    k, m = F.col("event_id"), F.col("event_id") % 7
    second = (
        F.when(m == 0, ',{"recorded_at":5,"op":"set","kind":"identity","code":"1"}')
        .when(m == 1, ',{"recorded_at":5,"op":"drop","kind":"identity","scheme":"cnk","code":"1"}')
        .when(m == 2, ',{"recorded_at":5,"op":"set","kind":"attribute","field":"name"}')
        .when(m == 3, ',{"recorded_at":5,"op":"delete","kind":"media","collection":"media"}')
        .otherwise(',{"op":"set","kind":"price"}')
    )
    first = F.format_string('{"recorded_at":%d,"op":"set","kind":"identity","scheme":"cnk","source":"3","code":"%d"}', k, k)
    version = F.when(m == 4, "2").otherwise("1")
    events = F.when(m == 5, F.lit("{}")).otherwise(F.concat(F.lit("["), first, F.when(m < 4, second).otherwise(""), F.lit("]")))
    return table(spark, d, "events").select(F.format_string('{"schema_version":"%s","source_system":"x","legacy_entity":%d,"events":%s}', version, k, events).alias("line"))


@query("""WITH e AS (SELECT event_id AS entity, event_id % 7 AS m FROM events)
SELECT entity, CASE WHEN m < 3 THEN 1 END AS "order", ['missing_scheme', 'unknown_op', 'missing_value', NULL, 'unsupported_version', 'events_not_a_list'][m + 1] AS error FROM e WHERE m NOT IN (3, 6)""")
def envelope_errors(spark, d):
    return envelope.envelope_events(envelope.envelopes_of(envelopes(spark, d))).where("error IS NOT NULL").select("entity", "order", "error")


@query("SELECT 'identity' AS kind, count(*) AS n FROM events WHERE event_id % 7 IN (3, 6) UNION ALL SELECT 'media', count(*) FROM events WHERE event_id % 7 = 3")
def envelope_kind_counts(spark, d):
    return envelope.kind_counts(envelope.accepted(envelope.envelope_events(envelope.envelopes_of(envelopes(spark, d)))))


# Dimensions.
RENAMED = {"colour": "color", "color": "tint", "size:fr": "taille", "size": "extent", "a": "b", "b": "a"}
NAMES = ("colour", "colour:fr", "size:fr", "size:nl", "weight", "color:de")


@query("WITH n AS (SELECT p_partkey, (p_partkey % 6 + 1)::INT AS k FROM part) SELECT p_partkey, ['colour', 'colour:fr', 'size:fr', 'size:nl', 'weight', 'color:de'][k] AS name, ['tint', 'tint:fr', 'taille', 'extent:nl', 'weight', 'tint:de'][k] AS resolved FROM n")
def alias_resolve(spark, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 6).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("resolved", dimensions.resolve(F.col("name"), RENAMED))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'size' ELSE 'size:fr' END AS field, CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '"' || p_partkey || '"' WHEN 2 THEN '[1,' || p_partkey || ']' ELSE '[]' END AS value FROM part""")
def list_unwrap(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.format_string("[%d]", k)).when(k % 4 == 1, F.format_string('["%d"]', k)).when(k % 4 == 2, F.format_string("[1,%d]", k)).otherwise("[]")
    return table(spark, d, "part").select("p_partkey", dimensions.field_name(F.lit("size"), F.when(k % 3 > 0, "fr")).alias("field"), dimensions.unwrapped(raw).alias("value"))


# Validation.
@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 9 AS m FROM part) SELECT * FROM (
SELECT k AS index, 'kind' AS field, 'error' AS level, 'unknown kind' AS finding FROM p WHERE m = 1
UNION ALL SELECT k, 'code', 'error', 'not scheme:value' FROM p WHERE m = 2
UNION ALL SELECT k, 'code', 'warning', 'not gtin-shaped' FROM p WHERE m = 3
UNION ALL SELECT k, 'code', 'warning', 'unknown scheme' FROM p WHERE m = 4
UNION ALL SELECT k, 'valid_to', 'error', 'not later than valid_from' FROM p WHERE m = 5
UNION ALL SELECT k, 'relation', 'error', 'lanes do not fit' FROM p WHERE m = 6
UNION ALL SELECT k, 'role', 'warning', 'taken as secondary' FROM p WHERE m = 7
UNION ALL SELECT k, 'valid_from', 'error', 'no date' FROM p WHERE m = 8
UNION ALL SELECT k, 'field', 'error', 'required' FROM p WHERE m = 8)""")
def claim_validation_findings(spark, d):
    k, m = F.col("p_partkey"), F.col("p_partkey") % 9
    text = lambda c: F.concat(F.lit(c), k.cast("string"))
    batch = table(spark, d, "part").select(
        k.alias("index"), F.lit("s").alias("source"),
        F.when(m == 1, "wish").when(m == 6, "edge").when(m == 7, "media").when(m.isin(5, 8), "attribute").otherwise("identity").alias("kind"),
        F.when(m == 2, F.lit("cnk")).when(m == 3, text("ean:x")).when(m == 4, text("local:")).otherwise(text("pzn:")).alias("code"),
        F.when(m == 6, text("pzn:")).alias("to"), F.when(m == 6, "contains").alias("relation"), F.when(m == 5, "name").alias("field"), F.when(m == 7, "cover").alias("role"),
        F.when(m == 5, "2024-02-01").when(m == 8, "soon").alias("valid_from"), F.when(m == 5, "2024-02-01").alias("valid_to"),
    )
    return validate.findings(batch)


# The log and its streams.
@query("SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS \"offset\" FROM events")
def log_offsets(spark, d):
    """Two batches appended, read back."""
    path, rows = feed.scratch(spark), table(spark, d, "events").select("ts", "event_id", "user_id")
    middle = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]
    cut = F.lit(middle)
    log.append(spark, path, rows.where(F.col("event_id") < cut), 0, ["ts", "event_id"])
    log.append(spark, path, rows.where(F.col("event_id") >= cut), 1, ["ts", "event_id"])
    return log.since(spark.read.parquet(path), -1).select("event_id", "user_id", "offset")


def event_stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    # A glob, so that the reader takes a file and a folder of files alike.
    return feed.follow(spark, f"{d}/events.parque[t]", schema)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_slot_view(spark, d):
    """The slots' current claims, kept by a stream over the events."""
    path, slot = feed.scratch(spark), ["user_id", "event_type"]
    feed.write_changes(feed.slot_view(event_stream(spark, d).select(*slot, "event_id", "value"), slot, ["event_id"]), path, f"{path}-cursor")
    return feed.latest(spark.read.parquet(path), slot, ["event_id"])


@query("SELECT user_id, json_extract_string(props, '$.k') AS value FROM events GROUP BY ALL")
def stream_replay(spark, d):
    """Events of equal content are taken in once."""
    path = feed.scratch(spark)
    rows = event_stream(spark, d).select("user_id", F.get_json_object("props", "$.k").alias("value"))
    seen = feed.first_seen(rows.withColumn("fingerprint", F.sha2(F.to_json(F.struct("user_id", "value")), 256)), "fingerprint")
    feed.write_changes(seen, path, f"{path}-cursor")
    return spark.read.parquet(path).select("user_id", "value")


@query(f"""WITH {CLAIMS}, cur AS (SELECT source, code, field FROM claims GROUP BY ALL), seen AS (SELECT source, code, field, value FROM claims GROUP BY ALL)
SELECT field, count(*) AS claims, (SELECT count(*) FROM cur c WHERE c.field = claims.field) AS compacted, (SELECT count(*) FROM seen s WHERE s.field = claims.field) AS contents FROM claims GROUP BY field""")
def cutover_counts(spark, d):
    """Of a history to be cut over: claims, what compaction leaves, and different contents."""
    c = claims(spark, d)
    kept = slots.current(c, ["source", "code", "field"], ORDER).groupBy("field").agg(F.count("*").alias("compacted"))
    contents = c.select("source", "code", "field", "value").distinct().groupBy("field").agg(F.count("*").alias("contents"))
    return c.groupBy("field").agg(F.count("*").alias("claims")).join(kept, "field").join(contents, "field")


@query(f"WITH {CURRENT} SELECT source, code, field, value, day FROM current")
def rebuild_check(spark, d):
    """The slots folded from an earlier state and what came after: they are those folded from zero."""
    slot, cut = ["source", "code", "field"], "day < DATE '1997-01-01'"
    c = claims(spark, d)
    state = slots.current(c.where(cut), slot, ORDER)
    return slots.current(state.unionByName(c.where(f"NOT ({cut})")), slot, ORDER).select("source", "code", "field", "value", "day")


# Stewardship.
@query("SELECT l_partkey AS subject, count(DISTINCT l_suppkey) AS actors, count(DISTINCT l_suppkey) >= 24 AS approved FROM lineitem GROUP BY l_partkey")
def endorsements(spark, d):
    return stewardship.endorsed(table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("actor")), needed=24)


@query(f"""WITH {CLAIMS}, o AS (SELECT code, field, arg_max(value, (day, l_orderkey, l_linenumber, source)) AS v FROM claims WHERE day < DATE '1997-01-01' GROUP BY ALL),
n AS (SELECT code, field, arg_max(value, (day, l_orderkey, l_linenumber, source)) AS v FROM claims WHERE code % 11 > 0 GROUP BY ALL)
SELECT o.code || ':' || o.field AS subject, CASE WHEN n.v IS NULL THEN 'superseded' WHEN n.v = o.v THEN 'open' ELSE 'stale' END AS status FROM o LEFT JOIN n USING (code, field)""")
def review_cases(spark, d):
    c = claims(spark, d).withColumn("subject", F.concat_ws(":", F.col("code").cast("string"), "field"))
    shown = lambda rows: rows.groupBy("subject").agg(F.max_by("value", F.struct(*ORDER, "source")).alias("v")).select("subject", stewardship.digest(F.col("v")).alias("digest"))
    return stewardship.cases(shown(c.where("day < DATE '1997-01-01'")), shown(c.where("code % 11 > 0")))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN 'unknown' WHEN c_custkey % 4 = 1 THEN 'merged' WHEN c_acctbal < 0 THEN 'withdrawn' ELSE 'active' END AS status,
CASE WHEN c_custkey % 10 > 0 THEN CASE WHEN c_custkey % 4 = 1 THEN c_custkey - 1 ELSE c_custkey END END AS canonical FROM customer""")
def identity_status(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    merges = c.where("key % 4 = 1").select("key", (F.col("key") - 1).alias("survivor"))
    return stewardship.status(c.select("key", (F.col("key") % 10 > 0).alias("minted")), merges, c.where("c_acctbal < 0"))


@query("WITH " + RANKED + """, s AS (SELECT source, count(*) AS claims, count(*) FILTER (rank = 2147483647) AS unranked, count(DISTINCT code) AS items FROM ranked GROUP BY source)
SELECT source, claims, unranked, items, (100 * unranked // claims)::BIGINT AS unranked_percent FROM s""")
def quality_rollup(spark, d):
    r = survivorship.ranked(current(spark, d), priority(spark, d))
    s = r.groupBy("source").agg(F.count("*").alias("claims"), F.count_if(F.col("rank") == survivorship.UNRANKED).alias("unranked"), F.countDistinct("code").alias("items"))
    return s.withColumn("unranked_percent", F.floor(F.col("unranked") * 100 / F.col("claims")).cast("bigint"))


def trade_lines(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each part as a catalogue record with an ISBN-10, and every third as a feed's item with that book's ISBN-13 and its neighbour's."""
    def ten(k):
        body = F.lpad((k * 37).cast("string"), 9, "0")
        digit = (11 - codes.weighted_sum(body, 9, lambda x, i: x * (11 - i)) % 11) % 11
        return F.concat_ws("-", F.substring(body, 1, 1), F.substring(body, 2, 8), F.when(digit == 10, "X").otherwise(digit.cast("string")))

    k, part = F.col("p_partkey"), table(spark, d, "part")
    record = F.format_string('{"id":%d,"isbn":"%s","title":"%s","pages":%d,"binding":null}', k, ten(k), F.col("p_name"), F.col("p_size"))
    item = F.format_string('{"sku":"BW-%d","isbns":["%s","%s"],"pages":"%d","imprint":"%s"}', k, codes.isbn13(ten(k)), codes.isbn13(ten(k + 1)), F.col("p_size"), F.col("p_brand"))
    return part.select(record.alias("line")), part.where("p_partkey % 3 = 0").select(item.alias("line"))


@query("""WITH n AS (SELECT *, unnest([p_partkey, p_partkey + 1]) AS k FROM part), b AS (SELECT *, '978' || lpad((k * 37)::VARCHAR, 9, '0') AS v FROM n),
c AS (SELECT *, 'isbn13:' || v || (10 - list_sum(list_transform(range(1, 13), lambda i: substr(v, i::INT, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10)::BIGINT % 10 AS code FROM b),
p AS (SELECT p_partkey, p_name, p_size, p_brand, arg_min(code, k) AS one, arg_max(code, k) AS two FROM c GROUP BY ALL)
-- Fixed values: the names of the two sources.
SELECT 'identity' AS kind, 'librex' AS source, 'librex-' || p_partkey AS ref, one AS code, NULL::BIGINT AS product, NULL AS field, NULL AS value FROM p
UNION ALL SELECT 'grouping', 'librex', 'librex-' || p_partkey, one, p_partkey, NULL, NULL FROM p
UNION ALL SELECT 'attribute', 'librex', 'librex-' || p_partkey, one, NULL, 'title', 's:' || p_name FROM p
UNION ALL SELECT 'attribute', 'librex', 'librex-' || p_partkey, one, NULL, 'pages', 'i:' || p_size FROM p
UNION ALL SELECT 'identity', 'bookwire', 'BW-' || p_partkey, one || ',' || two, NULL, NULL, NULL FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT 'attribute', 'bookwire', 'BW-' || p_partkey, one, NULL, 'pages', 's:' || p_size FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT 'attribute', 'bookwire', 'BW-' || p_partkey, one, NULL, 'imprint', 's:' || p_brand FROM p WHERE p_partkey % 3 = 0""")
def trade_claims(spark, d):
    catalogue, items = trade_lines(spark, d)
    both = trade.claims(catalogue, trade.CATALOGUE).union(trade.claims(items, trade.ITEMS))
    value = F.when(F.col("value").isNotNull(), F.concat_ws(":", "value.t", "value.s"))
    return both.select("kind", "source", "ref", F.coalesce("code", F.array_join("codes", ",")).alias("code"), "product", "field", value.alias("value"))


def revision_requests(spark, d) -> DataFrame:
    """A customer is a record and each order a request: some name a wrong base, some are sent twice, some again with other content."""
    k = F.col("o_orderkey")
    before = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("valid_from"), (k % 7 == 0).alias("bad"))
    o = o.withColumn("m", F.count_if(~F.col("bad")).over(before))
    o = o.withColumn("base", F.when(F.col("bad"), "no such").otherwise(F.last(F.when(~F.col("bad"), k.cast("string")), ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1))))
    o = o.withColumn("copy", F.explode(F.when(~F.col("bad") & (k % 11 < 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    m = F.col("m")
    operation = F.when(m <= 1, "replace").when(m % 5 == 0, "withdraw").when(m % 5 == 1, "reactivate").otherwise("patch")
    other = F.when((F.col("copy") == 1) & (k % 11 == 1), "other").otherwise("value")
    claim = lambda slot, kind, codes, value: F.struct(slot.alias("slot"), F.lit(kind).alias("kind"), codes.alias("codes"), value.alias("value"))
    none = F.lit(None).cast("array<string>")
    own = F.array(claim(F.concat(F.lit("a"), (m % 3).cast("string")), "attribute", none, other))
    whole = F.concat(F.array(claim(F.lit("identity"), "identity", F.array(F.lit("cnk:1")), F.lit(None).cast("string"))), own)
    claims = F.when(operation == "withdraw", F.array().cast(f"array<{records.CLAIM}>")).when(operation == "patch", own).otherwise(whole)
    late = F.when((operation == "withdraw") & (other == "other"), F.date_add("valid_from", 1))
    return o.select(F.lit("shop").alias("source"), F.col("o_custkey").cast("string").alias("ref"), (k * 2 + F.col("copy")).alias("seq"), operation.alias("operation"), k.cast("string").alias("revision"),
                    F.col("base").alias("base_revision"), "valid_from", late.alias("valid_to"), claims.alias("claims"), F.array().cast("array<string>").alias("removed"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 = 0 AS bad, count(*) FILTER (o_orderkey % 7 > 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders),
c AS (SELECT *, unnest(CASE WHEN NOT bad AND o_orderkey % 11 < 2 THEN [0, 1] ELSE [0] END) AS copy FROM o)
SELECT o_custkey::VARCHAR AS ref, o_orderkey * 2 + copy AS seq, CASE WHEN bad THEN 412 WHEN copy = 1 AND o_orderkey % 11 = 1 THEN 409 ELSE 200 END::INT AS status,
CASE WHEN bad OR (copy = 1 AND o_orderkey % 11 = 1) THEN 'refused' WHEN copy = 1 THEN 'replay' ELSE 'revised' END AS outcome, m % 5 > 0 AS active,
CASE WHEN m = 0 THEN 0 WHEN m % 5 = 0 THEN 4 ELSE least(1 + m % 5, 4) END::INT AS slots FROM c""")
def source_record_gates(spark, d):
    return records.revise(revision_requests(spark, d)).select("ref", "seq", "status", "outcome", "active", F.size("slots").alias("slots"))


MERGED = """v AS (SELECT o_custkey // 5 AS subject FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderkey % 40) >= 28),
k AS (SELECT DISTINCT c_custkey // 5 AS subject, 'SK_' || c_custkey AS key FROM customer),
g AS (SELECT subject, key, min(key) OVER (PARTITION BY subject) AS survivor FROM k WHERE subject IN (SELECT subject FROM v)),
m AS (SELECT DISTINCT 'SK_' || o_custkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN 'cnk' ELSE 'gtin' END AS scheme, o_orderkey % 97 AS code FROM orders)"""


def merges_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """Neighbouring customers are proposed as one, and endorsed by the people who took their orders, of whom many are needed. Also the customers' codes."""
    orders = table(spark, d, "orders")
    fifth = lambda c: F.floor(F.col(c) / 5)
    proposals = table(spark, d, "customer").select(fifth("c_custkey").alias("subject"), F.concat(F.lit("SK_"), "c_custkey").alias("key"))
    votes = orders.select(fifth("o_custkey").alias("subject"), (F.col("o_orderkey") % 40).alias("actor"))
    scheme = F.when(F.col("o_orderkey") % 3 > 0, "cnk").otherwise("gtin")
    members = orders.select(F.concat(F.lit("SK_"), "o_custkey").alias("key"), scheme.alias("scheme"), (F.col("o_orderkey") % 97).alias("code")).distinct()
    return stewardship.approved_merges(proposals, votes, needed=28), members


@query(f"WITH {MERGED} SELECT subject, key, survivor FROM g")
def merge_approvals(spark, d):
    return merges_of(spark, d)[0].select("subject", "key", "survivor")


@query(f"WITH {MERGED} SELECT coalesce(survivor, key) AS key, scheme, code FROM m LEFT JOIN g USING (key) GROUP BY ALL")
def merge_members(spark, d):
    merges, members = merges_of(spark, d)
    return stewardship.members_after(members, merges)


@query(f"""WITH {MERGED}, r AS (SELECT subject, scheme, key, code FROM m JOIN g USING (key) WHERE scheme = 'cnk'),
x AS (SELECT DISTINCT a.subject, a.scheme FROM r a JOIN r b ON a.subject = b.subject AND a.scheme = b.scheme AND a.key <> b.key AND a.code <> b.code)
SELECT subject, scheme, key, code FROM r SEMI JOIN x USING (subject, scheme)""")
def merge_same_evidence(spark, d):
    merges, members = merges_of(spark, d)
    return stewardship.same_evidence(members, merges)
