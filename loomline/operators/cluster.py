"""Clusters of listings: connected components, and the guard that refuses unsafe bridges within them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.codes import BARCODE, NATIONAL
from loomline.session import folded, stored


#: A component that has something to refuse is folded in one task up to so many distinct sets, and scheme by scheme beyond.
LARGE = 20_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of edges(a, b). Hooking and pointer jumping; each round is written to the shared
    folder and only an emptiness test reaches the driver."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = stored(hooked.join(jump, "component").select("node", "old", F.least("component", "far").alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _distinct_values(codes: set, allowed: set, unique: tuple) -> bool:
    """Whether one national scheme has two values that nothing says are one."""
    by: dict = {}
    for scheme, value in codes:
        if scheme in unique:
            by.setdefault(scheme, []).append((scheme, value))
    return any(tuple(p) not in allowed for own in by.values() for p in combinations(sorted(own), 2))


def guard(sets: list[list[tuple]], shared: set, allowed: set, distinct: set, same: set, unique: tuple = NATIONAL, barcode: tuple = BARCODE) -> list[list[tuple]]:
    """Union-find over distinct code sets in the order of their edges (kind, code, left, right). An edge is refused if the union holds a
    pair marked distinct, or (unless marked same) two values of a national scheme, or if a barcode alone would join two sets that
    each have another kind of code."""
    sets = sorted({tuple(sorted(s)) for s in sets})
    parent, codes = list(range(len(sets))), [set(s) for s in sets]
    national = [{c for c in s if c[0] in unique} for s in sets]
    stands = [any(c[0] not in barcode for c in s) for s in sets]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    holders: dict = {}
    for k, s in enumerate(sets):
        for c in s:
            holders.setdefault(c, []).append(k)
    mark = {k: ([c for c in s if c[0] in unique], s) for k, s in enumerate(sets)}
    edges, fine = [], allowed | same
    for code, own in holders.items():
        if code not in shared:
            line = sorted(own, key=lambda k: mark[k])
            edges += [(0, (code,), a, b) for a, b in zip(line, line[1:], strict=False)]
    for left, right in same:
        edges += [(1, (left, right), a, b) for a in holders.get(left, []) for b in holders.get(right, []) if a != b]
    for kind, bridge, a, b in sorted(edges):
        a, b = root(a), root(b)
        if a == b:
            continue
        refused = any((x in codes[a] or x in codes[b]) and (y in codes[a] or y in codes[b]) for x, y in distinct)
        if not kind:
            refused = refused or _distinct_values(national[a] | national[b], fine, unique) or bridge[0][0] in barcode and stands[a] and stands[b]
        if not refused:
            low, high = min(a, b), max(a, b)
            parent[high], stands[low] = low, stands[a] or stands[b]
            for own in (codes, national):  # the smaller set moves: copying the larger each time grows with its square
                if len(own[low]) < len(own[high]):
                    own[low], own[high] = own[high], own[low]
                own[low] |= own[high]
                own[high] = set()
    return sorted(sorted(codes[k]) for k in {root(k) for k in range(len(sets))})


def hung(links: DataFrame) -> DataFrame:
    """node, component (one node of it) of links(a, b): each a hangs on its least b and only the b's are left for components(), so stars
    cost one pass however large they are."""
    tied = stored(links.select("a", "b", F.min("b").over(W.partitionBy("a")).alias("top")))
    tops, own = stored(tied.select(F.col("b").alias("node")).distinct()), tied.select(F.col("a").alias("node"), "top").distinct()
    both = own.join(tops, "node", "left_semi").select(F.col("node").alias("a"), F.col("top").alias("b"))
    core = stored(components(tied.where("b <> top").select(F.col("b").alias("a"), F.col("top").alias("b")).union(both).distinct()))
    above = own.join(tops, "node", "left_anti").union(tops.select("node", F.col("node").alias("top")))
    return above.join(core.withColumnRenamed("node", "top"), "top", "left").select("node", F.coalesce("component", "top").alias("component"))


def pairs(codes: str):
    """Codes (scheme, value) of codes (scheme, value, never)."""
    return F.transform(codes, lambda c: F.struct(c["scheme"].alias("scheme"), c["value"].alias("value")))


def ungated(placed: DataFrame) -> DataFrame:
    """component: those in which the guard has nothing to refuse, whatever the order of edges. No national scheme has two values, and
    either one distinct set at most has other codes than barcodes, or no barcode is in two sets. From (component, codes), a row a set."""
    codes = placed.select("component", F.explode("codes").alias("c")).select("component", "c.scheme", "c.value")
    contested = stored(codes.where(F.col("scheme").isin(*NATIONAL)).distinct().groupBy("component", "scheme").agg(F.count("value").alias("n")).where("n > 1").select("component").distinct())
    stands = F.exists("codes", lambda c: ~c["scheme"].isin(*BARCODE))
    standing = placed.where(stands).groupBy("component").count().where("count > 1").join(contested, "component", "left_anti").select("component")
    met = codes.where(F.col("scheme").isin(*BARCODE)).join(standing, "component", "left_semi").groupBy("component", "scheme", "value").count().where("count > 1")
    held = contested.union(met.select("component").distinct())
    return placed.select("component").distinct().join(held, "component", "left_anti")


def contracted(placed: DataFrame, allowed: DataFrame) -> DataFrame:
    """component, cluster, lane, scheme, value of guard() over components of any size, from (component, lane, codes), a row a set, and the
    allowed pairs (scheme, left, right); clusters are numbered by their least sets.

    The guard takes edges scheme by scheme, and what it refuses within one it refuses ever after: clusters only gain values, and stand
    once they stand. So sets are contracted a scheme at a time: of two clusters only the first edge counts, edges whose ends conflict
    at the start are gone, and of what still hangs together only parts in which something may yet be refused are folded in a task.
    Sets are numbered in the order of their codes, and a cluster has the number of its least set.
    """
    national = F.filter(pairs("codes"), lambda c: c["scheme"].isin(*NATIONAL)).alias("national")
    stands = F.exists("codes", lambda c: ~c["scheme"].isin(*BARCODE)).alias("stands")
    state = stored(placed.orderBy("codes").select(F.monotonically_increasing_id().alias("set"), "component", "lane", "codes", national, stands))
    state, grown = state.select("*", F.col("set").alias("node"), F.lit(False).alias("merged")), None
    schemes = state.select(F.explode("codes").alias("c")).where("NOT c.never").select("c.scheme").distinct()
    for scheme in sorted(r[0] for r in schemes.collect()):
        of = F.filter("codes", lambda c: (c["scheme"] == scheme) & ~c["never"])["value"]  # noqa: B023
        held = state.select("set", "lane", "node", "national", "stands", (~F.col("merged") & (F.size(of) == 1)).alias("private"), F.explode(of).alias("value"))
        held = held.join(grown, "node", "left") if grown is not None else held.withColumns({"values": F.lit(None).cast(held.schema["national"].dataType), "stand": F.lit(None).cast("boolean")})
        held = held.select("set", "lane", "value", "node", "national", "private", F.coalesce("values", "national").alias("values"), F.coalesce("stand", "stands").alias("stand"))
        by = W.partitionBy("lane", "value").orderBy("national", "set")
        last = lambda c, to: F.last(c, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, to))  # noqa: B023, E731
        # A set in one line only, without values of its own, is never refused by the one before it: it hangs there from the start.
        line = held.select("*", F.lag("set").over(by).alias("p_set"), F.lag("values").over(by).alias("p_values"))
        hangs = F.col("private") & F.col("p_set").isNotNull() & (F.size(F.array_except("values", "p_values")) == 0)
        line = line.withColumn("hangs", F.coalesce(hangs & ~F.col("stand") if scheme in BARCODE else hangs, F.lit(False)))
        line = line.withColumn("p", last(F.when(~F.col("hangs"), F.struct("node", "values", "stand")), -1))
        never = (F.col("stand") & F.col("p.stand")) if scheme in BARCODE else F.lit(False)
        differ = F.exists("values", lambda x: F.exists("p.values", lambda y: (x["scheme"] == y["scheme"]) & (x["value"] != y["value"])))
        line = line.select("value", "node", "hangs", F.col("p.node").alias("p_node"), "p_set", F.coalesce(never, F.lit(False)).alias("never"), F.coalesce(~F.col("hangs") & differ, F.lit(False)).alias("differ"), "lane", "national", "set")
        # Between two refusals a line hangs together: on the node it begins with.
        head = last(F.when(~F.col("hangs") & (F.col("p_set").isNull() | F.col("never") | F.col("differ")), F.col("node")), 0)
        step = stored(line.select("value", "node", "hangs", "p_node", "p_set", "never", "differ", head.alias("head")).where("hangs OR node <> head OR p_node <> node AND NOT never"))
        hangs = step.where("hangs").select("node", F.col("p_node").alias("top"))
        edges = step.where("NOT hangs AND p_node <> node AND NOT never").select(F.least("node", "p_node").alias("x"), F.greatest("node", "p_node").alias("y"), "value", "p_set", "differ")
        # The first edge of two clusters is decided by what they hold, so one conflict refuses them all.
        unlike = stored(edges.where("differ").select("x", "y").distinct())
        tied, bad = step.where("NOT hangs AND node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), None
        if not unlike.isEmpty():
            ends = stored(unlike.select(F.col("x").alias("node")).union(unlike.select("y")).distinct())
            values = stored(state.join(ends, "node", "left_semi").select("node", F.explode("national").alias("v")).select("node", "v.scheme", "v.value").distinct())
            side = lambda n, c: values.select(F.col("node").alias(n), "scheme", F.col("value").alias(c))  # noqa: B023, E731
            cross = unlike.join(side("x", "l"), "x").join(side("y", "r"), ["y", "scheme"]).where("l <> r")
            bad = stored(cross.select("x", "y", "scheme", F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right")).join(allowed, ["scheme", "left", "right"], "left_anti").select("x", "y").distinct())
            tied = tied.union(unlike.join(bad, ["x", "y"], "left_anti").select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
        tree = stored(hung(tied).withColumnRenamed("component", "top"))
        own = stored(state.join(tree, "node").select("top", "node", F.explode_outer("national").alias("v"), "stands").distinct())
        # One node's own values are never refused, so that nothing is in a part which has no others.
        known = own.where("v IS NOT NULL").select("top", "node", "v.scheme", "v.value").distinct()
        most = known.groupBy("top", "node", "scheme").count().groupBy("top", "scheme").agg(F.max("count").alias("most"))
        many = known.select("top", "scheme", "value").distinct().groupBy("top", "scheme").count().join(most, ["top", "scheme"]).where("count > most").select("top")
        if scheme in BARCODE:
            many = many.union(own.where("stands").select("top", "node").distinct().groupBy("top").count().where("count > 1").select("top"))
        contested = stored(many.distinct())
        if not contested.isEmpty():
            hard = stored(own.join(contested, "top", "left_semi").groupBy("top", "node").agg(F.collect_set("v").alias("national"), F.max("stands").alias("stands")))
            side = lambda n: known.join(contested, "top", "left_semi").select("top", "scheme", F.col("value").alias(n)).distinct()  # noqa: B023, E731
            fine = side("left").join(side("right"), ["top", "scheme"]).join(allowed, ["scheme", "left", "right"], "left_semi").select("top", "scheme", "left", "right")
            met = edges.join(hard.select("top", F.col("node").alias("x")), "x").groupBy("top", "x", "y").agg(F.min(F.struct("value", "p_set")).alias("place"))
            met = met if bad is None else met.join(bad, ["x", "y"], "left_anti")
            rows = hard.unionByName(met, allowMissingColumns=True).unionByName(fine, allowMissingColumns=True)
            new = stored(folded(rows.select("top", "node", "national", "stands", "x", "y", "place", "scheme", "left", "right"), "top", _merge(scheme in BARCODE), "node long, new long"))
            tree = stored(tree.join(new, "node", "left").select("node", F.coalesce("new", "top").alias("top")))
        tops = stored(hangs.select(F.col("top").alias("node")).distinct().join(tree, "node", "left").select("node", F.coalesce("top", "node").alias("top")))
        moved = tree.union(tops.join(tree, "node", "left_anti")).union(hangs.join(tops.select(F.col("node").alias("top"), F.col("top").alias("far")), "top").select("node", "far"))
        least = stored(moved.groupBy("top").agg(F.min("node").alias("least")))
        state = state.join(moved.join(least, "top").select("node", "least"), "node", "left")
        state = stored(state.select("set", "component", "lane", "codes", "national", "stands", F.coalesce("least", "node").alias("node"), (F.col("merged") | F.col("least").isNotNull()).alias("merged")))
        merged = state.where("merged")
        held_values = merged.select("node", F.explode("national").alias("v")).distinct().groupBy("node").agg(F.array_sort(F.collect_set("v")).alias("values"))
        grown = stored(merged.groupBy("node").agg(F.max("stands").alias("stand")).join(held_values, "node", "left").select("node", F.coalesce("values", F.array().cast(state.schema["national"].dataType)).alias("values"), "stand"))
    numbers = state.select("component", "node").distinct().select("component", "node", (F.row_number().over(W.partitionBy("component").orderBy("node")) - 1).alias("cluster"))
    rows = state.select("component", "node", "lane", F.explode("codes").alias("c")).select("component", "node", "lane", "c.scheme", "c.value").distinct()
    return rows.join(stored(numbers).drop("component"), "node").select("component", "cluster", "lane", "scheme", "value")


def _merge(barcode: bool):
    """guard() over clusters and the edges of one scheme: (node, the least node of its cluster)."""

    def run(_, rows: list[tuple]) -> list[tuple]:
        codes, stands, edges, fine = {}, {}, [], set()
        for _, node, national, stand, x, y, place, scheme, left, right in rows:
            if node is not None:
                codes[node], stands[node] = {(c["scheme"], c["value"]) for c in national}, stand
            elif x is not None:
                edges.append((*place.values(), x, y))
            else:
                fine.add(((scheme, left), (scheme, right)))
        parent = {n: n for n in codes}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for *_, x, y in sorted(edges):
            low, high = sorted((root(x), root(y)))
            if low == high or barcode and stands[low] and stands[high] or _distinct_values(codes[low] | codes[high], fine, NATIONAL):
                continue
            parent[high], stands[low] = low, stands[low] or stands[high]
            codes[low] |= codes.pop(high)
        return [(n, root(n)) for n in parent]

    return run


def guarded(listings: DataFrame, shared: DataFrame | None = None, distinct: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """component, cluster (its number in its component), scheme, value from listings(listing, scheme, value and, where lanes are kept
    apart, lane); with lane where that is given.

    The guard only refuses edges, so its clusters lie within the components of the unguarded graph and each component is decided alone.
    A component in which nothing can be refused is one cluster without it, so a hub of any size stays in Spark's own joins; the others
    are folded one a task, in the order of their edges, over distinct sets, or contracted() where they are large. Pairs that one listing asserts together are gathered over
    all components first, as a shared code's pair may lie in another one. ``shared`` has scheme, value and may be as large as the
    listings; ``distinct`` and ``same`` have l_scheme, l_value, r_scheme, r_value and are bounded by stewards' work.
    """
    spark = listings.sparkSession
    lanes = "lane" in listings.columns
    rows = (listings if lanes else listings.withColumn("lane", F.lit(""))).select("lane", F.col("listing").cast("string").alias("listing"), "scheme", "value")
    never = F.lit(False)
    if shared is not None:
        rows = rows.join(shared.select("scheme", "value").distinct().withColumn("never", F.lit(True)), ["scheme", "value"], "left")
        never = F.coalesce("never", F.lit(False))
    # Listings of one set are one node, so that two that assert equal shared codes only are one set for the guard too.
    # One sort of the rows gives most sets, sixteen rows at a time; only listings of more rows are aggregated.
    by = W.partitionBy("lane", "listing").orderBy("listing")
    runs = rows.select("lane", "listing", F.struct("scheme", "value", never.alias("never")).alias("c")).select(
        "lane", "listing", F.row_number().over(by).alias("n"), F.count(F.lit(1)).over(W.partitionBy("lane", "listing")).alias("total"), F.collect_set("c").over(by.rowsBetween(0, 15)).alias("codes")
    )
    runs = stored(runs.where("n % 16 = 1").select("lane", F.when(F.col("total") > 16, F.struct("listing")).alias("of"), "codes"))
    many = runs.where("of IS NOT NULL").select("lane", "of", F.explode("codes").alias("c")).groupBy("lane", "of").agg(F.collect_set("c").alias("codes"))
    whole = runs.where("of IS NULL").select("lane", "codes").union(many.select("lane", "codes")).select("lane", F.sort_array("codes").alias("codes"))
    bridges = F.transform(F.filter("codes", lambda c: ~c["never"]), lambda c: F.concat(F.lit("c"), F.concat_ws("\x1f", "lane", c["scheme"], c["value"])))
    sets = stored(whole.select("lane", "codes").distinct().withColumn("nodes", F.sort_array(bridges)))
    ends = lambda df: {tuple(sorted([(r[0], r[1]), (r[2], r[3])])) for r in df.select("l_scheme", "l_value", "r_scheme", "r_value").distinct().collect()} if df is not None else set()
    apart, joined = ends(distinct), ends(same)
    if joined:
        named = spark.createDataFrame([(f"p{n}", *a) for n, p in enumerate(sorted(joined)) for a in p], "pair string, scheme string, value string")
        held = sets.select("lane", "codes", F.explode("codes").alias("c")).select("lane", "codes", "c.scheme", "c.value").join(F.broadcast(named), ["scheme", "value"])
        held = held.groupBy("lane", "codes").agg(F.collect_set("pair").alias("pairs"))
        sets = stored(sets.join(held, ["lane", "codes"], "left").select("lane", "codes", F.array_sort(F.concat("nodes", F.coalesce("pairs", F.array().cast("array<string>")))).alias("nodes")))
    # A set hangs its other codes on its least one, and itself on its last, which sets of a hub seldom share.
    found = hung(sets.where("size(nodes) > 1").select(F.explode(F.slice("nodes", 2, F.size("nodes"))).alias("a"), F.col("nodes")[0].alias("b")).distinct())
    said = F.transform("codes", lambda c: F.concat_ws("\x1f", c["scheme"], c["value"]))
    alone = F.concat(F.lit("s"), F.md5(F.concat_ws("\x1e", "lane", said)))
    sets = sets.select("lane", "codes", F.when(F.size("nodes") > 0, F.element_at("nodes", -1)).otherwise(alone).alias("node"))
    placed = stored(sets.join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), "lane", "codes"))
    # Pairs that one listing asserts together, of every component.
    national = F.filter(pairs("codes"), lambda c: c["scheme"].isin(*NATIONAL))
    many = placed.select(national.alias("own")).where("size(own) > size(array_distinct(own.scheme))").select(F.explode("own").alias("l"), "own").select("l", F.explode("own").alias("r"))
    allowed = stored(many.where("l.scheme = r.scheme AND l.value < r.value").select("l.scheme", F.col("l.value").alias("left"), F.col("r.value").alias("right")).distinct())
    easy = ungated(placed)
    if apart:
        named = spark.createDataFrame([c for p in apart for c in p], "scheme string, value string").distinct()
        easy = easy.join(placed.select("component", F.explode("codes").alias("c")).select("component", "c.scheme", "c.value").join(F.broadcast(named), ["scheme", "value"], "left_semi").select("component"), "component", "left_anti")
    easy = stored(easy)
    lane_of = ["lane"] if lanes else []
    plain = placed.join(easy, "component", "left_semi").select("component", "lane", F.explode("codes").alias("c")).select("component", F.lit(0).alias("cluster"), *lane_of, "c.scheme", "c.value").distinct()
    hard = placed.join(easy, "component", "left_anti")
    large = stored(hard.groupBy("component").count().where(F.col("count") > LARGE).select("component"))
    if not (apart or joined or large.isEmpty()):
        plain = plain.unionByName(contracted(hard.join(large, "component", "left_semi"), allowed).select("component", "cluster", *lane_of, "scheme", "value"))
        hard = hard.join(large, "component", "left_anti")
    hard = hard.select("component", F.monotonically_increasing_id().alias("set"), "lane", "codes")
    hard = stored(hard.select("component", "set", "lane", F.explode("codes").alias("c")).select("component", "set", "lane", "c.*"))
    side = lambda n: hard.where(F.col("scheme").isin(*NATIONAL)).select("component", "scheme", F.col("value").alias(n)).distinct()
    near = allowed.join(side("left"), ["scheme", "left"]).join(side("right"), ["component", "scheme", "right"]).select("component", "scheme", F.col("left").alias("value"), "right")

    def run(key: str, rows: list[tuple]) -> list[tuple]:
        sets, never, allow, lane = {}, set(), set(), ""
        for _, name, of, scheme, value, shut, right in rows:
            if name is None:
                allow.add(((scheme, value), (scheme, right)))
                continue
            lane = of
            sets.setdefault(name, []).append((scheme, value))
            if shut:
                never.add((scheme, value))
        return [(key, k, lane, s, v) for k, c in enumerate(guard(list(sets.values()), never, allow, apart, joined)) for s, v in c]

    rows = hard.select("component", "set", "lane", "scheme", "value", "never").unionByName(near, allowMissingColumns=True)
    found = folded(rows.select("component", "set", "lane", "scheme", "value", "never", "right"), "component", run, "component string, cluster int, lane string, scheme string, value string")
    return plain.unionByName(found.select("component", "cluster", *lane_of, "scheme", "value"))
