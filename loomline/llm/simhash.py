"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints with at most 3 of 64 bits apart agree in one of four 16-bit blocks, so each distinct fingerprint goes to four groups.
In a group, the sorted fingerprints are a binary trie of index ranges; pairs of nodes are traversed together, one bit a level, and
dropped once their differing bits exceed the budget. A group hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, columns_of, give_back, map_batches, materialize, rows_of

SHINGLE, SEED, BUDGET, BLOCKS = 3, 42, 3, 4
#: Rows of one side of a join task; larger groups are cut into slices, and each pair of slices is a task.
SLICE = 4096
#: Rows joined at once, node pairs traversed at once, pairs that make a leaf, and pairs of leaves compared at once.
ROWS, PAIRS, LEAF, COMPARED = 1 << 17, 1 << 16, 32, 1 << 19


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()  # of bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed integer) for each row. Null and empty texts, and texts of white space, have 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or "") for _, t in rows_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], schema=schema)
        give_back()

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, fp bigint")


class Forest:
    """Connected rows by minimum label, a vector of pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while True:
            q = self.parent[p]
            if np.array_equal(p, q):
                return p
            p = q

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            on = a != b
            a, b = a[on], b[on]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def trie_forest(key: np.ndarray, side: np.ndarray, fp: np.ndarray, budget: int = BUDGET, leaf_pairs: int = LEAF, forest: Forest | None = None, match=None) -> np.ndarray:
    """For rows sorted by (key, side, fp): the first row each is connected to by links within ``budget`` bits. Where a key has two sides,
    links run from side to side; where it has one, within it. ``match(a, b)`` tells which pairs within the budget are links, if not all;
    ``forest`` holds links known before."""
    n = len(key)
    forest = forest or Forest(n)
    change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[change[1:], n]
    paired = np.r_[key[change[1:]] == key[change[:-1]], False]  # this run and the next have one key
    second = np.r_[False, paired[:-1]]
    own = ~paired & ~second & (ends - change > 1)
    lo = np.r_[change[own], change[paired]]
    hi = np.r_[ends[own], ends[paired]]
    lo2 = np.r_[change[own], change[second]]
    hi2 = np.r_[ends[own], ends[second]]
    above: dict[int, np.ndarray] = {}

    def split(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if level not in above:
            above[level] = np.r_[0, np.cumsum((fp >> np.uint64(level)) & np.uint64(1), dtype=np.int32)]
        return b - (above[level][b] - above[level][a])

    def compare(lo, hi, lo2, hi2) -> None:
        w = hi2 - lo2
        size = (hi - lo) * w
        if len(size) > 1 and size.sum() > COMPARED:
            half = len(size) // 2
            compare(lo[:half], hi[:half], lo2[:half], hi2[:half])
            compare(lo[half:], hi[half:], lo2[half:], hi2[half:])
            return
        at = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        a, b = lo[at] + k // w[at], lo2[at] + k % w[at]
        on = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= budget)
        a, b = a[on], b[on]
        forest.link(*(match(a, b) if match else (a, b)))

    stack = [(63, lo, hi, lo2, hi2, np.zeros(len(lo), np.int8))]
    while stack:
        level, *node = stack.pop()
        if len(node[0]) > PAIRS:
            half = len(node[0]) // 2
            stack += [(level, *[x[half:] for x in node]), (level, *[x[:half] for x in node])]
            continue
        lo, hi, lo2, hi2, errors = node
        leaf = (hi - lo) * (hi2 - lo2) <= leaf_pairs if level >= 0 else np.ones(len(lo), bool)
        compare(lo[leaf], hi[leaf], lo2[leaf], hi2[leaf])
        if leaf.all():
            continue
        lo, hi, lo2, hi2, errors = (x[~leaf] for x in (lo, hi, lo2, hi2, errors))
        mid, mid2 = split(level, lo, hi), split(level, lo2, hi2)
        same = lo == lo2
        parts = (
            (lo, mid, lo2, mid2, errors, ~same | (mid - lo > 1)),
            (mid, hi, mid2, hi2, errors, ~same | (hi - mid > 1)),
            (lo, mid, mid2, hi2, errors + 1, errors < budget),
            (mid, hi, lo2, mid2, errors + 1, ~same & (errors < budget)),
        )
        on = [p[5] & (p[1] > p[0]) & (p[3] > p[2]) for p in parts]
        stack.append((level - 1, *(np.concatenate([p[k][o] for p, o in zip(parts, on, strict=True)]) for k in range(5))))
    return forest.roots(np.arange(n))


def sliced(rows: DataFrame, group: str = "group") -> DataFrame:
    """``rows`` dealt to join tasks, with columns key and side: a group of over SLICE rows is cut into slices by the column node, and each
    pair of slices is a task. A key has 20 bits for each slice."""
    large = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > SLICE)
    slices = F.coalesce(F.ceil(F.col("n") / SLICE).cast("bigint"), F.lit(1).cast("bigint"))
    cut = rows.join(large, group, "left").withColumn("slices", slices).withColumn("side", F.pmod(F.xxhash64("node"), F.col("slices")))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    first, last = F.least("side", "other"), F.greatest("side", "other")
    key = F.when(F.col("slices") == 1, F.xxhash64(group)).otherwise(F.xxhash64(group, first, last))
    return dealt.withColumn("key", key).drop(group, "n", "slices", "other")


def in_tasks(tasks: DataFrame, columns: list[str], join: Callable[..., Iterator[pa.RecordBatch]], names: str) -> DataFrame:
    """join(key, side, *columns) over whole keys, about ROWS rows at a time, as numpy arrays (binary columns as matrices of 64 bits)."""

    def array(column: pa.Array) -> np.ndarray:
        if pa.types.is_binary(column.type):
            return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
        return column.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([array(c) for c in b.columns])
            size += b.num_rows
            if size >= ROWS:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.searchsorted(whole[0], whole[0][-1])  # the last key may go on
                if last:
                    yield from join(*[x[:last] for x in whole])
                held, size = [[x[last:] for x in whole]], size - last
        if size:
            yield from join(*[np.concatenate(x) for x in zip(*held, strict=True)])
        del held
        give_back()

    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.select("key", "side", *columns).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, names)


def links(fps: DataFrame) -> DataFrame:
    """a, b: a spanning forest, for each join task, of the links between distinct fingerprints (a column node)."""
    blocks = F.explode(F.array(*[F.lit(i << 16).cast("bigint").bitwiseOR(F.shiftrightunsigned("node", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint"))) for i in range(BLOCKS)]))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(key: np.ndarray, side: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = node.view(np.uint64)
        order = np.lexsort((fp, side, key))
        key, side, fp, node = key[order], side[order], fp[order], node[order]
        root = trie_forest(key, side, fp)
        on = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[root[on]])], schema=schema)

    return in_tasks(sliced(fps.select("node", blocks.alias("group"))), ["node"], join, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for each node of the edges (a, b), by hooking to the smallest neighbour's label and
    pointer jumping. Each round is written to the shared folder; only a count comes to the driver."""
    both = materialize(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialize(hooked.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach) for each row.

    Rows of one fingerprint are one class; a class is linked to those at most BUDGET bits away, whether its rows have ids or not. Null and
    empty texts have fingerprint zero and link as others do; repeated rows stay; a null doc_id names no component, unless no row reached
    has an id: then component_id is null. A very long text is fingerprinted whole. Other columns, whatever their names, are left out. An
    empty table gives none.
    """
    fps = materialize(fingerprints(docs))
    classes = materialize(fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("rep")))
    labels = components(links(classes.select("node")))
    labelled = materialize(classes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = materialize(labelled.join(least, "label").select(F.col("node").alias("fp"), "component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(rows: DataFrame, component: DataFrame) -> DataFrame:
    """The rows (row, doc) that come first in their component (row, component_id), by doc_id, null last, and row: one of each."""
    ids = rows.select("row", F.col("doc.doc_id").alias("id")).join(component, "row")
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")).select("m.row")
    gone = materialize(component.select("row").join(kept, "row", "left_anti"))
    return chosen(rows, gone, "left_anti").select("doc.*")


def numbered(docs: DataFrame) -> DataFrame:
    """row (unique), doc (all columns of ``docs``, whatever their names), written to the shared folder."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns_of(docs)).alias("doc")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with its columns: the least doc_id, null last. Each row counts by itself, whatever its id, so
    rows that repeat an id and rows without one are copies as others are; null and empty texts are one component. An empty table gives none."""
    rows = numbered(docs)
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    return first_of_each(rows, found.select(F.col("doc_id").alias("row"), "component_id"))
