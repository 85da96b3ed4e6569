"""Improbable-feature digests.

Each window of 16 bytes of a text is ranked by how improbable its entropy is; windows that are the rarest of several neighbourhoods are
the features. Features go, in order, into a chain of Bloom filters; two chains are compared by the overlap of their bits beyond chance.
Texts of all lengths are digested alike; one shorter than a window is a window filled up with zero bytes, and an empty one has none.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, give_back, map_batches, rows_of

#: Bytes of a window (a power of two); windows of a neighbourhood (no more than bytes of a window); neighbourhoods that a feature must be
#: the rarest of.
WINDOW, NEAR, POPULAR = 16, 12, 4
#: Bits of a filter (a power of two), features in it, bits that a feature sets.
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Entropy, in thousandths of its most, that a window of plain text has on average and its spread; below LEAST a window only repeats.
TYPICAL, SPREAD, LEAST = 780, 67, 300
#: Bytes that are ranked in one buffer; it only bounds memory.
BUFFER = 1 << 18
#: Documents of a range aimed at, most ranges, and rows sampled for each range's end.
RANGE_DOCS, MAX_RANGES, SAMPLED = 4000, 1 << 16, 16

_UNIT, _BITS = 1 << 20, WINDOW.bit_length() - 1
_PHI = np.array([0] + [round(_UNIT * c * np.log2(c)) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.diff(_PHI)
_RARITY = np.array([1 << 20 if h < LEAST else 1 + int(100_000 * np.exp(-(((h - TYPICAL) / SPREAD) ** 2) / 2)) for h in range(1001)], np.int64)
_MIX = np.random.default_rng(7).integers(1, 2**63, (2, WINDOW // 8), np.uint64) | np.uint64(1)
_NOT = np.int64(1 << 62)


def entropies(b: np.ndarray) -> np.ndarray:
    """Entropy of each window of the bytes, in thousandths of the most it can be. A window's sum over byte counts c of c log c changes by
    one byte out and one in, whose counts are those of equal bytes among the next and the last of a window."""
    n = len(b)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = b[d:] == b[:-d]
        after[:-d] += same
        before[d:] += same
    into = _STEP[before]
    phi = np.empty(n - WINDOW + 1, np.int64)
    phi[0] = into[:WINDOW].sum()
    phi[1:] = into[WINDOW:] - _STEP[after[: n - WINDOW]]
    phi = np.cumsum(phi)
    return (1000 * (_BITS * WINDOW * _UNIT - phi)) // (_BITS * WINDOW * _UNIT)


def _hash(windows: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(windows).view(np.uint64)
    h = (x * _MIX[0]).sum(1, dtype=np.uint64) ^ ((x >> np.uint64(32)) * _MIX[1]).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _filters(hashes: np.ndarray) -> np.ndarray:
    """The chain: rows of packed bits. A feature that the chain has does not count again."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    bits = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), np.uint8)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def _ranked(raws: list[bytes]) -> list[np.ndarray]:
    """Chains of texts that are not empty, all ranked in one buffer. Windows that lie across two texts are never the rarest; there are
    NEAR - 1 of them at least between two texts, so a neighbourhood has windows of one text only."""
    raws = [r.ljust(WINDOW, b"\0") for r in raws]
    b = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    across = np.zeros(len(b) + 1, np.int8)
    across[ends[:-1] - (WINDOW - 1)] = 1
    across[ends[:-1]] -= 1
    n = len(b) - WINDOW + 1
    key = np.full(n + 2 * (NEAR - 1), _NOT)
    own = _RARITY[entropies(b)] << 32 | np.arange(n)  # ties: the leftmost
    key[NEAR - 1 : NEAR - 1 + n] = np.where(np.cumsum(across[:n], dtype=np.int8) > 0, _NOT, own)
    low, width = key, 1
    while width < NEAR:
        step = min(width, NEAR - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    votes = np.bincount(low[low < _NOT] & 0xFFFFFFFF, minlength=n)
    at = np.flatnonzero(votes >= POPULAR)
    hashes = _hash(np.lib.stride_tricks.sliding_window_view(b, WINDOW)[at])
    cut = np.searchsorted(at, np.r_[0, ends])
    return [_filters(hashes[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def chains(texts: list[str]) -> list[np.ndarray]:
    out = [np.zeros((0, FILTER_BITS // 8), np.uint8)] * len(texts)
    group, raws, size = [], [], 0
    for k, t in [*enumerate(texts), (None, "")]:
        raw = t.encode()
        if group and (k is None or size + len(raw) > BUFFER):
            for i, chain in zip(group, _ranked(raws), strict=True):
                out[i] = chain
            group, raws, size = [], [], 0
        if raw:
            group.append(k)
            raws.append(raw)
            size += len(raw)
    return out


def as_text(chain: np.ndarray) -> str:
    """The digest: number of filters, and their bits in base64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def from_text(digest: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(digest.partition(":")[2]), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Each filter of the chain with fewer bits takes its best match in the other: shared bits, less those that chance may give (2.5
    standard deviations), over the most there could be; filters weigh by their bits. Equal chains are alike, even empty ones; an empty one is unlike any other."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    a, b = a.view(np.uint64), b.view(np.uint64)
    ones_a, ones_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    if (ones_a.sum(), a.tobytes()) > (ones_b.sum(), b.tobytes()):
        a, b, ones_a, ones_b = b, a, ones_b, ones_a
    total = 0.0
    for row, n in zip(a, ones_a.tolist(), strict=True):
        shared = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        most = np.minimum(ones_b, n)
        floor = n * ones_b / FILTER_BITS
        floor = floor + np.minimum(2.5 * np.sqrt(floor * np.maximum(1 - ones_b / FILTER_BITS, 0)), (most - floor) / 2)
        total += n * float(np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return min(1.0, total / float(ones_a.sum()))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next document is the one of the next smaller doc_id, after the last the first; rows that repeat an id follow each other by the
    MD5 of their text, and null ids come last. Null texts are empty; an empty one has no features and is like another empty one only.
    The only row of a table follows itself. A very long text is digested whole. Other columns, whatever their names, are left out. An
    empty table gives none.

    Documents are dealt once, compressed, by ranges of (id, MD5) whose upper ends are sampled rows: the document at a range's end also
    goes to the next range, whose last document it follows, so no order over all rows and no second pass is needed, and neither null
    ids nor one that many rows repeat make a large range. The driver holds at most SAMPLED * MAX_RANGES keys.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    rows = ids.count()
    parts = min(MAX_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_DOCS))
    share = min(1.0, SAMPLED * parts / max(rows, 1))
    sampled = sorted(tuple(r[0]) for r in (ids.sample(share, 7) if share < 1 else ids).select(place).collect())
    last = ids.agg(F.max(place)).first()[0]
    ends = sorted({*sampled[SAMPLED - 1 :: SAMPLED], *([tuple(last)] if last else [])}) or [(False, 0, "")]

    dealt = pa.schema([("part", pa.int32()), ("extra", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.string()), ("text", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1).compress
        for b in batches:
            out = []
            for i, t in rows_of(b):
                raw = (t or "").encode()
                own = (i is not None, i or 0, hashlib.md5(raw).hexdigest())
                packed, k = press(raw), bisect_left(ends, own)
                out.append((k, False, i, own[2], packed))
                if ends[k] == own:
                    out.append(((k + 1) % len(ends), True, i, own[2], packed))
            yield batch_of(out, dealt)
        give_back()

    names = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        size = 0

        def finish() -> pa.RecordBatch:
            """For all but the last row held, which the next follows."""
            own = chains([t for _, _, t in held])
            pairs = [(k, edited(held[k][2], held[k + 1][2])) for k in range(len(held) - 1) if not held[k][0]]
            out = []
            for (k, text), chain in zip(pairs, chains([t for _, t in pairs]), strict=True):
                out.append((held[k][1], len(held[k][2]), hashlib.sha256(text.encode()).hexdigest(), as_text(own[k]), as_text(chain), likeness(own[k], chain), likeness(own[k], own[k + 1])))
            return batch_of(out, schema)

        part = None
        for b in batches:
            for p, extra, i, _, packed in rows_of(b):
                if p != part or size > 1 << 20:
                    if len(held) > 1:
                        yield finish()
                    held, size = held[-1:] if p == part else [], 0
                    part = p
                text = press(packed).decode()
                held.append((extra, i, text))
                size += len(text)
        if len(held) > 1:
            yield finish()
        held.clear()
        give_back()

    spread = map_batches(ids, deal, "part int, extra boolean, doc_id bigint, tie string, text binary")
    order = ["part", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    return map_batches(spread.repartition(min(parts, len(ends)), "part").sortWithinPartitions(*order), run, names)
