"""Byte-level BPE encoding and decoding by ranked merges.

The rows of a task are gathered into blocks of bounded text and cut into distinct words; ranked merges run over each distinct
word of a block once; the ids go back to the texts. There is no shuffle. Decoding concatenates the pieces of the ids in Spark's own
functions. fold_words() is the same fold of merges in higher-order functions over a literal rank map; interpreted, it takes several times
the CPU seconds that a GB may take.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, rows_of

#: Fixed value: the rank that stands for "these two pieces do not merge".
NONE = 2**31 - 1
#: Sizes of the two halves of the rank table (primes), and bits of a rank in an entry.
HALF, OTHER, RANK_BITS = 402653, 389171, 17
#: Words of more bytes are merged with a heap, as a fold takes time with the square of a word's length.
FOLD_BYTES = 48
BLOCK_BYTES = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(left id, right id) -> rank of the joined bytes as a cuckoo table: an entry is key << 17 | rank, at key % HALF or HALF + key % OTHER."""
    table = np.full(HALF + OTHER, -1, np.int64)
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is None or b is None:
                continue
            entry = (a << 16 | b) << RANK_BITS | rank
            at = (entry >> RANK_BITS) % HALF
            for _ in range(500):
                entry, table[at] = int(table[at]), entry
                if entry < 0:
                    break
                key = entry >> RANK_BITS
                at = HALF + key % OTHER if at < HALF else key % HALF
            else:
                raise ValueError("the rank table is too small for these ranks")
    return table


def merge_with_heap(pieces: list[int], table: np.ndarray) -> list[int]:
    """The same merges, lowest rank and then leftmost first, in time n log n: for words too long to fold."""

    def rank(a: int, b: int) -> int:
        key = a << 16 | b
        for e in (int(table[key % HALF]), int(table[HALF + key % OTHER])):
            if e >> RANK_BITS == key:
                return e & ((1 << RANK_BITS) - 1)
        return NONE

    ids, n = list(pieces), len(pieces)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) != NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = r, False, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (x := rank(r, ids[after[j]])) != NONE:
                heapq.heappush(heap, (x, i, r, ids[after[j]]))
        if before[i] >= 0 and (x := rank(ids[before[i]], r)) != NONE:
            heapq.heappush(heap, (x, before[i], ids[before[i]], r))
    return [x for x, on in zip(ids, alive, strict=True) if on]


def fold_merges(word: Column, ranks: Column) -> Column:
    """The ids of a word (array<int>, two pieces or more): each step of the fold merges the leftmost pair of lowest rank."""

    def rank(a: Column, b: Column) -> Column:
        key = F.shiftleft(a.cast("bigint"), 16).bitwiseOR(b.cast("bigint"))
        own = F.get(ranks, (key % HALF).cast("int"))
        other = F.get(ranks, (key % OTHER).cast("int") + HALF)
        low = F.lit((1 << RANK_BITS) - 1).cast("bigint")
        return F.when(F.shiftright(own, RANK_BITS) == key, own.bitwiseAND(low).cast("int")).when(F.shiftright(other, RANK_BITS) == key, other.bitwiseAND(low).cast("int")).otherwise(F.lit(NONE))

    def merged(s: Column, low: Column, at: Column) -> Column:
        """at: from 1, of the pair's left piece."""
        ids, n = s["ids"], F.size(s["ids"])
        left = F.when(at > 1, F.array(rank(F.get(ids, at - 2), low))).otherwise(F.array().cast("array<int>"))
        right = F.when(at + 1 < n, F.array(rank(low, F.get(ids, at + 1)))).otherwise(F.array().cast("array<int>"))
        return F.struct(
            F.concat(F.slice(ids, 1, at - 1), F.array(low), F.slice(ids, at + 2, n)).alias("ids"),
            F.concat(F.slice(s["ranks"], 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(s["ranks"], at + 2, n)).alias("ranks"),
        )

    def step(s: Column, _: Column) -> Column:
        low = F.array_min(s["ranks"])
        pick = F.transform(F.array(low), lambda x: merged(s, x, F.array_position(s["ranks"], x).cast("int")))
        return F.when(F.coalesce(low, F.lit(NONE)) == NONE, s).otherwise(F.get(pick, F.lit(0)))

    n = F.size(word)
    start = F.struct(word.alias("ids"), F.zip_with(F.slice(word, 1, n - 1), F.slice(word, 2, n), lambda a, b: F.when(b.isNull() | a.isNull(), NONE).otherwise(rank(a, b))).alias("ranks"))
    return F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda s: s["ids"])


def literal(values: list, kind: str) -> Column:
    """A constant array. Spark folds the split text once, so no row carries the array. Values have no commas and no quotes."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') AS array<{kind}>)")


def fold_words(words: DataFrame, ranks_path: str, pieces_col: str = "pieces", out_col: str = "ids") -> DataFrame:
    """Add the ids of each distinct word (array<int> of the ids of its single bytes) by a fold of higher-order functions alone.

    It never leaves the JVM, but interpreted lambdas take about 0.5 ms a word; encode() merges the words of a block with numpy.
    Words of one piece and null words stay as they are.
    """
    ranks = literal(rank_table(load_ranks(ranks_path)).tolist(), "bigint")
    return words.withColumn(out_col, F.when(F.size(pieces_col) > 1, fold_merges(F.col(pieces_col), ranks)).otherwise(F.col(pieces_col)))


class Encoder:
    """Encodes texts block by block: ranked merges run once over each distinct word of a block."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], table: np.ndarray):
        import re

        import regex

        self.words_of = regex.compile(pattern).findall
        self.odd = re.compile(r" (?:\s|\Z)").search
        self.ranks, self.table = ranks, table
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 16 | b
        own, other = self.table[key % HALF], self.table[HALF + key % OTHER]
        low = (1 << RANK_BITS) - 1
        return np.where(own >> RANK_BITS == key, own & low, np.where(other >> RANK_BITS == key, other & low, NONE)).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of two bytes or more, as bytes. Words with equally many pieces are rows of one matrix; a step merges the
        leftmost pair of lowest rank in each row and hands the rows, a piece shorter, to the next matrix."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        left: dict[int, list[tuple]] = {}
        for n in range(max(by_size, default=0), 0, -1):
            own = left.pop(n, [])
            if n in by_size:
                at = np.array(by_size[n])
                m = self.single[np.frombuffer(b"".join([words[k] for k in by_size[n]]), np.uint8)].reshape(-1, n)
                own.append((at, m, self.rank(m[:, :-1], m[:, 1:])))
            if not own:
                continue
            at, m, r = (np.concatenate(x) for x in zip(*own, strict=True))
            p = r.argmin(1) if n > 1 else np.zeros(len(at), np.int64)
            low = r[np.arange(len(at)), p] if n > 1 else np.full(len(at), NONE, np.int32)
            done = low == NONE
            raw = m[done].astype("<u4").tobytes()
            for i, k in enumerate(at[done].tolist()):
                out[k] = raw[4 * n * i : 4 * n * (i + 1)]
            at, m, r, p, low = at[~done], m[~done], r[~done], p[~done], low[~done]
            if not len(at):
                continue
            col, rows = np.arange(n - 1), np.arange(len(at))
            m = np.where(col < p[:, None], m[:, :-1], m[:, 1:])
            m[rows, p] = low
            if n > 2:
                r = np.where(col[:-1] < p[:, None], r[:, :-1], r[:, 1:])
                i = rows[p > 0]
                r[i, p[i] - 1] = self.rank(m[i, p[i] - 1], low[i])
                i = rows[p < n - 2]
                r[i, p[i]] = self.rank(low[i], m[i, p[i] + 1])
            else:
                r = np.zeros((len(at), 0), np.int32)
            left.setdefault(n - 1, []).append((at, m, r))
        return out

    def word_ids(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        out = [b""] * len(raw)
        short = []
        for k, w in enumerate(raw):
            whole = self.ranks.get(w)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(w) > FOLD_BYTES:
                out[k] = np.array(merge_with_heap(self.single[np.frombuffer(w, np.uint8)].tolist(), self.table), "<u4").tobytes()
            else:
                short.append(k)
        for k, ids in zip(short, self.merge([raw[k] for k in short]), strict=True):
            out[k] = ids
        return out

    def block(self, texts: list[str]) -> Iterator[bytes]:
        """ids of each text. A text is first split before each space that a visible character follows (every match
        of the pattern ends there), so that the pattern runs over distinct chunks only. A str key is a chunk after a space, a tuple
        one that begins a text or a word of a text with odd spaces."""
        seen: defaultdict = defaultdict()
        seen.default_factory = seen.__len__
        number, chunks = seen.__getitem__, []
        for text in texts:
            if self.odd(text):
                chunks.append([number((w,)) for w in self.words_of(text)])
            else:
                first, *rest = text.split(" ")
                chunks.append(np.fromiter(map(number, [(first,), *rest] if first else rest), np.int32))
        words: defaultdict = defaultdict()
        words.default_factory = words.__len__
        word, words_of = words.__getitem__, self.words_of
        own = [(word(" " + key),) if isinstance(key, str) and key.isalpha() else tuple(map(word, words_of(" " + key if isinstance(key, str) else key[0]))) for key in seen]
        seen.default_factory = words.default_factory = None  # each is a cycle with its dictionary, which nobody would collect
        ids = self.word_ids(list(words))
        raw = [ids[w[0]] if len(w) == 1 else b"".join([ids[x] for x in w]) for w in own]
        for c in chunks:
            c = c if isinstance(c, list) else c.tolist()
            yield b"".join([raw[k] for k in c])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode every whole text by the ranks in ``ranks_path``, each match of ``pattern`` separately, without special tokens.

    Returns id, n_tokens, ids (array<int>), a row for each input row. A null or empty text has no tokens; repeated rows and null ids stay;
    a very long text is encoded whole; other columns, whatever their names, are left out. An empty table gives none.
    One stage without a shuffle: a task holds a block of at most ``block_bytes`` characters, or one text, and a rank table as
    large as the vocabulary.
    """
    ranks = load_ranks(ranks_path)
    table = rank_table(ranks)
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def batch(ids: list, raws: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(r) // 4 for r in raws], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(raws), "<i4")))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), lists], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pattern, ranks, table)

        def finish(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            own, raws, held = [], [], 0
            for i, raw in zip(ids, encoder.block(texts), strict=True):
                own.append(i)
                raws.append(raw)
                held += len(raw)
                if held > 2 << 20:
                    yield batch(own, raws)
                    own, raws, held = [], [], 0
            if own:
                yield batch(own, raws)

        collecting = gc.isenabled()
        gc.disable()  # block() leaves no cycles, and passes over its dictionaries take a fifth of the time; a worker is used again, so:
        try:
            ids, texts, size = [], [], 0
            for b in batches:
                for i, t in rows_of(b):
                    ids.append(i)
                    texts.append(t or "")
                    size += len(t or "")
                    if size >= block_bytes:
                        yield from finish(ids, texts)
                        ids, texts, size = [], [], 0
            if ids:
                yield from finish(ids, texts)
        finally:
            if collecting:
                gc.enable()
        del ids, texts, encoder
        give_back()

    rows = map_batches(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)), run, "id bigint, n_tokens bigint, ids array<int>")
    return rows.withColumnRenamed("id", id_col)


def joined(ids: Column, pieces: list[bytes]) -> Column:
    """The pieces of an array of ids, concatenated: a binary column. Ids outside the list have no bytes."""
    table = literal([p.hex() for p in pieces], "string")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes of an array<int> column of ids: the binary pieces of the ids, concatenated in the JVM. Null ids give null, none give
    empty bytes; an id that no rank has gives none."""
    ranks = {rank: token for token, rank in load_ranks(ranks_path).items()}
    return df.withColumn(out_col, joined(F.col(ids_col), [ranks.get(i, b"") for i in range(max(ranks) + 1)]))


def digests(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 for each row of encode(): null and
    empty texts have the digests of no bytes, repeated rows and null ids stay, an empty table gives none."""
    little = joined(F.col("ids"), [i.to_bytes(4, "little") for i in range(max(load_ranks(ranks_path).values()) + 1)])
    return decode(encoded, ranks_path).select(id_col, "n_tokens", F.sha2(little, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
