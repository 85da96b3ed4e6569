"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams; a softmax layer scores the average.
Trained by numpy stochastic gradient descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, columns_of, give_back, map_batches, materialize, rows_of

#: Documents that the model is fitted on, at most, and characters of them in all.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 16 << 20
#: Rows of the vector table, length of a vector, lengths of the character n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 18, 10, (3,)
EPOCHS, RATE, SEED = 5, 0.6, 42
#: Distinct words, and n-grams, whose sums a task remembers.
MEMO = 300_000
THRESHOLD = 0.3


class Memo(dict):
    """What ``make`` gives of a key, remembered for MEMO keys."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _sign(point: int) -> str:
    c = chr(point)
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


_SIGNS = Memo(_sign)


def shape_of(word: str) -> str:
    """The classes of a word's characters, each where it first comes."""
    return "".join(dict.fromkeys(word.translate(_SIGNS)))


def features(word: str) -> list[int]:
    """Buckets of a word, its marked character n-grams and its shape (upper case, digits and other signs by class)."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [xxhash.xxh32_intdigest(x.encode(), seed=k) % BUCKETS for k, x in ((1, word), (2, shape_of(word)), *((3, g) for g in grams))]


def document_features(words: Counter) -> list[tuple[int, int]]:
    """Buckets that stand for the whole document: how much it repeats itself, how long its words are, how many it has."""
    n = sum(words.values())
    if not n:
        return [(xxhash.xxh32_intdigest(b"empty", seed=4) % BUCKETS, 1)]
    longest = max(words.values())
    said = (f"distinct {int(10 * len(words) / n)} {min(n.bit_length(), 9)}", f"longest {int(10 * longest / n)}", f"size {min(n.bit_length(), 9)}")
    return [(xxhash.xxh32_intdigest(x.encode(), seed=4) % BUCKETS, max(1, n)) for x in said]


@dataclass
class Model:
    """score = logistic of the mean over features of ``values`` plus ``bias``: with a linear softmax, each vector counts only through
    its product with the difference of the two output rows."""

    values: np.ndarray
    bias: float

    def scorer(self):
        """A function of a text. Words, shapes and n-grams are looked up rather than hashed again: most new words are made of known grams."""
        values = self.values
        at = lambda x, k: float(values[xxhash.xxh32_intdigest(x.encode(), seed=k) % BUCKETS])
        shapes, grams = Memo(lambda x: at(x, 2)), Memo(lambda x: at(x, 3))

        def of(word: str) -> float:
            marked = f"<{word}>"
            return at(word, 1) + shapes[shape_of(word)] + sum([grams[marked[i : i + n]] for n in GRAMS for i in range(len(marked) - n + 1)])

        memo = Memo(of)

        def score(text: str) -> float:
            said = text.split()
            words = Counter(said)
            total = sum(map(mul, map(memo.__getitem__, words), words.values()))
            n = 2 * len(said) + sum(len("".join(said)) + (3 - g) * len(said) for g in GRAMS)  # a marked word has two signs more, and is no shorter than a gram
            for b, k in document_features(words):
                total += k * float(values[b])
                n += k
            z = total / n + self.bias
            return float(1 / (1 + np.exp(-z))) if z > -500 else 0.0

        return score


def train(texts: list[str], labels: list[int]) -> Model:
    """One document a step, in a seeded order, at a falling rate. The same texts give the same model."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    memo: dict[str, array] = {}  # four bytes a bucket: the driver has little room
    docs = []
    for text in texts:
        words, count = Counter(text.split()), Counter()
        for w, k in words.items():
            if w not in memo:
                memo[w] = array("i", features(w))
            for b in memo[w]:
                count[b] += k
        for b, k in document_features(words):
            count[b] += k
        own = np.fromiter(count, np.int32, len(count))
        share = np.fromiter(count.values(), np.float32, len(count))
        docs.append((own, share / share.sum()))
    del memo
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 8.0 if not labels or labels[0] else -8.0)
    weight = [len(labels) / (2 * labels.count(k)) for k in (0, 1)]
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            own, share = docs[k]
            rate = RATE * (1 - done / steps)
            done += 1
            seen = vectors[own]
            mean = share @ seen
            z = out @ mean + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[labels[k]] -= 1
            error *= weight[labels[k]] ** 0.5
            back = error @ out
            out -= rate * np.outer(error, mean)
            bias -= 0.1 * rate * error
            vectors[own] = seen - (rate * 25) * share[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def training_ids(labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``limit`` labelled ids whose crc32 modulo 5 is not 0: those of smallest hash, one label each. Null ids or labels are left out."""
    known = labels.select(F.col("doc_id"), F.col("quality").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Model:
    """Fit on the labelled training documents, ``limit`` of them and SAMPLE_CHARS characters at most: by their ids' hash, whatever their
    length, the last text cut to what is left and those after it left out. An id that repeats is fitted on one of its texts, that of least
    hash. Null and empty texts are examples too. Without labels of both kinds, all documents get the score of the one there is, or are
    kept. Only the bounded sample comes to the driver."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.join(F.broadcast(training_ids(labels, limit)), "doc_id")
    sample = materialize(known.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "label", F.col("t.text").alias("text")))
    room = W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1)  # over ``limit`` rows without texts
    sizes = sample.select("doc_id", F.length("text").alias("n"))
    taken = sizes.select("doc_id", (SAMPLE_CHARS - F.coalesce(F.sum("n").over(room), F.lit(0))).cast("int").alias("room")).where("room > 0")
    cut = sample.join(F.broadcast(taken), "doc_id").select("doc_id", F.substring("text", F.lit(1), F.col("room")).alias("text"), "label")
    rows = sorted(cut.collect(), key=lambda r: (len(r.text), r.doc_id, r.text))
    texts, kinds = [r.text for r in rows], [1 if r.label == 1 else 0 for r in rows]
    del rows
    model = train(texts, kinds)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text. Null and empty texts are scored by the empty feature; rows of one text
    score alike; repeated rows, null ids stay (null ids are held out). Other columns, whatever their names, are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            yield batch_of([(i, scorer(t or "")) for i, t in rows_of(b)], schema)
        del scorer
        give_back()

    scored = map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns, whatever their names. Null and empty texts are scored by the
    empty feature; repeated rows and null ids are judged row by row; very long texts are scored whole. An empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            kept = pa.array([scorer(t or "") >= THRESHOLD for (t,) in rows_of(b.select([1]))], pa.bool_())
            yield b.select([0]).filter(kept)
        del scorer
        give_back()

    rows = docs.select(F.struct(*columns_of(docs)).alias("doc"), "text")
    return map_batches(rows, run, rows.select("doc").schema).select("doc.*")
