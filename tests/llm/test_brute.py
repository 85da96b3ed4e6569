"""The queries that SQL cannot express against brute-force versions of their results, and odd tables."""

import hashlib
import random
from os.path import commonprefix

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import bpe, chat, digest, html_text, mixing, near, quality, rules, sharding, simhash, warc


def plain_texts(rows):
    """Main texts by the definition: pages in order, each against the nearer of the path before and the path after."""
    paths = []
    for key, i, _, page in sorted(((html_text._key(u, i), i, u, t) for i, u, t in rows), key=lambda r: r[0]):
        if not paths or paths[-1][0] != key[:2]:
            paths.append((key[:2], []))
        paths[-1][1].append((i, page))
    out = {}
    for n, ((host, path), group) in enumerate(paths):
        around = [(paths[k][0][1], paths[k][1][end][1]) for k, end in ((n - 1, -1), (n + 1, 0)) if 0 <= k < len(paths) and paths[k][0][0] == host]
        best = max(around, key=lambda x: len(commonprefix([x[0], path])), default=None)
        for i, page in group:
            out[i] = html_text.main_text(html_text.lines_of(page or ""), best and html_text.lines_of(best[1] or ""))
    return out


def test_pages_differ_from_the_nearest_path_whatever_the_ranges(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        host, path = rng.choice(["a.org", "b.org", "b.org"]), rng.choice([f"/x/{rng.randrange(40)}", "/hot"])
        menu = "".join(f"<p>{rng.choice(['menu one', 'menu two', 'about us'])}</p>" for _ in range(4))
        rows.append((k, rng.choice([None] + [f"http://{host}{path}?q={k}"] * 9), f"{menu}<p>own text number {k} {'long ' * rng.randrange(6)}</p><p>foot {host}</p>"))
    want = plain_texts(rows)
    assert sum(want[i] != html_text.main_text(html_text.lines_of(t), None) for i, _, t in rows) > 300  # differencing decides
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size, parts in ((512, 3), (8, 5)):
        monkeypatch.setattr(html_text, "RANGE_PAGES", size)
        assert {r.page_id: r.text for r in html_text.extract(pages.repartition(parts)).collect()} == want


def test_broken_and_very_long_pages_take_time_in_proportion():
    import time

    for page in ('<div class="a" ' * 20000, "<a " * 50000, '<p>x<b "' * 30000, "<" * 200000, "<!-- " * 50000, "<p>" + "word " * 200000):
        began = time.time()
        html_text.lines_of(page)
        assert time.time() - began < 5


def test_large_alignments_are_halved(monkeypatch):
    monkeypatch.setattr(html_text, "TRACED", 8)
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found, rest = sorted(html_text.common_lines(a, b)), iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


def plain_chain(text):
    """Features by the definition, one window at a time."""
    raw = text.encode().ljust(digest.WINDOW, b"\0") if text else b""
    n = len(raw) - digest.WINDOW + 1
    if n <= 0:
        return []
    ranks = [int(digest._RARITY[h]) for h in digest.entropies(np.frombuffer(raw, np.uint8))]
    votes = [0] * n
    for start in range(1 - digest.NEAR, n):
        inside = range(max(0, start), min(n, start + digest.NEAR))
        votes[min(inside, key=lambda k: (ranks[k], k))] += 1
    seen, filters = set(), []
    for k in range(n):
        h = int(digest._hash(np.frombuffer(raw[k : k + digest.WINDOW], np.uint8)[None])[0])
        if votes[k] >= digest.POPULAR and h not in seen:
            if len(seen) % digest.FILTER_FEATURES == 0:
                filters.append(set())
            seen.add(h)
            filters[-1] |= {h >> 11 * j & digest.FILTER_BITS - 1 for j in range(digest.HASHES)}
    return filters


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    total = lambda x: sum(map(len, x))
    if total(a) > total(b):
        a, b = b, a
    got = 0.0
    for x in a:
        scores = []
        for y in b:
            floor, most = len(x) * len(y) / digest.FILTER_BITS, min(len(x), len(y))
            floor += min(2.5 * (floor * (1 - len(y) / digest.FILTER_BITS)) ** 0.5, (most - floor) / 2)
            scores.append(min(1.0, max(0.0, (len(x & y) - floor) / max(most - floor, 1e-9))))
        got += len(x) * max(scores)
    return min(1.0, got / total(a))


def test_digests_equal_the_definition(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijé ") for _ in range(rng.randint(2, 9)))
    texts = {5 * k: " ".join(word() for _ in range(n)) for k, n in enumerate((0, 1, 2, 3, 8, 30, 80, 300, 900, 5, 40, 41))}
    monkeypatch.setattr(digest, "RANGE_DOCS", 2)
    got = {r.doc_id: r for r in digest.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)).collect()}
    ids = sorted(texts, reverse=True)
    bits = lambda said: [set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in digest.from_text(said)]
    for k, i in enumerate(ids):
        following = texts[ids[(k + 1) % len(ids)]]
        own, other = plain_chain(texts[i]), plain_chain(digest.edited(texts[i], following))
        assert bits(got[i].fingerprint) == own and bits(got[i].edited_fingerprint) == other
        assert got[i].near_edited == pytest.approx(plain_likeness(own, other), abs=1e-6) or sum(map(len, own)) == sum(map(len, other))
        assert got[i].near_next == pytest.approx(plain_likeness(own, plain_chain(following)), abs=1e-6)


def test_scores_equal_a_plain_forward_pass():
    model = quality.train(["good clean words here"] * 3 + ["%% ## && junk$"] * 3, [1, 1, 1, 0, 0, 0])
    for text in ("good words", "%% ##", "", "good good %%"):
        found = [b for w in text.split() for b in quality.features(w)]
        counted = quality.Counter(text.split())
        found += [b for b, n in quality.document_features(counted) for _ in range(n)]
        z = sum(float(model.values[b]) for b in found) / len(found) + model.bias
        assert model.scorer()(text) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)
    assert model.scorer()("good clean") > 0.5 > model.scorer()("## &&")


ROWS = [(1, "word " * 12 + "plain text of a kind", "en", "s", 1, "x"), (1, "word " * 12 + "plain text of a kind", "en", "s", 1, "x"), (None, None, None, None, 2, "y"), (None, "", "en", None, 3, "z"), (4, "b" * 300_000 + " tail", "en", "s", 4, "long")]


def odd_table(spark):
    """Names with dots and names that the operators use, nulls, repeated rows and a very long text."""
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, `a.b` int, shard string")


def test_stages_take_any_columns_and_empty_tables(spark):
    docs = odd_table(spark)
    model = quality.train(["good words here", "%%% ###"], [1, 0])
    for keep in (rules.keep, lambda d: quality.keep(d, model), mixing.repeated, simhash.keep_one, near.keep_one):
        out = keep(docs)
        assert out.columns == docs.columns and {r[4] for r in out.collect()} <= {1, 2, 3, 4}
        assert keep(docs.limit(0)).count() == 0
    assert sorted(r["a.b"] for r in near.keep_one(docs).collect()) == [1, 2, 4]


def test_shards_are_written_with_all_columns(spark, tmp_path):
    docs = odd_table(spark).union(spark.createDataFrame([(k, f"text {k}", "en", "s", k, "q") for k in range(100, 400)], odd_table(spark).schema))
    name = sharding.write(docs, f"file://{tmp_path}/out", 1000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert name == "shard_" and sorted(back.drop(name).columns) == sorted(docs.columns) and back.count() == docs.count()
    sizes = back.groupBy(name).agg(F.sum(F.octet_length("text")).alias("n"), F.countDistinct("text").alias("texts")).collect()
    assert all((r.n or 0) <= 1000 or r.texts == 1 for r in sizes) and len(sizes) > 2
    spread = sharding.shard(spark.createDataFrame([(None, f"{k} " * 20) for k in range(200)], "doc_id bigint, text string"), 500)
    assert spread.select("shard").distinct().count() > 8  # rows without ids


def test_chats_of_odd_tables(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    turns = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 1, "assistant", "é" * 200_000, 2), (1, None, None, None, 3)], "conv_id bigint, turn bigint, role string, text string, `a.b` int")
    r = chat.digests(turns, path).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3, 200_000, hashlib.sha256(("é" * 200_000).encode()).hexdigest())
    out = chat.format_conversations(turns, path).collect()
    assert len(out) == 1 and chat.unescape(chat.parse(out[0].formatted)[-1][1]) == "é" * 200_000 and sum(out[0].mask) > 0 and len(out[0].mask) == len(out[0].token_ids)
    assert chat.digests(turns.limit(0), path).count() == 0 and chat.format_conversations(turns.limit(0), path).count() == 0


def test_every_text_encodes_as_tiktoken_does(spark, sf_dir):
    import tiktoken

    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in bpe.digests(bpe.encode(docs, path, tokenizers.PATTERN), path).collect():
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_long_records_and_cells(spark):
    rows = [(1, "u", "é" * 3_000_000, 1), (2, "u", "é" * 3_000_000, 2), (3, None, None, 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, `a.b` int")
    in_files = sorted(tuple(r) for r in warc.round_trip(pages).collect())
    in_cells = sorted(tuple(r) for r in warc.read_archives(warc.write_archives(pages)).collect())
    assert in_files == in_cells and [(r[0], r[1], r[3], r[4]) for r in in_files] == [(1, 6_000_000, "revisit", 2), (2, 6_000_000, "response", None), (3, 0, "response", None)]


def test_a_class_without_ids_links_two_others(spark):
    """Fingerprints three bits apart in a chain whose middle has no id."""
    fps = spark.createDataFrame([(0b0,), (0b111,), (0b111111,)], "node bigint")
    found = simhash.components(simhash.links(fps)).collect()
    assert {r.label for r in found} == {0} and len(found) == 3
