import hashlib
import html
import os
import random
import zipfile
import zlib

import duckdb
import numpy as np
import pytest

from loomline.llm import bpe, chat, digest, html_text, mixing, quality, queries, rules, sharding, warc

tokenizers_path = pytest.importorskip("public_tokenizers").path
RANKS = "byte_bpe_multi_50k.tiktoken"


def rows_of(df, *names):
    return [tuple(r[n] for n in names or df.columns) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [list(want.columns).index(c) for c in names]
    fine = lambda row: tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in row)
    assert sorted((fine(r[c] for c in names) for r in df.collect()), key=repr) == sorted((fine(r[i] for i in at) for r in want.fetchall()), key=repr)


EDGES = [(1, None, "en", "s"), (2, "", None, None), (3, "a " * 30000, "en", "s"), (4, "x" * 5000, "en", "s"), (5, "same text here", "en", "s"), (5, "same text here", "en", "s"), (None, "null id", "en", "s")]


def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that the operators use."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in EDGES], "doc_id bigint, text string, lang string, source string, n_words string, size int, score int")


def test_edges(spark, sf_dir):
    docs = edge_docs(spark)
    path, pattern = tokenizers_path(RANKS), __import__("public_tokenizers").PATTERN
    model = quality.train(["good words here", "%%% ###"], [1, 0])
    run = {
        "bpe": lambda d: bpe.encode(d, path, pattern),
        "quality": lambda d: quality.score(d, model),
        "rules": rules.judge,
        "mixing": mixing.mix,
        "sharding": lambda d: sharding.shard(d, 1000),
        "digest": digest.fingerprints,
    }
    for name, f in run.items():
        ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in f(docs).collect())
        assert ids == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 5), (True, None)], name
        assert f(docs.limit(0)).count() == 0, name
    for keep in (rules.keep, lambda d: quality.keep(d, model), mixing.repeated):
        assert keep(docs).columns == docs.columns


def test_bpe_equals_tiktoken_and_its_fold(spark):
    import public_tokenizers
    import tiktoken

    path = tokenizers_path(RANKS)
    ranks = bpe.load_ranks(path)
    texts = ["foo  bar", " a", "a ", "\n\n x \n \n y", "don't 'll  \x1c\x1d b\x85c  d　e", "x" * 300 + " " + "ab" * 200, "日本語 テキスト٣٤ ½", "", " ", "  a b", "a\n b\n\n  c", "É" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, block_bytes=50), path).collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    words = ["ouvipa", " thshst", "éonçé", "a"]
    pieces = [(k, [ranks[bytes([b])] for b in w.encode()]) for k, w in enumerate(words)]
    folded = bpe.fold_words(spark.createDataFrame(pieces, "k int, pieces array<int>"), path)
    assert {r.k: list(r.ids) for r in folded.collect()} == {k: enc.encode_ordinary(w) for k, w in enumerate(words)}
    back = bpe.decode(folded, path)
    assert {r.k: bytes(r.decoded).decode() for r in back.collect()} == dict(enumerate(words))


def test_quality_held_out(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES["op5_quality"](spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in held)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi <|end|> \\ <| \\<\\|"), (1, 1, "assistant", "\n<|turn|>assistant<|text|>é日本 \\"), (1, 2, "assistant", ""), (1, 3, "assistant", " x "), (2, 0, None, None), (None, 5, "assistant", "n")]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), tokenizers_path("byte_bpe_50k.json")).collect()}
    for conv in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_runs_equal_the_whole(spark, sf_dir, monkeypatch):
    turns, path = spark.read.parquet(f"{sf_dir}/conversations.parquet"), tokenizers_path("byte_bpe_50k.json")
    whole = sorted(rows_of(chat.digests(turns, path)))
    monkeypatch.setattr(chat, "RUN_CHARS", 300)
    assert sorted(rows_of(chat.digests(turns, path))) == whole


def test_digest_entropy_and_likeness():
    rng = random.Random(1)
    b = np.frombuffer(bytes(rng.choice(b"abcdefgh ") for _ in range(500)), np.uint8)
    for i, h in enumerate(digest.entropies(b)):
        p = np.unique(b[i : i + digest.WINDOW], return_counts=True)[1] / digest.WINDOW
        assert abs(h - 1000 * -(p * np.log2(p)).sum() / np.log2(digest.WINDOW)) <= 1
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    one, two = " ".join(word() for _ in range(600)), " ".join(word() for _ in range(600))
    a, b, c = digest.chains([one, digest.edited(one, two), two])
    assert digest.likeness(a, a) == 1.0 and digest.likeness(a, b) > 0.5 and digest.likeness(a, c) < 0.1
    assert digest.likeness(b, a) == digest.likeness(a, b) and (digest.from_text(digest.as_text(a)) == a).all()


def test_digest_follows_the_next_document(spark):
    texts = {k * 7: f"text {k} " * (k % 5 + 1) for k in range(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    ids = sorted(texts, reverse=True)
    want = {i: hashlib.sha256(digest.edited(texts[i], texts[ids[(k + 1) % 50]]).encode()).hexdigest() for k, i in enumerate(ids)}
    assert dict(rows_of(digest.fingerprints(docs), "doc_id", "edited_sha256")) == want


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>H</header><nav>menu</nav><script>var a="<p>x</p>"</script>
    <div class="cookie-notice">ok?</div><p class="ad">buy<p>First &amp; <b>bold</b>&nbsp;x<br>next<!-- c --></p><form><input>f</form><div id=comments><div>c</div>c</div><p>Last</p><footer>f</footer></body>"""
    assert html_text.main_text(html_text.lines_of(page), None) == "First & bold x next Last"
    a, b = ["n", "x", "s", "y", "f"], ["n", "p", "s", "q", "r", "f"]
    assert html_text.common_lines(a, b) == {0, 2, 4}
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html_text.common_lines(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_html_pages(spark):
    page = lambda k: f"<body><p>Our shop</p><p>Body {k} {html.escape('<')}</p><p>Call us</p></body>"
    rows = [(k, f"http://h.org/a/{k}", page(k), 7) for k in range(6)] + [(9, None, None, 7), (10, "::", "", 7), (11, "http://h.org/a/5?x", page(5), 7)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract(pages.coalesce(1)).collect()}
    assert {k: got[k] for k in (9, 10)} == {9: "", 10: ""} and sorted(got) == [0, 1, 2, 3, 4, 5, 9, 10, 11]
    assert [got[k] for k in range(5)] == [f"Body {k} <" for k in range(5)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_warc_package(tmp_path, spark):
    raw = warc.record(4, "http://a/\r\n", "é".encode(), None), warc.record(2, None, "é".encode(), 4)
    for zip64 in (False, True):
        package = warc.write_zip([("a", b"1" * 70000), ("b", raw[0])], zip64)
        path = tmp_path / f"{zip64}.zip"
        path.write_bytes(package)
        assert zipfile.ZipFile(path).read("b") == raw[0]
        for source in (warc.BytesRange(package), warc.FileRange(str(path))):
            assert warc.Package(source).range("a", 69999, 5)[:1] == b"1"
            assert warc.Package(source).range("b", 0, len(raw[0])) == raw[0]
    rows = [(1, "u", "x", 1), (3, "u", "x", 1), (3, "u", "x", 1), (2, None, None, 1), (5, "u", "", 1), (None, "u", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to int")
    got = sorted(rows_of(warc.round_trip(pages), "page_id", "record_type", "refers_to", "payload_bytes"), key=repr)
    assert got == sorted([(1, "revisit", 3, 1), (3, "response", None, 1), (3, "response", None, 1), (2, "revisit", 5, 0), (5, "response", None, 0), (None, "revisit", 3, 1)], key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0
    archives = [bytes(r.content) for r in warc.write_archives(pages).collect()]
    paths = [str(tmp_path / f"{k}.wacz") for k in range(len(archives))]
    for p, content in zip(paths, archives, strict=True):
        with open(p, "wb") as f:
            f.write(content)
    assert sorted(rows_of(warc.read_files(spark, paths), "page_id", "record_type"), key=repr) == sorted([x[:2] for x in got], key=repr)


def test_sharding_splits_only_what_is_over(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(3000)], "doc_id bigint, text string")
    got = sharding.shard(docs, 150).collect()
    assert len(got) == 3000 and max(r.depth for r in got) > 8  # two rounds
    size = {}
    for r in got:
        text = "x" * (r.doc_id % 50)
        bits = f"{int(hashlib.md5(f'{r.doc_id}:{hashlib.md5(text.encode()).hexdigest()}'.encode()).hexdigest()[:12], 16):048b}"
        assert bits.startswith(r.shard) and len(r.shard) == r.depth
        for d in range(49):
            size[bits[:d]] = size.get(bits[:d], 0) + r.n_bytes
    for r in got:
        assert size[r.shard] == r.shard_bytes <= 150 < size[r.shard[:-1]]


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, "w " * rng.randrange(40), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(3000)], "doc_id bigint, text string, source string")
    got = mixing.mix(docs)
    by = {}
    for r in got.join(docs.select("doc_id", "source"), "doc_id").collect():
        assert r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    for target, size, taken in by.values():
        assert abs(taken - target) <= 40 and target <= 2 * size
    assert sorted(rows_of(got)) == sorted(rows_of(mixing.mix(docs.repartition(3))))
    copies = mixing.repeated(docs).where("length(trim(text)) > 0").count()
    assert copies == sum(r.taken // r.size for r in got.collect() if r.size)


def test_pipeline_keeps_clean_and_drops_copies(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() == docs.count() > 0
    assert os.path.exists(corpus_pipeline.__file__)
