"""Cases that were once dropped, second forms of what SQL cannot say, and the pipeline against a plain form of its stages."""

import gc
import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoflow.llm import common, components, licenses, ngram_join, phrases, quality_net, quality_rules, secrets, sentencepiece, substring_dedup, toxicity, warc
from geoflow.llm.queries import OP10_SQL
from geoflow.session import scope, shared_dir
from tests.conftest import plan

VOCABULARY = [a + b + c for a in ("ba", "ko", "ti", "mu", "Ré") for b in ("lo", "na", "se", "") for c in ("n", "ra", "x")]


def prose(draw, n):
    return " ".join(draw.choice(VOCABULARY) + ("." if draw.random() < 0.1 else "") for _ in range(n))


# --- secrets --------------------------------------------------------------------

@pytest.mark.parametrize("text, found", [
    ("2024-01-15_zQ9xK2mW7pL4vT8nB3cR6yH1", "zQ9xK2mW7pL4vT8nB3cR6yH1"),
    ("407408718192-k3j9f8a7s6d5g4h3j2k1l0q9w8e7r6t5", "k3j9f8a7s6d5g4h3j2k1l0q9w8e7r6t5"),
    ("kJhGfDsAqWeRtYuIoPzXcVbNm", "kJhGfDsAqWeRtYuIoPzXcVbNm"),
    ("release-v2_kJhGfDsAqWeRtYuIoPzXcVbNm", "kJhGfDsAqWeRtYuIoPzXcVbNm"),
    ("2024-01-15-16-20-33-2024-01-15", None), ("v1-2-3-beta_4_final_release", None), ("src/main/java/org/apache/spark", None),
    ("TheQuickBrownFoxJumpsOverDogs", None), ("AVERYLONGNAMEOFACONSTANTVALUE", None), ("123e4567-e89b-12d3-a456-426614174000", None),
    ("xxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", None), ("abcdefghijklmnopqrstuvwxyz0123456789", None),
])
def test_allow_list_covers_only_what_it_names(text, found):
    spans = [text[a:b] for a, _, b in secrets.entropy_spans(text)]
    assert spans == ([found] if found else [])


def plain_base(text):
    """The contract's patterns as they stand, one kind after the other."""
    out = []
    for kind, pattern, flags, group, least in (
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
            ("access", "AKIA[A-Z0-9]+", 0, 0, 16), ("hex", "[0-9a-f]+", 0, 0, 32)):
        out += [(m.start(), secrets.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


def test_base_spans_against_the_patterns_as_they_stand():
    draw = random.Random(4)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "apiKey", "toKen", "=", ":", " ", "  ", '"', "'", "abc", "x" * 8, "0123456789abcdef" * 2,
             "AKIA", "AKIAABCD", "Z9" * 8, "é", "\n", "-", ".", "f" * 31]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert secrets.base_spans(text) == plain_base(text), text


# --- quality rules --------------------------------------------------------------

def test_language_tags_against_sql(spark):
    """Tags in other forms belong to their language; without one, the nearest reference counts."""
    draw = random.Random(8)
    german = [w.upper()[::-1] + "ung" for w in VOCABULARY]
    rows = [(k, prose(draw, 200), ("en", "EN", "en-US", "en_GB")[k % 4]) for k in range(40)]
    rows += [(100 + k, " ".join(draw.choice(german) for _ in range(150)), ("de", "DE-at")[k % 2]) for k in range(30)]
    junk = " ".join("#%&" * 3 + str(draw.randint(0, 10**9)) for _ in range(120))
    tags = ["en", "EN", "en-US", None, "", "english", "1"]
    rows += [(200 + k, junk, tag) for k, tag in enumerate(tags)] + [(300 + k, prose(draw, 200), tag) for k, tag in enumerate(tags)]
    rows += [(400, None, "en"), (401, "", None), (402, "few words", "xx")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, _kept string, n_words int")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert not any(got[200 + k].kept for k in range(len(tags))) and all(got[300 + k].kept for k in range(len(tags)))
    con = duckdb.connect()
    table = docs.select("doc_id", "text", "lang").toArrow()
    con.register("documents", table)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = sorted(con.execute(f"select {', '.join(names)} from ({OP10_SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in got.values()) == expected
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_repeated_words_against_windows():
    draw = random.Random(3)
    for n in (0, 1, 2, 3, 4, 5, 40, 400):
        words = [draw.choice("abcd") for _ in range(n)]
        windows = [tuple(words[i:i + 3]) for i in range(n - 2)]
        assert quality_rules.repeated(words) == len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


# --- quality network ------------------------------------------------------------

def random_net(dtype=np.float64):
    net = quality_net.Net(quality_net.Shape(vector=3, filters=5))
    draw = np.random.default_rng(2)
    net.vectors, net.filters, net.bias, net.weights, net.shift = (
        (p + draw.normal(0, 0.3, p.shape)).astype(dtype) for p in net.params)
    net.vectors[quality_net.PAD] = 0
    return net


def chunk_by_chunk(net, text):
    """The score as the docstring says it, one chunk after the other."""
    data = (text or "").encode()
    count, evidence = quality_net.segment_count(data) - 1, 0.0
    for k in range(count):
        chunk = data[k * 256:k * 256 + 512]
        values = list(chunk) + [quality_net.PAD] * (512 - len(chunk))
        blocks = [np.concatenate([net.vectors[v] for v in values[i:i + 4]]) for i in range(0, 512, 4)]
        best = np.full(net.bias.size, -np.inf)
        for i, block in enumerate(blocks):
            best = np.maximum(best, block @ net.filters[0] + (blocks[i + 1] @ net.filters[1] if i + 1 < len(blocks) else 0))
        evidence += np.maximum(best + net.bias, 0) @ net.weights
    return 1 / (1 + math.exp(-(evidence / count + net.shift[0] + net.prior)))


def test_scores_chunk_by_chunk():
    draw, net = random.Random(6), random_net()
    texts = [None, "", "a", "b" * 255, "c" * 256, "é" * 200, *["".join(draw.choice("abc \n中") for _ in range(n)) for n in (500, 512, 513, 900, 5000)]]
    assert np.allclose(net.scores(texts), [chunk_by_chunk(net, t) for t in texts], atol=1e-6)
    assert np.allclose(net.scores(texts), [net.scores([t])[0] for t in texts], atol=1e-6)


def test_gradient_against_differences(monkeypatch):
    monkeypatch.setattr(quality_net, "CHUNKS", 3)  # rows over several blocks
    draw, net = random.Random(7), random_net()
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(n)).encode() for n in (3, 300, 700, 2600)]
    labels = np.array([1, 0, 0, 1])
    loss, grads = quality_net.gradient(net, texts, labels)
    scores = net.scores([t.decode() for t in texts])
    assert abs(loss + np.mean(labels * np.log(scores) + (1 - labels) * np.log(1 - scores))) < 1e-6
    pick = np.random.default_rng(1)
    for p, g in zip(net.params, grads):
        for at in pick.choice(p.size, min(p.size, 25), replace=False):
            place = np.unravel_index(at, p.shape)
            if p is net.vectors and place[0] == quality_net.PAD:
                continue
            before = p[place]
            p[place] = before + 1e-5
            more = quality_net.gradient(net, texts, labels)[0]
            p[place] = before - 1e-5
            less = quality_net.gradient(net, texts, labels)[0]
            p[place] = before
            assert abs((more - less) / 2e-5 - g[place]) < 1e-5


# --- toxicity -------------------------------------------------------------------

def test_risk_against_differences():
    draw = np.random.default_rng(4)
    for prior, shift in ((0.2, 0.0), (0.7, -1.0), (0.9, -2.0)):
        z = draw.normal(0, 1, 30)
        z[:10] += 2
        z[10:] += shift
        value, g = toxicity.risk(z, 10, prior)
        for k in range(30):
            step = np.zeros(30)
            step[k] = 1e-6
            more, less = toxicity.risk(z + step, 10, prior)[0], toxicity.risk(z - step, 10, prior)[0]
            assert abs((more - less) / 2e-6 - g[k]) < 1e-6
        p = 1 / (1 + np.exp(-z))
        clean = -np.log(1 - p[10:]).mean() + prior * np.log(1 - p[:10]).mean()
        assert abs(value - (prior * -np.log(p[:10]).mean() + clean if clean >= 0 else -clean)) < 1e-9


def test_words_are_chosen_in_spark_as_in_the_plain_form(spark):
    draw = random.Random(3)
    toxic = [prose(draw, 30) + " vileword " + draw.choice(["nasty", "ugly", "grim"]) for _ in range(80)]
    clean = [prose(draw, 32) for _ in range(160)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(toxic + clean)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(240)], "doc_id long, toxic int")
    given = toxicity.Settings(prior=0.3, steps=60)
    got = toxicity.train(docs, labels, given, modulus=10**9, rest=1)
    words = [sorted(toxicity.words_of(t)) for t in toxic + clean]
    expected = toxicity.fit(sorted(words[:80]), sorted(words), 0.3, given)
    assert set(got.weights) == set(expected.weights) and "vileword" in got.weights
    assert all(abs(got.weights[w] - x) < 1e-9 for w, x in expected.weights.items()) and abs(got.bias - expected.bias) < 1e-9


# --- WARC -----------------------------------------------------------------------

def test_payloads_of_failed_predicates_are_not_read(spark, tmp_path):
    """Payload bytes are spoilt in the archive: who asks for revisits does not notice, who decodes responses does."""
    draw = random.Random(1)
    body = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300_000))
    pages = spark.createDataFrame([(1, "u", body), (2, "v", body), (3, "w", "x")], "page_id long, url string, html string").coalesce(1)
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write_archives(warc.page_records(pages).coalesce(1), path, compression=compression)
        (name,) = [p for p in (tmp_path / compression).iterdir() if ".warc" in p.name and not p.name.endswith((".starts", ".crc"))]
        data = bytearray(name.read_bytes())
        at = data.find(body[1000:1040].encode()) if compression == "none" else len(data) // 2
        data[at:at + 40] = bytes(40)
        name.write_bytes(bytes(data))
        revisits = warc.read_archives(spark, path, verify="true").where("record_type = 'revisit'").collect()
        assert [(r.record_id, r.refers_to, r.payload_bytes) for r in revisits] == [("urn:page:2", "urn:page:1", 300_000)]
        assert warc.read_archives(spark, path, payload="false").count() == 3
        with pytest.raises(Exception):
            warc.read_archives(spark, path, verify="true").where("record_type = 'response'").collect()


def test_skipped_records_of_any_size(spark, tmp_path):
    """Members of less and more than a block, of which every other one is passed over."""
    draw = random.Random(2)
    bodies = ["".join(draw.choice("abcdefgh ") for _ in range(n)) for n in (10, 3_000, 9_000, 60_000, 200_000, 5_000, 2_047, 70_000)]
    pages = spark.createDataFrame([(k, "u", bodies[k % len(bodies)]) for k in range(40)], "page_id long, url string, html string")
    for options in ({}, {"compression": "none"}, {"split_bytes": "3000"}, {"split_bytes": "100", "file_bytes": "50000"}):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        warc.write_archives(warc.page_records(pages).repartition(2, "record_id"), path, **options)
        for kind, n in (("revisit", 32), ("response", 8)):
            got = warc.read_archives(spark, path, payload="false", verify="true").where(F.col("record_type") == kind)
            assert got.count() == n == got.select("record_id").distinct().count()


# --- empty tables and clashing names --------------------------------------------

CLASH = ("_gone", "_kept", "_first", "_least", "_label", "_text", "gid", "sid", "n", "bins", "text_key", "id", "number", "copies", "pieces", "_key")


def test_private_names_may_be_columns(spark):
    draw = random.Random(9)
    base = prose(draw, 100)
    rows = [(1, base), (2, base), (3, base + " x"), (4, prose(draw, 90)), (None, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASH:
        docs = docs.withColumn(name, F.lit("clash"))
    assert sorted(r.doc_id or 0 for r in ngram_join.keep_one(docs).collect()) == [0, 1, 4, 6] and ngram_join.keep_one(docs).columns == docs.columns
    assert sentencepiece.encode_documents(docs).count() == sentencepiece.round_trip(docs).count() == 6
    assert substring_dedup.removed(docs).count() == 6 and secrets.mask_documents(docs).columns == docs.columns
    assert {r.doc_id: r.component_id for r in ngram_join.components(docs).collect()}[3] == 1
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    assert quality_net.classify(docs, labels, quality_net.Shape(rounds=1)).count() == 6


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (sentencepiece.round_trip(docs), sentencepiece.encode_documents(docs), ngram_join.components(docs), ngram_join.keep_one(docs),
                 quality_net.classify(docs, labels), toxicity.classify(docs, labels), secrets.scan_documents(docs), substring_dedup.removed(docs),
                 quality_rules.judge(docs), licenses.scan_documents(docs)):
        assert rows.count() == 0


def test_very_long_texts_are_scored_whole(spark):
    text = "lorem ipsum dolor " * 120_000
    docs = spark.createDataFrame([(1, text), (2, text[:2000])], "doc_id long, text string")
    net = random_net(np.float32)
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality_net.probability(net, F.col("text")).alias("s")).collect()}
    assert abs(got[1] - net.scores([text])[0]) < 1e-5


# --- the pipeline ---------------------------------------------------------------

def test_pipeline_against_a_plain_form(spark, tmp_path):
    draw = random.Random(11)
    item = prose(draw, 30)
    base = [prose(draw, draw.randint(60, 160)) for _ in range(25)]
    texts = [*base, *base[:6], *[t + " " + draw.choice(VOCABULARY) for t in base[3:9]], base[20] + " " + item, "short", None, "", "ba " * 90,
             prose(draw, 70) + " password = abcdefgh1234 " + prose(draw, 10), prose(draw, 80) + " zQ9xK2mW7pL4vT8nB3cR6yH1"]
    docs = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Quality: the base rule; all other texts are from one vocabulary and lie near their reference.
    good = [(k, t) for k, t, *_ in docs if t and len(t.split()) >= 50 and 100 * quality_rules.repeated(t.split()) <= 50 * len(t.split())]
    # Near copies: all pairs of five-word shingles, components by spreading the least id.
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (common.lowered(t).split() for _, t in good)]
    least = list(range(len(good)))
    for _ in good:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    alone = [x for k, x in enumerate(good) if least[k] == k]
    # Contamination: thirteen words in a row of the item.
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", common.lowered(t))
    windows = {tuple(words(item)[i:i + 13]) for i in range(len(words(item)) - 12)}
    clean = []
    for k, t in alone:
        w = words(t)
        hit = {i + j for i in range(len(w)) if tuple(w[i:i + 13]) in windows for j in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((k, t))
    # Secrets masked by spans found here, then the heap form of each unit.
    model, drop = sentencepiece.model_of(sentencepiece.MODEL), sentencepiece.Dropout()
    expected = {}
    for k, t in clean:
        masked = secrets.redact(t, sorted(plain_base(t) + secrets.entropy_spans(t)))
        expected[k] = (masked, sentencepiece.encode_texts(model, [k], [masked], drop)[0].tolist())

    with scope():
        got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
        assert set(got) == set(expected) and len(got) < len(good) < len(docs)
        for k, (text, pieces) in expected.items():
            assert list(got[k].pieces) == pieces and got[k].n_pieces == len(pieces) and model.decode(pieces) == text


def test_nothing_is_left_behind(spark, tmp_path):
    """Kept tables go with the step that wrote them, and the result with its scope."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def there():
        return {str(f.getPath()) for f in files.listStatus(hadoop)}

    draw = random.Random(12)
    docs = spark.createDataFrame([(k, prose(draw, 80) if k % 3 else "a b c d e " * 60) for k in range(60)], "doc_id long, text string")
    before = there()
    with scope():
        ngram_join.components(docs).count()
        substring_dedup.removed(docs).count()
        assert len(there() - before) == 2
    assert there() == before


# --- memory of workers ----------------------------------------------------------

@pytest.mark.parametrize("work", [
    lambda texts: sentencepiece.encode_texts(sentencepiece.model_of(sentencepiece.MODEL), list(range(len(texts))), texts, sentencepiece.Dropout()),
    lambda texts: ngram_join.shingle_table(texts, 4),
    lambda texts: [quality_rules.repeated(t.split()) for t in texts],
    lambda texts: phrases.Numbers()([w.encode() for t in texts for w in t.split()]),
], ids=["pieces", "shingles", "repeated", "phrases"])
def test_numbered_words_go_with_their_texts(work):
    """No cycle keeps them: a worker that makes few objects looks for cycles late, and would hold the words of many texts."""
    draw = random.Random(5)
    texts = [prose(draw, 60) for _ in range(20)]

    def tables() -> int:
        return sum(type(x) is defaultdict and len(x) > 0 for x in gc.get_objects())

    work(texts)
    gc.collect()
    gc.disable()
    try:
        before = tables()
        work(texts)
        assert tables() == before
    finally:
        gc.enable()


# --- n-gram join ----------------------------------------------------------------

@pytest.mark.parametrize("width", [1, 4, 5])
def test_shingles_of_many_texts_at_once_are_those_of_each(width):
    draw = random.Random(width)
    texts = [None, "", " \n", "one", "A b", "a B", "x y z", "é é é é é é"] + [prose(draw, draw.randrange(60)) for _ in range(50)] + ["a b c d e", None]
    tokens, bounds = ngram_join.shingle_table(texts, width)
    assert len(bounds) == len(texts) + 1 and bounds[0] == 0 and bounds[-1] == len(tokens)
    for text, start, end in zip(texts, bounds[:-1], bounds[1:]):
        alone = ngram_join.shingle_table([text], width)[0]
        assert tokens[start:end].tolist() == alone.tolist() == sorted(set(alone.tolist()))
        words = common.spaced_words(text)
        n = min(width, len(words))
        assert end - start == (len({tuple(words[i:i + n]) for i in range(len(words) - n + 1)}) if n else 0)


def test_prefixes_are_the_first_shingles_of_the_common_order():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(-2**62, 2**62, n)) for n in (0, 1, 7, 40, 0, 300)]
    tokens = np.unique(np.concatenate([own[::2] for own in sets]))
    rank = draw.permutation(len(tokens)) + 1
    sieve = np.zeros(ngram_join.SIEVE + 1, bool)
    sieve[tokens & ngram_join.SIEVE] = True
    flat, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(own) for own in sets])])
    places = ngram_join._places(flat, tokens, rank, sieve)
    known = dict(zip(tokens.tolist(), rank.tolist()))
    assert places.tolist() == [known.get(x, 0) for x in flat.tolist()]
    first = np.array([-(-2 * len(own) // 3) for own in sets])
    for own, n, prefix in zip(sets, first, ngram_join.prefixes_of(flat, bounds, places, first)):
        assert prefix.tolist() == sorted(own.tolist(), key=lambda x: (known.get(x, 0), x))[:n]


def test_dropping_copies_does_not_shuffle_the_texts(spark):
    draw = random.Random(5)
    text = prose(draw, 40)
    docs = spark.createDataFrame([(i, text if i % 3 else prose(draw, 40)) for i in range(30)], "doc_id long, text string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        with scope():
            kept = ngram_join.keep_one(docs)
            assert "SortMergeJoin" not in plan(kept)
            assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted([1, *range(0, 30, 3)])
    finally:
        spark.conf.set(name, before)


def test_a_round_of_stars_is_two_small_plans(spark, monkeypatch):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (1, 2), (1, 2)]
    root = {}

    def least(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = least(a), least(b)
        root[max(a, b)] = min(a, b)
    kept, keep = [], components.cut

    def seen(df):
        kept.append(plan(df).count("hashpartitioning"))
        return keep(df)

    monkeypatch.setattr(components, "cut", seen)
    with scope():
        got = components.stars(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: least(x) for x in root if least(x) != x}
    assert len(kept) > 5 and max(kept) <= 3  # nine when a round was one plan
