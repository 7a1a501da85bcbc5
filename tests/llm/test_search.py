"""Top-k search, phrases and lexical search against brute force on small tables with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from geoflow.llm import lexical_search, phrases, threshold_search
from geoflow.llm.common import lowered
from geoflow.llm.dense import exact_product
from pyspark.sql import functions as F


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_products_are_exact():
    draw = np.random.default_rng(1)
    for most in (100, 1 << 26, 1 << 29):
        a, b = draw.integers(-most, most, (7, 9)), draw.integers(-most, most, (5, 9))
        assert (exact_product(a, b) == (a.astype(object) @ b.astype(object).T)).all()
    with pytest.raises(OverflowError):
        exact_product(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 40))


def nearest(rows, k, scale):
    rows = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows, out = list(dict.fromkeys(rows)), []
    for i, v in rows:
        if i is not None and i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for j, w in rows if (j, w) != (i, v))
            out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_threshold_search(spark, monkeypatch):
    draw = random.Random(1)
    hot = [draw.gauss(0, .3) for _ in range(6)]
    rows = [(k, [draw.gauss(0, .3) for _ in range(6)]) for k in range(400)] + [(k, hot) for k in range(400, 700)]
    rows += [(700, None), (701, [None] * 6), (750, [float("nan")] * 6), (800, []), (801, [.5] * 3), (None, hot), (None, [.1] * 6), (0, [.9] * 6),
             (850, [0.0] * 6), (50, rows[50][1]), (900, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, tile string, q int, _id int")
    expected = nearest([(r.vec_id, r.embedding) for r in df.collect()], 5, 256)
    asks = F.col("vec_id") % 50 == 0
    assert collected(threshold_search.top(df, asks)) == expected
    monkeypatch.setattr(threshold_search, "ROUND", 5)  # several rounds
    assert collected(threshold_search.top(df, asks, threshold_search.Search(lists=3))) == expected
    assert threshold_search.top(df.limit(0), asks).count() == 0 and threshold_search.top(df.where(~asks), asks).count() == 0
    few = df.where("vec_id in (50, 51)")
    assert collected(threshold_search.top(few, asks)) == nearest([(r.vec_id, r.embedding) for r in few.collect()], 5, 256)


def mined(docs, least=100, shown=2000):
    f, n, out = Counter(), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    inside = Counter()
    for (lang, w), c in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i:i + m]] = max(inside[lang, w[i:i + m]], c)
    for one in n:
        found = []
        for (lang, w), a in candidates.items():
            if lang == one and inside[lang, w] < a:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(one, r + 1, x[2].decode(), -x[1], x[3], x[4], n[one], -x[0]) for r, x in enumerate(sorted(found)[:shown])]
    return sorted(out, key=repr)


def test_phrases(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["É", "Ab", "x\x0b9", "…"]
    passages = [" ".join(draw.choice(words) for _ in range(9)) for _ in range(6)]

    def prose():
        return "".join(draw.choice(words + passages) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(draw.randint(1, 120)))

    docs = [(draw.choice(["en", "en", "de", None]), prose()) for _ in range(300)]
    docs += docs[:60] * 3 + [("fr", "x " * 3000), ("en", None), ("en", ""), ("en", " . "), ("und", "w1 w2 " * 200), ("zz", "x")]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "lang string, text string, doc_id int, phrase string, n int")
    expected = mined(docs)
    assert collected(phrases.collocations(df)) == expected and len(expected) > 100
    assert collected(phrases.collocations(df, least=300, shown=3)) == mined(docs, 300, 3)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_chunks_hold_every_phrase_once():
    draw = random.Random(2)
    text = [draw.choice([b"a", b"b", b"c", b"."]) for _ in range(5000)]
    numbers = phrases.Numbers()
    own = numbers(text)
    begin = phrases.starts(phrases.triggers(numbers.hashes[own]).tolist(), len(text))
    assert begin[0] == 0 and len(begin) > 20
    for n in range(1, 6):
        direct = Counter(tuple(text[i:i + n]) for i in range(len(text) - n + 1))
        parsed = Counter()
        for a, b in zip(begin, [*begin[1:], None]):
            chunk = text[a:None if b is None else b + phrases.OVERLAP]
            own = len(chunk) if b is None else b - a
            parsed.update(tuple(chunk[i:i + n]) for i in range(min(own, len(chunk) - n + 1)))
        assert parsed == direct


def test_a_task_sums_phrases_up_before_it_hands_them_on(monkeypatch):
    draw = random.Random(8)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(draw.choice(words) for _ in range(40)) + f". only{k} once{k} never{k}" for k in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array([lang] * 50), pa.array(texts[at:at + 50])], ["lang", "text"])
               for at, lang in ((0, "en"), (50, "de"), (100, "en"), (150, "fr"))]
    chunks = [b for batch in batches for b in phrases._parsed(iter([batch]))]
    direct = Counter((lang.as_py(), " ".join(piece.split()[i:i + n])) for batch in batches for lang, text in zip(*batch.columns)
                     for piece in text.as_py().split(".") for n in range(2, 6) for i in range(len(piece.split()) - n + 1))

    def counted(pairs, triples, longest=5):
        return [row for batch in phrases._phrases(pairs, triples, longest)(iter(chunks)) for row in zip(*batch.to_pydict().values())]

    every, none = np.full(phrases.BITS // 8, 255, np.uint8), np.zeros(phrases.BITS // 8, np.uint8)
    for most in (phrases.WORDS, 1600):  # words go beyond the lesser bound, and are numbered anew
        monkeypatch.setattr(phrases, "WORDS", most)
        rows = counted(every, every)
        assert {(lang, phrase): f for lang, phrase, f in rows} == direct and len(rows) == len(direct)
    few = {key: f for key, f in direct.items() if len(key[1].split()) == 2}
    assert {(lang, phrase): f for lang, phrase, f in counted(every, none)} == few == {(lang, phrase): f for lang, phrase, f in counted(every, None, 2)}
    monkeypatch.setattr(phrases, "PHRASE_NUMBERS", 2000)  # what is too much is handed on in parts
    total = Counter()
    for lang, phrase, f in counted(every, every):
        total[lang, phrase] += f
    assert total == direct


def ranked(docs, items, k=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)) if text else []

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    documents, length = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in items:
        found = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * documents // length
            score = sum(n * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, n in Counter(terms(text)).items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def test_lexical_search(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["É", "Ab", "x9"]
    docs = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(1, 40)))) for k in range(300)]
    docs += [(None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (900, None), (901, ""), (902, "--"), (903, "w1 " * 30000)] + [(1000 + k, "AB É; x9") for k in range(50)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(1, 60)))) for k in range(30)]
    items += [(None, "ab"), (50, None), (51, ""), (52, "never"), (7, "É é"), (7, "É é"), (60, "w3 " * 400_000)]  # the last is beyond 2^53
    a = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, item string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = ranked(docs, items)
    assert collected(lexical_search.rank(a, b)) == expected
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 5)
    assert collected(lexical_search.rank(a, b)) == expected
    assert lexical_search.rank(a.limit(0), b).count() == 0 and lexical_search.rank(a, b.limit(0)).count() == 0
