"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from corpusmill.llm import phrases
from corpusmill.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, lang string, text string, n long, phrase string, score double"


def plain(rows, min_count, top, longest, cover):
    totals, count = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i : i + size])] += 1
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= min_count}
    covered = set()
    for (lang, words), a in found.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = words[i : i + size]
                if 100 * a >= cover * count[lang, inner]:
                    covered.add((lang, inner))
    by_lang = defaultdict(list)
    for (lang, words), a in found.items():
        if (lang, words) in covered:
            continue
        n = totals[lang]
        score, cut = min((1000 * a * n // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words)))
        by_lang[lang].append((-score, -a, " ".join(words).encode(), cut, count[lang, words[:cut]], count[lang, words[cut:]], n))
    out = set()
    for lang, listed in by_lang.items():
        for rank, (score, a, phrase, cut, left, right, n) in enumerate(sorted(listed)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score, cut))
    return out


def _got(frame):
    return [tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect()]


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "中文", "co-op", "x", "\xa0y", "A\x00b"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "? ", "\v", ":", "\r\n"]
    weights = [30, 2, 2, 2, 2, 2, 1, 1, 1, 1]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choices(ends, weights)[0] for _ in range(rng.randrange(0, 40)))
        if rng.random() < 0.3:
            text += "a fixed passage of seven words here"
        rows.append((i, rng.choice(["en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize(("cover", "longest", "seed"), [(100, 5, 1), (80, 5, 2), (100, 3, 3)])
@pytest.mark.parametrize("pruned", [True, False])
def test_equals_a_plain_count(spark, monkeypatch, cover, longest, seed, pruned):
    if not pruned:
        monkeypatch.setattr(phrases, "is_small", lambda frame: False)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 2_000)
    rows = _texts(seed, 120)
    docs = spark.createDataFrame([(*r, 0, "", 0.0) for r in rows], SCHEMA).repartition(3)
    got = _got(phrases.collocations(docs, min_count=6, top=25, longest=longest, cover_percent=cover))
    assert len(got) == len(set(got))
    assert set(got) == plain([r[1:] for r in rows], 6, 25, longest, cover)


def test_nulls_empty_and_long_texts(spark):
    long = "one two three. " * 20_000
    rows = [(1, None, None), (None, "en", ""), (2, "en", " \t\n.;"), (3, None, long), (3, None, long), (4, "und", "one two three")]
    docs = spark.createDataFrame([(*r, 0, "", 0.0) for r in rows], SCHEMA)
    assert set(_got(phrases.collocations(docs))) == plain([r[1:] for r in rows], 100, 2_000, 5, 100) != set()
    assert _got(phrases.collocations(docs.where("doc_id = 2"))) == _got(phrases.collocations(docs.limit(0))) == []


def test_large_counts_stay_exact(spark):
    """Products past 64 bits: the score's arithmetic alone."""
    a, n, parts = 10**12, 10**14, 3 * 10**12
    row = spark.sql(f"SELECT CAST(1000 AS decimal(9,0)) * (CAST({a} AS decimal(19,0)) * CAST({n} AS decimal(19,0))) AS over,"
                    f" CAST({parts} AS decimal(19,0)) * CAST({parts} AS decimal(19,0)) AS under").selectExpr("over div under AS s")  # fmt: skip
    assert row.first()["s"] == 1000 * a * n // (parts * parts)


def test_words_of_a_slice():
    found = phrases.Words(pa.array(["en", None]), pa.array(["Ab c.d", "e\tF"]))
    assert found.spelt.take(pa.array(found.code)).to_pylist() == ["ab", "c", "d", "e", "f"]
    assert found.linked.tolist() == [True, False, False, True, False]
    assert found.languages.take(pa.array(found.lang)).to_pylist() == ["en"] * 3 + ["und"] * 2


def test_query_matches_sql(spark):
    link = duckdb.connect()
    link.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cursor = link.execute(ORACLES["op11_phrases"])
    names = [d[0] for d in cursor.description]
    got = QUERIES["op11_phrases"](spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(got.columns)
    assert {tuple(r) for r in got.select(*names).collect()} == set(cursor.fetchall())


def test_rare_grams_are_left_out_before_they_are_shuffled(spark, monkeypatch):
    # Every word and most pairs are frequent, longer grams are not, but for one phrase of six words.
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(20)}" for _ in range(60)) + ". one two three four five six." for _ in range(80)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    frames, real = [], phrases._summed
    monkeypatch.setattr(phrases, "_summed", lambda rows: (frames.append(rows), real(rows))[1])
    monkeypatch.setattr(phrases, "SLICE_BYTES", 2_000)
    got = _got(phrases.collocations(docs, min_count=40, top=2_000, longest=5))
    assert set(got) == plain([("en", t) for t in texts], 40, 2_000, 5, 100) != set()
    edges = frames[1].select("phrase").distinct().count()
    # 20 words make nearly 5,000 grams of five words here.
    assert edges < 20 + 20 * 20 + 50


@pytest.mark.parametrize("bound", [0, 1, 300, 70_000])
def test_marks_hold_whatever_reaches_the_bound(spark, bound):
    docs = spark.createDataFrame([("en", "a b a b. c d")] * 700, "lang string, text string").repartition(2)
    words = spark.sparkContext.broadcast({"en": (0, pa.array(["a", "b", "c", "d"], pa.large_string()))})
    marks = phrases._marks(docs, words, bound, [2], phrases.FEWEST_BITS).value
    held = {}
    found = phrases.Words(pa.array(["en"]), pa.array(["a b a b. c d"]))
    number = found.numbers(words.value)
    for _, at, key in phrases._hashed(number, found.room(found.linked_by(number)), 2):
        held = dict(zip(at.tolist(), marks.hold(key).tolist(), strict=True))
    # a b 1,400 times, b a and c d 700 times.
    assert held == {0: bound <= 1400, 1: bound <= 700, 2: bound <= 1400, 4: bound <= 700}
