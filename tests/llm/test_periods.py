"""Runs of words against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import periods
from corpusmill.llm.queries import QUERIES


def plain_runs(words, min_words=24, min_powers=3):
    n, found = len(words), []
    for q in range(1, n // min_powers + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            smaller = any(all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q))
            if length >= max(min_words, min_powers * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, spans):
    dropped = {i for s, n, q in spans for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def _coded(texts):
    names = {}
    flat = [names.setdefault(w, len(names)) for t in texts for w in t]
    return np.array(flat, np.int64), np.array([len(t) for t in texts], np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=5), st.integers(1, 9), st.integers(2, 4))
def test_runs_of_random_words(texts, min_words, min_powers):
    assert periods.runs(*_coded(texts), min_words, min_powers) == [plain_runs(t, min_words, min_powers) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_planted_periods(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(20):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            q = rng.randrange(1, 40)
            cycle = [rng.choice("abcd" if rng.random() < 0.5 else "abcdefghijklm") for _ in range(q)]
            words += (cycle * 8)[: rng.randrange(1, 6 * q)] + [rng.choice("xyz") for _ in range(rng.randrange(0, 9))]
        texts.append(words)
    assert periods.runs(*_coded(texts)) == [plain_runs(t) for t in texts]


def test_a_very_long_text():
    words = ["w%d" % i for i in range(50_000)]
    words[1_000:31_000] = [f"p{i % 9_999}" for i in range(30_000)]
    words[40_000:45_000] = ["same"] * 5_000
    assert periods.runs(*_coded([words])) == [[(1_000, 30_000, 9_999), (40_000, 5_000, 1)]]


def test_nulls_empty_texts_repeats_and_clashing_columns(spark):
    loop = "a b\tc\n" * 12
    rows = [(1, None, 0, "x"), (None, "", 0, "x"), (2, " \n\x0b ", 0, "x"), (3, loop, 0, "x"), (3, loop, 0, "x"), (None, "solo", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = periods.periodic_runs(docs).collect()
    assert sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(
        [(1, 0, [], ""), (None, 0, [], ""), (2, 0, [], ""), (3, 36, [(0, 36, 3)], "a b c"), (3, 36, [(0, 36, 3)], "a b c"), (None, 1, [], "solo")],
        key=repr,
    )
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def plain_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    assert set(got) == set(texts)
    for name, text in texts.items():
        words = plain_planted(name, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if len(words) > 1_500:  # the plain search is quadratic; long texts are compared by their digests' parts below
            continue
        spans, row = plain_runs(words), got[name]
        best = min(spans, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert row.n_runs == len(spans)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in spans)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, spans).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) >= len(got) // 20
