import random
import re
from collections import Counter

from corpusmill.llm import quality
from corpusmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def check(got, texts):
    for row in got:
        n, chars, symbols, dup, repeat = plain_measures(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert row.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (row.base_failed and row.kept)


def test_query_equals_brute_force_and_tells_labels_apart(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_quality_rules"](spark, SF).collect()
    assert len(got) == len(texts)
    check(got, texts)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good)


def test_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\x0c\r", "ü 😀 a", "a\n\na\nb\n b\nb", "x " * 40, " ".join(rng.choice("abc") for _ in range(400)), "w\u00a0w " * 9]
    texts.append(" ".join(f"t{i}" for i in range(500)) + " " + " ".join(f"t{i}" for i in range(20, 31)))
    texts.append(" ".join(str(i) for i in range(30_000)))
    rows = [(i, t, None, 1) for i, t in enumerate(texts)] + [(0, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    check(got, dict(enumerate(texts)))
    assert all(r.kept != r.base_failed for r in got)  # no labels of both kinds: an empty list
    assert quality.judge(docs.limit(0), labels.limit(0)).collect() == []


def test_list_learns_conjunctions():
    rng = random.Random(1)
    cells = []
    for a in range(4):
        for b in range(4):
            bad = a >= 2 and b < 2
            n = rng.randrange(20, 40)
            kinds = ("bad", "good") if bad else ("good", "bad")
            cells.append({"symbols_per_word": a, "words": b, f"{kinds[0]}_grow": 2 * n, f"{kinds[0]}_prune": n, f"{kinds[1]}_grow": 0, f"{kinds[1]}_prune": 0})
    found = quality.learn_from_cells(cells, {"symbols_per_word": [1.0, 2.0, 3.0], "words": [10.0, 20.0, 30.0]}, 0.9)
    assert sorted(map(str, found.rules[0])) == ["symbols_per_word > 2", "words <= 20"]
    assert len(found.rules) == 1
