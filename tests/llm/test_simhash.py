import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from corpusmill.llm import simhash
from corpusmill.llm.components import star_components
from corpusmill.llm.queries import QUERIES


def plain_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, max_bits=2):
    """id -> smallest id reachable, by comparing all pairs."""
    prints = [fp for _, fp in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        groups[find(i)].append(name)
    return [(rows[i][0], min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=repr)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = dict(plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs]))
    got = QUERIES["op10_simhash"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{plain_fingerprint(r.text):016x}" for r in docs}


def test_nulls_empty_texts_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(3, None, "a"), (1, "", "b"), (2, " \t\x0b\n", "c"), (5, "One two", "d"), (5, "one TWO", "e"), (None, "one two", "f"),
            (9, long, "g"), (8, long, "g"), (8, long, "g"), (None, "all alone here now", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert order((r.id, r.component) for r in got) == order(plain_components([(i, plain_fingerprint(t)) for i, t, _ in rows]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.where("doc_id is not null").collect())) == [1, 5, 8]
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


def _near(rng, n):
    rows = []
    for _ in range(n):
        base = rng.getrandbits(64)
        rows += [base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for _ in range(rng.randrange(1, 6))]
    return sorted({x - (1 << 64) if x >> 63 else x for x in rows})


@pytest.mark.parametrize("group_rows", [100, 16_384])
def test_links_of_random_fingerprints_with_split_groups(spark, group_rows):
    rng = random.Random(7)
    # Half of them share two of the three masks' bits, so that groups pass the small bound.
    prints = sorted(set(_near(rng, 60)) | {rng.getrandbits(18) for _ in range(150)})
    nodes = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = dict(map(tuple, star_components(simhash.links(nodes, 2, group_rows)).collect()))
    want = dict(plain_components([(x, x & (1 << 64) - 1) for x in prints]))
    assert {x: got.get(x, x) for x in prints} == want


def test_gray_rank_orders_the_reflected_code():
    codes = np.array([i ^ i >> 1 for i in range(64)], np.uint64)
    assert simhash._gray_rank(codes).tolist() == list(range(64))


def test_components_of_a_path_a_hub_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 400)] + [(5, 5), (9, 8), (8, 9), (None, 3)]
    got = dict(map(tuple, star_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(300, 400)}, 9: 8}
