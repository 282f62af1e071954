"""References between records: depth, cycles, dangling ids, against a plain search."""

import random
from collections import deque

import pytest

from corpusmill.operators import composite

ZERO = "0" * 16


def rid(n):
    return f"{n:016x}"


def _corpus(spark, refs):
    rows = [(rid(n), f"n{n}", "d", "body " + " ".join(f"skill:{r}" for r in named), "community", "", ["t"]) for n, named in refs.items()]
    return spark.createDataFrame(rows, "id string, name string, description string, instructions string, source string, category string, tags array<string>")


def plain(refs):
    """(root, id) -> (fewest steps, known), without walking on from a root reached again or an unknown id."""
    known, out = {rid(n) for n in refs}, {}
    graph = {rid(n): list(dict.fromkeys(named)) for n, named in refs.items()}
    for root in graph:
        queue, seen = deque([(root, 0)]), {}
        while queue:
            at, depth = queue.popleft()
            for ref in graph.get(at, []):
                if ref not in seen:
                    seen[ref] = depth + 1
                    if ref in known and ref != root:
                        queue.append((ref, depth + 1))
        out |= {(root, ref): (depth, ref in known) for ref, depth in seen.items()}
    return out


def _found(spark, refs, **options):
    corpus = _corpus(spark, refs)
    rows = composite.dependencies(composite.references(corpus), corpus.select("id"), **options).collect()
    assert len(rows) == len({(r.root, r.id) for r in rows})
    return {(r.root, r.id): (r.depth, r.known) for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_random_references(spark, seed):
    rng = random.Random(seed)
    refs = {n: [rid(rng.randrange(24)) for _ in range(rng.choice([0, 1, 1, 2]))] for n in range(20)}
    assert _found(spark, refs) == plain(refs)


def test_chains_cycles_and_unknown_ids(spark):
    refs = {1: [rid(2)], 2: [rid(3), rid(3)], 3: [rid(4)], 4: [], 5: [rid(6)], 6: [rid(5), ZERO], 7: [rid(7)], 8: [rid(5)]}
    found = _found(spark, refs)
    assert found == plain(refs)
    assert found[rid(1), rid(4)] == (3, True) and found[rid(5), rid(5)] == (2, True) and found[rid(8), ZERO] == (3, False)
    assert {k for k, (d, _) in _found(spark, refs, max_depth=1).items()} == {k for k, (d, _) in found.items() if d == 1}
    corpus = _corpus(spark, refs)
    report = composite.dependency_report(corpus.select("id"), composite.dependencies(composite.references(corpus), corpus.select("id")))
    rows = {int(r.id, 16): (r.n_needed, r.n_missing, r.depth, r.in_cycle) for r in report.collect()}
    assert rows == {1: (3, 0, 3, False), 2: (2, 0, 2, False), 3: (1, 0, 1, False), 4: (0, 0, 0, False), 5: (1, 1, 2, True),
                    6: (1, 1, 1, True), 7: (0, 0, 0, True), 8: (2, 1, 3, False)}


def test_fetch_with_dependencies(spark):
    corpus = _corpus(spark, {1: [rid(2)], 2: [rid(1), ZERO], 3: []})
    wanted = spark.createDataFrame([(rid(1),), (rid(1),), (rid(9),)], "id string")
    rows = composite.fetch_with_dependencies(corpus, wanted).collect()
    assert sorted((r.root, r.id, r.depth, r.name) for r in rows) == [(rid(1), rid(1), 0, "n1"), (rid(1), rid(2), 1, "n2")]


def test_no_references(spark):
    assert _found(spark, {1: [], 2: []}) == {}


def test_words_around_a_reference(spark):
    body = f"(skill:{rid(1)}), skill:{rid(2)}0 myskill:{rid(3)} skill:{rid(4).upper().replace('0', 'A')}"
    corpus = spark.createDataFrame([("x", body), ("y", None)], "id string, instructions string")
    assert [(r.id, r.ref, r.known) for r in composite.references(corpus).collect()] == [("x", rid(1), False)]
