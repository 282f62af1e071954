"""Staged matching of two snapshots, and the quality score."""

import random

import pytest

from corpusmill.operators import quality_score
from corpusmill.operators.snapshot_diff import COMPARED, diff_summary, snapshot_diff

FIELDS = ["id", *COMPARED]
SCHEMA = ", ".join(f"{c} {'array<string>' if c == 'tags' else 'string'}" for c in FIELDS)


def _row(key, **fields):
    base = {"id": key, "name": f"n-{key}", "description": "d", "content_hash": f"h-{key}", "source": "s", "source_id": "", "category": "c", "tags": ["t"]}
    return tuple({**base, **fields}[c] for c in FIELDS)


def _diff(spark, old, new):
    rows = snapshot_diff(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA))
    return rows, sorted(map(tuple, rows.collect()), key=repr)


def test_every_status(spark):
    old = [_row("same"), _row("edited"), _row("a-moved"), _row("reworked"), _row("gone", name=None, content_hash=None)]
    new = [
        _row("same"),
        _row("edited", description=None, tags=["t", "u"]),
        _row("b-moved", content_hash="h-a-moved", name="other"),
        _row("reworked2", name="n-reworked", content_hash="x"),
        _row("fresh", name=None, content_hash=None),
    ]
    rows, got = _diff(spark, old, new)
    assert got == sorted([
        ("unchanged", "same", "same", ""), ("updated", "edited", "edited", "description,tags"), ("moved", "a-moved", "b-moved", "name"),
        ("rewritten", "reworked", "reworked2", "content_hash"), ("removed", "gone", None, ""), ("new", None, "fresh", ""),
    ], key=repr)
    assert {r.status: r.n_records for r in diff_summary(rows).collect()} == dict.fromkeys(["unchanged", "updated", "moved", "rewritten", "removed", "new"], 1)


def plain(old, new):
    old, new, out = {r[0]: r for r in old}, {r[0]: r for r in new}, []
    changed = lambda a, b: ",".join(c for c, x, y in zip(FIELDS[1:], a[1:], b[1:], strict=True) if x != y)
    for name in sorted(set(old) & set(new)):
        fields = changed(old[name], new[name])
        out.append(("updated" if fields else "unchanged", name, name, fields))
    left = [r for i, r in sorted(old.items()) if i not in new], [r for i, r in sorted(new.items()) if i not in old]
    for column, status in ((FIELDS.index("content_hash"), "moved"), (FIELDS.index("name"), "rewritten")):
        taken = set(), set()
        for key in {r[column] for r in left[0]} - {None}:
            for a, b in zip(*([r for r in side if r[column] == key] for side in left)):
                out.append((status, a[0], b[0], changed(a, b)))
                taken[0].add(a[0])
                taken[1].add(b[0])
        left = [r for r in left[0] if r[0] not in taken[0]], [r for r in left[1] if r[0] not in taken[1]]
    return sorted(out + [("removed", r[0], None, "") for r in left[0]] + [("new", None, r[0], "") for r in left[1]], key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_groups_pair_in_order(spark, seed):
    rng = random.Random(seed)
    side = lambda letter: [_row(f"{rng.choice('xy' + letter)}{i}", content_hash=rng.choice(["hot", "h1", "h2", None]), name=rng.choice(["n1", "n2", None])) for i in range(25)]
    old, new = side("a"), side("b")
    assert _diff(spark, old, new)[1] == plain(old, new)


def test_empty_sides(spark):
    assert _diff(spark, [], [_row("a")])[1] == [("new", None, "a", "")]
    assert _diff(spark, [], [])[1] == []


def test_quality_counts_length_within_its_source(spark):
    rows = [(f"a{i}", "x" * (10 * i), "anthropic", ["t"] * 3) for i in range(1, 9)] + [(f"s{i}", "x" * (1_000 * i), "skillnet", []) for i in range(1, 9)]
    rows += [("empty", "", "community", None), ("odd", "x", "unheard of", ["t"])]
    corpus = spark.createDataFrame(rows, "id string, instructions string, source string, tags array<string>")
    got = {r.id: r.quality for r in quality_score.with_quality(corpus).collect()}
    assert len(got) == len(rows)
    assert got["a8"] == 1.0 and got["a1"] == pytest.approx(0.5 / 7 + 0.5, abs=1e-6)
    assert got["s8"] == pytest.approx(0.5 + 0.3 / 4) and got["s1"] < got["s4"] < got["s8"]
    assert got["empty"] == pytest.approx(0.3 * 3 / 4) and got["odd"] == pytest.approx(0.5 + 0.2 / 3, abs=1e-6)
    assert {r.id for r in quality_score.of_quality(corpus, 0.99).collect()} == {"a7", "a8"}
