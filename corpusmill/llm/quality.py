"""Quality rules: exact text measures and a learned decision list, all in built-in expressions.

The list is learned by sequential covering. Labelled rows are summed per cell of a fixed grid of thresholds, so what the
driver sees is bounded by the grid and not by the corpus, and covers every labelled row. A rule is a
conjunction of threshold tests, grown on one part of the labels by information gain and pruned on the other; the ordered
rules become one conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Quantiles of a feature that serve as thresholds: at most this many cells per feature plus one.
QUANTILES = [0.005, 0.02, 0.05, 0.15, 0.5, 0.85, 0.95, 0.98, 0.995]
FEATURES = {
    "chars_per_word": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines").cast("double"),
    "words": lambda: F.col("n_words").cast("double"),
}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and the five counts (long) over the whole text.

    Words are runs of characters outside ``SPACE``; null and empty texts have none. A line counts as repeated if it holds
    a word and equals an earlier line. Windows of eight words are compared by 64-bit hashes. The work of a row
    is n log n in its length. Other columns are dropped.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with_word = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    rows = rows.select(
        id_col,
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        with_word.alias("_lines"),
    )
    n = F.size("_words")
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    rows = rows.select(
        id_col,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    # Only texts with some window twice go on: sorted, equal hashes stand side by side.
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("_placed", F.when(twice, placed).otherwise(none)).drop("_hashes")
    neighbours = F.zip_with(
        F.slice("_placed", 1, F.greatest(F.size("_placed") - 1, F.lit(0))),
        F.slice("_placed", 2, F.greatest(F.size("_placed") - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    rows = rows.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(neighbours)))).drop("_placed")
    gaps = F.zip_with(
        F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))),
        F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    covered = F.when(F.size("_at") > 0, F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g)).otherwise(F.lit(0))
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """Too short, or too much of the text inside repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions in order; a row that one of them covers is rejected, the rest is kept."""

    rules: tuple[tuple[Test, ...], ...]

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            covers = rule[0].column()
            for test in rule[1:]:
                covers = covers & test.column()
            out = F.when(covers, F.lit(False)) if out is None else out.when(covers, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "; ".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules) or "keep all"


def _cells(labelled: DataFrame, thresholds: dict[str, list[float]]) -> list[dict]:
    """Counts of good and bad labels, for growing and pruning, per cell of the threshold grid."""
    level = {}
    for name, cuts in thresholds.items():
        value, bin_no = FEATURES[name](), F.lit(0)
        for cut in cuts:
            bin_no = bin_no + (value > cut).cast("int")
        level[name] = bin_no
    grow = F.col("_grow")
    counts = [
        F.count_if((F.col("_good") == good) & (grow == part)).alias(f"{kind}_{stage}")
        for good, kind in ((1, "good"), (0, "bad"))
        for part, stage in ((True, "grow"), (False, "prune"))
    ]
    cells = labelled.groupBy(*[column.alias(name) for name, column in level.items()]).agg(*counts)
    return [row.asDict() for row in cells.collect()]


def _covered(cell: dict, rule: Sequence[tuple[str, bool, int]]) -> bool:
    return all((cell[name] > at) == above for name, above, at in rule)


def _counts(cells: list[dict], rule: Sequence, stage: str) -> tuple[int, int]:
    inside = [c for c in cells if _covered(c, rule)]
    return sum(c[f"bad_{stage}"] for c in inside), sum(c[f"good_{stage}"] for c in inside)


def _purity(bad: int, good: int) -> float:
    return math.log2((bad + 1) / (bad + good + 2))


def learn_from_cells(
    cells: list[dict], thresholds: dict[str, list[float]], min_precision: float, max_rules: int = 16, max_tests: int = 4
) -> DecisionList:
    """Sequential covering: grow by information gain, prune from the end, drop what the rule covers, go on."""
    options = [(name, above, at) for name, cuts in thresholds.items() for at in range(len(cuts)) for above in (True, False)]
    rules: list[tuple[Test, ...]] = []
    left = list(cells)
    while len(rules) < max_rules:
        rule: list[tuple[str, bool, int]] = []
        inside = left
        while len(rule) < max_tests:
            bad, good = _counts(inside, (), "grow")
            if not bad or not good:
                break

            def gain(option, inside=inside, bad=bad, good=good):
                b, g = _counts(inside, [option], "grow")
                return b * (_purity(b, g) - _purity(bad, good))

            best = max(options, key=lambda option: (gain(option), option))
            if gain(best) <= 1e-9:
                break
            rule.append(best)
            inside = [c for c in inside if _covered(c, [best])]

        def worth(tests):
            bad, good = _counts(left, tests, "prune")
            return (bad + 1) / (bad + good + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        bad = sum(_counts(left, rule, stage)[0] for stage in ("grow", "prune"))
        good = sum(_counts(left, rule, stage)[1] for stage in ("grow", "prune"))
        if not rule or not bad or bad < min_precision * (bad + good) or worth(rule) < min_precision - 0.05:
            break
        rules.append(tuple(Test(name, above, thresholds[name][at]) for name, above, at in rule))
        left = [c for c in left if not _covered(c, rule)]
    return DecisionList(tuple(rules))


def learn(
    measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", min_precision: float = 0.95
) -> DecisionList:
    """A list learned from rows whose label is 0 (bad) or 1 (good); other and null labels are left out.

    An id with several labels counts as good if one of them is. Rows that fail the base rules take no part. Without
    labels of both kinds the list is empty and keeps everything.
    """
    label = F.col(label_col).cast("int")
    one = labels.where(label.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_good"))
    labelled = measured.where(~base_failed()).join(one, id_col).withColumn(
        "_grow", F.crc32(F.concat(F.lit("grow"), F.col(id_col).cast("string"))) % 3 != 0
    )
    labelled = materialize(labelled.select("_good", "_grow", *MEASURES), "labelled")
    quantiles = labelled.agg(*[F.percentile_approx(f(), QUANTILES, 10_000).alias(name) for name, f in FEATURES.items()]).first()
    thresholds = {name: sorted(set(quantiles[name] or [])) for name in FEATURES}
    return learn_from_cells(_cells(labelled, thresholds), thresholds, min_precision)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_precision: float = 0.95) -> DataFrame:
    """id_col, the measures, base_failed and kept for every row; base rules decide first, then the learned list."""
    measured = materialize(measures(docs, id_col, text_col), "measures")
    rules = learn(measured, labels, id_col, min_precision=min_precision)
    return measured.select(
        id_col, *MEASURES, base_failed().alias("base_failed"), (~base_failed() & rules.kept()).alias("kept")
    )
