"""URL filters: host and pattern rules found through an index from rare literal tokens.

Every rule is filed under that of its literal tokens which the URLs at hand hold least often. The tokens of a URL
fetch the rules filed under them, and only those run their regular expression. A rule without a whole literal
token is filed under the empty token, which every URL has.

Everything is DataFrame work: distinct URLs are judged once and joined back, so a URL that makes up a third of
all rows is one row until the last join, whose large side adaptive execution splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return "^(?:[^/]*\\.)?" + _quoted(self.text)

    def tokens(self) -> list[str]:
        # The path may end inside a token of the URL: such a last token is not whole.
        return _whole(_lower(self.text), True, not re.search("[A-Za-z0-9]$", self.text))


@dataclass(frozen=True)
class PatternRule:
    """A pattern over the whole URL, A-Z lower-cased: ``*`` is any run, ``^`` one character that is no letter or
    digit, or an end of the URL."""

    text: str
    verdict: str

    def regex(self) -> str:
        parts = re.split(r"([*^])", _lower(self.text))
        return "".join({"*": "[\\s\\S]*", "^": "(?:[^a-z0-9]|^|$)"}.get(p) or _quoted(p) for p in parts)

    def tokens(self) -> list[str]:
        found: list[str] = []
        parts = re.split(r"([*^])", _lower(self.text))
        for i, part in enumerate(parts):
            if part not in ("*", "^"):
                found += _whole(part, parts[i - 1] == "^" if i else False, parts[i + 1 : i + 2] == ["^"])
        return found


def _lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def _whole(text: str, open_left: bool, open_right: bool) -> list[str]:
    """Tokens of a literal that are whole tokens of any URL that holds it."""
    return [
        m[0]
        for m in TOKEN.finditer(text)
        if (m.start() > 0 or open_left) and (m.end() < len(text) or open_right)
    ]


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.concat(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"), F.array(F.lit(""))))


def _rules(spark: SparkSession, rules: Iterable[SiteRule | PatternRule]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(isinstance(r, SiteRule)).alias("site"),
            F.lit(r.text).alias("text"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.regex()).alias("regex"),
            F.array(*[F.lit(t) for t in sorted(set(r.tokens())) or [""]]).alias("tokens"),
        )
        for i, r in enumerate(rules)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def token_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule once, under that of its tokens which the ``url`` rows hold least often."""
    filed = rules.withColumn("token", F.explode("tokens")).drop("tokens")
    wanted = broadcast_if_small(filed.select("token").distinct())
    held = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(wanted, "token").groupBy("token").count()
    counted = filed.join(held, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")
    return counted.groupBy("rule_no", "site", "text", "verdict", "regex").agg(rarest)


def judged_urls(urls: DataFrame, rules: list[SiteRule | PatternRule], default: str = "allow") -> DataFrame:
    """Every distinct non-null ``url`` that some rule fits: url, rule, pattern, verdict.

    The longest site rule wins, ties by its text; then the longest pattern; a URL that only a pattern fits has a null rule.
    """
    urls = urls.where(F.col("url").isNotNull()).select("url").distinct()
    index = broadcast_if_small(token_index(urls, _rules(urls.sparkSession, rules)))
    site = F.concat(url_host(F.col("url")), url_path(F.col("url")))
    subject = F.when(F.col("site"), site).otherwise(F.translate("url", UPPER, LOWER))
    fetched = urls.withColumn("token", F.explode(_tokens(F.col("url")))).join(index, "token")
    fits = fetched.where(F.call_function("rlike", subject, F.col("regex")))
    best = F.max(F.struct(F.col("site"), F.length("text").alias("size"), F.col("text"), F.col("verdict"))).alias("best")
    pattern = F.max(F.when(~F.col("site"), F.struct(F.length("text").alias("size"), F.col("text")))).alias("pattern")
    return fits.groupBy("url").agg(best, pattern).select(
        "url",
        F.when(F.col("best.site"), F.col("best.text")).alias("rule"),
        F.col("pattern.text").alias("pattern"),
        F.col("best.verdict").alias("verdict"),
    )


def judge(pages: DataFrame, rules: list[SiteRule | PatternRule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns, with host, path, rule, pattern and verdict; columns of those names are replaced.

    A null URL or one without ``://`` has an empty host and path, which no site rule fits. What no rule fits gets
    the default verdict. Repeated rows are judged alike. Without rules every row gets the default.
    """
    url = F.col(url_col).cast("string")
    out = pages.withColumns({"_judged_url": url})
    made = {"rule": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string"), "verdict": F.lit(default)}
    if rules:
        verdicts = judged_urls(pages.select(url.alias("url")), rules, default).select(
            F.col("url").alias("_judged_url"), F.struct("rule", "pattern", "verdict").alias("_judged")
        )
        out = out.join(verdicts, "_judged_url", "left")
        made = {name: F.col(f"_judged.{name}") for name in ("rule", "pattern")}
        made["verdict"] = F.coalesce("_judged.verdict", F.lit(default))
    made = {"host": url_host(F.col("_judged_url")), "path": url_path(F.col("_judged_url")), **made}
    keep = [F.col(c) for c in pages.columns if c not in made]
    return out.select(*keep, *[column.alias(name) for name, column in made.items()])
