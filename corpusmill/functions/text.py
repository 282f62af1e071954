"""Column expressions on text: trimming, front matter, tags, categories, search tokens."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.schema import GROUP_DIRECTORIES

FENCE = "---"
# Unicode whitespace plus the four separator controls that \s leaves out.
SPACE = r"[\s\x1c-\x1f]+"
TOKEN_BREAK = r"[^\p{L}\p{N}\p{M}\p{Co}]+"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)\A{SPACE}", ""), rf"(?U){SPACE}\z", "")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def _closing_fence(stripped: Column) -> Column:
    """Position of the second fence, which may stand anywhere; 0 without a leading one."""
    return F.when(F.startswith(stripped, F.lit(FENCE)), F.locate(FENCE, stripped, 4)).otherwise(0)


def front_matter(stripped: Column) -> Column:
    """The block between the fences of an already stripped text, null when there is none."""
    close = _closing_fence(stripped)
    return F.when(close > 0, strip(F.substring(stripped, F.lit(4), close - 4)))


def front_matter_body(stripped: Column) -> Column:
    """What follows the closing fence, trimmed; null when there is no front matter."""
    close = _closing_fence(stripped)
    return F.when(close > 0, strip(F.substring(stripped, close + 3, F.length(stripped))))


def clean_tags(tags: Column) -> Column:
    """Trim each tag and drop the empty ones."""
    return F.array_remove(F.transform(tags, strip), "")


def split_tags(text: Column) -> Column:
    """Tags written as one comma-separated string."""
    return clean_tags(F.split(text, ",", -1))


def path_parts(relative: Column) -> Column:
    return F.split(relative, "/", -1)


def category_by_parent(path: Column) -> Column:
    """The record's own directory."""
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(-2)), F.lit(""))


def category_by_group(relative: Column) -> Column:
    """The first recognised grouping directory on the way down, else the record's own directory."""
    parents = F.slice(path_parts(relative), 1, F.size(path_parts(relative)) - 1)
    known = F.filter(parents, lambda part: part.isin(GROUP_DIRECTORIES))
    return F.coalesce(F.get(known, F.lit(0)), category_by_parent(relative))


def category_by_grouping_level(relative: Column) -> Column:
    """The directory above the record's own, a leading "skills/" not counted."""
    inner = F.regexp_replace(relative, r"\Askills/", "")
    return F.coalesce(F.try_element_at(path_parts(inner), F.lit(-3)), F.lit(""))


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Letters that decompose to one base letter plus marks, with that letter; marks alone map to nothing."""
    accented, base, marks = [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if unicodedata.category(char) == "Mn" and unicodedata.combining(char):
            if 0x0300 <= point <= 0x036F:
                marks.append(char)
            continue
        if not unicodedata.decomposition(char) or unicodedata.decomposition(char).startswith("<"):
            continue
        parts = unicodedata.normalize("NFD", char)
        letters = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(letters) == 1 and letters[0] != char and char.lower() == char:
            accented.append(char)
            base.append(letters[0])
    return "".join(accented + marks), "".join(base)


def tokens(text: Column) -> Column:
    """Search tokens: lower case, accents folded, broken at anything but letters, digits and marks."""
    folded = F.translate(F.lower(text), *_accent_map())
    return F.array_remove(F.split(folded, TOKEN_BREAK, -1), "")
