"""Words of proficiency and years of experience in evidence sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Markers in order, years as they are written, how much evidence is read, the largest number of years.
MARKERS = ("了解", "熟悉", "掌握", "熟练", "深入理解", "扎实", "精通")
YEARS = (r"(\d{1,2})\s*[-~至]\s*\d{1,2}\s*年", r"(\d{1,2})\s*年(?:以上|及以上)?")
MOST_SENTENCES, MOST_CHARS, MOST_YEARS = 6, 300, 15


def read(sentences: Column) -> Column:
    """What of a list of sentences is read: the first few, cut, as one text."""
    return F.array_join(F.transform(F.slice(sentences, 1, MOST_SENTENCES), lambda s: F.substring(s, 1, MOST_CHARS)), " ")


def markers(text: Column, words: tuple[str, ...] = MARKERS) -> Column:
    """The markers in a text, in the order of the list."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def year_hints(text: Column, patterns: tuple[str, ...] = YEARS) -> Column:
    """Years as a text writes them, by pattern, then place, without repeats."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))


def most_years(hints: Column, most: int = MOST_YEARS) -> Column:
    """The largest number in the hints, at most `most`; null without any."""
    numbers = F.transform(F.flatten(F.transform(hints, lambda h: F.regexp_extract_all(h, F.lit(r"\d{1,2}"), F.lit(0)))), lambda n: n.cast("int"))
    return F.when(F.size(numbers) > 0, F.least(F.array_max(numbers), F.lit(most)))


def gated(code: Column, found: Column, all_gated: bool = False, soft: str = "F-") -> Column:
    """Whether a skill is settled as unknown without a judge: no marker, and all are gated or it is a soft skill."""
    return (F.size(found) == 0) & (F.lit(all_gated) | F.coalesce(F.startswith(code, F.lit(soft)), F.lit(False)))
