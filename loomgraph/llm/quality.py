"""Quality rules: base counts, and repetition measured on a suffix array of words."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the base rules.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Words that are put into one suffix array; a longer text has one of its own.
BATCH_WORDS = 400_000


def suffix_ranks(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of `tokens` by prefix doubling, and the ranks of all prefixes of 1, 2, 4, ... tokens.

    Two positions have one rank in list entry k if their first 2**k tokens are equal. Each text in `tokens` must end in a
    token that occurs once, so no suffix group reaches beyond its text. Only groups of two or more are sorted on.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    key = tokens[order]
    start = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    levels, step = [rank], 1
    open_at = np.flatnonzero(~start | ~np.r_[start[1:], True])
    while len(open_at):
        own = order[open_at]
        key = rank[own] * n + rank[own + step]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[open_at] = own
        start = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(start, open_at, 0))
        levels.append(rank)
        open_at = open_at[~start | ~np.r_[start[1:], True]]
        step *= 2
    return order, levels


def repeat_lengths(tokens: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that starts there and occurs elsewhere too.

    That is the deepest longest-common-prefix interval the suffix is in: the larger common prefix with its
    neighbours in suffix order, measured by descending the doubling ranks.
    """
    order, levels = suffix_ranks(tokens)
    common = np.zeros(len(order) + 1, np.int64)
    if len(order) > 1:
        pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
        one, other, length = order[pair], order[pair + 1], np.zeros(len(pair), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][one + length] == levels[k][other + length]
            length[same] += 1 << k
        common[pair + 1] = length
    longest = np.empty(len(order), np.int64)
    longest[order] = np.maximum(common[:-1], common[1:])
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def repetition(texts: list[list[bytes]], min_words: int) -> list[tuple[int, int, int]]:
    """Per text: words in 3-word windows found twice, words covered by repeats of `min_words` or more, longest repeat."""
    ids: dict[bytes, int] = {}
    fresh = itertools.count()
    sizes = np.array([len(words) for words in texts], np.int64)
    tokens = np.fromiter(itertools.chain.from_iterable(map(ids.setdefault, words, fresh) for words in texts), np.int64, int(sizes.sum()))
    # one row of words per text and a closing token of its own after each
    ends = np.cumsum(sizes + 1) - 1
    joined = np.empty(len(tokens) + len(texts), np.int64)
    is_word = np.ones(len(joined), bool)
    is_word[ends] = False
    text_of = np.repeat(np.arange(len(texts)), sizes)
    joined[is_word] = text_of * (1 << 32) + tokens
    joined[ends] = -1 - np.arange(len(texts))
    longest = repeat_lengths(joined)
    windows = np.flatnonzero(longest >= 3)
    in_window = _covered(windows, np.full(len(windows), 3), len(joined))
    # maximal repeats: those that a repeat from the position before doesn't contain
    inner = np.r_[False, longest[:-1] >= longest[1:] + 1]
    spans = np.flatnonzero((longest >= min_words) & ~inner)
    in_repeat = _covered(spans, longest[spans], len(joined))
    begins = np.r_[0, ends[:-1] + 1]
    total = lambda flags: np.diff(np.r_[0, np.cumsum(flags)[ends]])
    most = np.maximum.reduceat(longest, begins)
    return list(zip(total(in_window).tolist(), total(in_repeat).tolist(), most.tolist()))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 8, max_covered: float = 0.3, max_longest: int = 127) -> DataFrame:
    """Counts and verdict for each row: doc_id, the base counts, covered_words, longest_repeat, base_failed, kept.

    A document is kept if it passes the base rules, repeats of `min_repeat` words or more cover at most `max_covered` of its
    words, and no repeat is longer than `max_longest` words. A null or empty text has no words and fails the base. Repeated
    rows give repeated results; columns of `docs` other than the two are ignored.
    """

    def measure(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows(texts))] or [pa.array([], pa.int64())] * len(_FIELDS), _FIELDS)

    def rows(texts: pa.Array) -> Iterator[tuple[int, ...]]:
        base, words, held = [], [], 0
        for value in texts:
            text = value.as_py() or ""
            split = text.encode("utf-8", "surrogatepass").split()
            base.append(base_counts(text, split))
            words.append(split)
            held += len(split)
            if held >= BATCH_WORDS:
                yield from (b + r for b, r in zip(base, repetition(words, min_repeat)))
                base, words, held = [], [], 0
        if base:
            yield from (b + r for b, r in zip(base, repetition(words, min_repeat)))

    measured = F.arrow_udf(measure, ", ".join(f"{f} long" for f in _FIELDS))
    counted = docs.select(F.col(id_col).alias("doc_id"), measured(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    repeats = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & repeats)


def _doubled(k: int) -> str:
    return f"h{2 * k} AS (SELECT *, md5(h{k} || lead(h{k}, {k}) OVER (PARTITION BY doc_id ORDER BY i)) AS h{2 * k} FROM h{k})"


#: Repeats of 8 words or more cover what 8-word windows found twice cover; one longer than 127 words has such a window of 128.
QUALITY_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
h1 AS (SELECT doc_id, generate_subscripts(words, 1) AS i, md5(unnest(words)) AS h1 FROM split),
{", ".join(_doubled(k) for k in (1, 2, 4, 8, 16, 32, 64))},
h3 AS (SELECT *, md5(h2 || lead(h1, 2) OVER (PARTITION BY doc_id ORDER BY i)) AS h3 FROM h128),
found AS (
  SELECT doc_id, i, h3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h3) > 1 AS r3, h8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h8) > 1 AS r8,
    h128 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h128) > 1 AS r128 FROM h3),
inside AS (
  SELECT doc_id, r128, bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS c3, bool_or(r8) OVER (PARTITION BY doc_id ORDER BY i ROWS 7 PRECEDING) AS c8 FROM found),
repeats AS (SELECT doc_id, count_if(c3) AS n_repeat_words, count_if(c8) AS covered, bool_or(r128) AS long FROM inside GROUP BY doc_id),
counts AS (
  SELECT split.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered, 0) AS covered, coalesce(long, false) AS long
  FROM split LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered <= 0.3::DOUBLE * n_words AND NOT long AS kept
FROM counts
"""
