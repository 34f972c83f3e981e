"""All occurrences of many names in a text, in one pass of an Aho-Corasick automaton."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

HITS = "array<struct<name: string, start: int, end: int, outer: boolean>>"
_HITS = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("outer", pa.bool_())]))
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# What may not touch an ASCII name (text in lower case), before it and after it.
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz_-")
_SHORT = _ALNUM | frozenset("_+.#-")
_LONG_BEFORE = _ALNUM | frozenset("_-")
#: any: every occurrence. word: no letter or digit touches. tech: names of one or two characters stand free of `_+.#-` too; digits may
#: follow longer ones (a version), a hyphen may not touch them.
RULES = ("any", "word", "tech")


class Automaton:
    """ASCII names are found in any case of A-Z and by a rule on what touches them, others as they are written, anywhere."""

    def __init__(self, names: Iterable[str], rule: str):
        if rule not in RULES:
            raise ValueError(f"rule: one of {RULES}")
        by_key: dict[str, list[str]] = {}
        for name in sorted({n for n in names if n}):
            by_key.setdefault(name.translate(_FOLD), []).append(name)
        self.rule, self.tree = rule, ahocorasick.Automaton()
        for key, same in by_key.items():
            self.tree.add_word(key, (len(key), same))
        if by_key:
            self.tree.make_automaton()

    def stands(self, text: str, start: int, end: int) -> bool:
        """Whether what touches an ASCII name lets it count."""
        if self.rule == "any":
            return True
        if self.rule == "word":
            before = after = _ALNUM
        elif end - start <= 2:
            before = after = _SHORT
        else:
            before, after = _LONG_BEFORE, _LETTERS
        return not (start and text[start - 1] in before) and not (end < len(text) and text[end] in after)

    def hits(self, text: str) -> list[tuple[str, int, int]]:
        """(name, start, end) of every occurrence, overlapping ones too, by start, longest first."""
        if not len(self.tree):
            return []
        folded, found = text.translate(_FOLD), []
        for last, (size, names) in self.tree.iter(folded):
            start, end = last + 1 - size, last + 1
            for name in names:
                if self.stands(folded, start, end) if name.isascii() else text.startswith(name, start):
                    found.append((name, start, end))
        return sorted(found, key=lambda h: (h[1], -h[2], h[0]))


def marked(hits: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """Each hit with whether no longer one covers it; hits as `Automaton.hits` orders them."""
    out, reach, last = [], -1, None
    for hit in hits:
        outer = hit[2] > reach or hit[1:] == last
        if outer:
            reach, last = hit[2], hit[1:]
        out.append((*hit, outer))
    return out


def _arrow(rows: Iterable[list[tuple]]) -> pa.Array:
    """Lists of hits as Arrow."""
    ends, flat = [0], []
    for hits in rows:
        flat.extend(hits)
        ends.append(len(flat))
    columns = [pa.array([h[i] for h in flat], field.type) for i, field in enumerate(_HITS.value_type)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_HITS.value_type)))


class Dictionary:
    """Names sent to the executors once. Each worker builds their automaton at first use."""

    _built: dict[str, Automaton] = {}

    def __init__(self, names: Iterable[str], rule: str = "word"):
        self.key, self.rule = uuid.uuid4().hex, rule
        self.sent = SparkSession.active().sparkContext.broadcast(sorted(set(names)))

    def automaton(self) -> Automaton:
        if self.key not in self._built:
            self._built.clear()
            self._built[self.key] = Automaton(self.sent.value, self.rule)
        return self._built[self.key]

    def found(self, text: Column) -> Column:
        """Hits in a text by start, longest first; none in a null one. Starts count from 0."""

        def search(texts: pa.Array) -> pa.Array:
            tree = self.automaton()
            return _arrow(marked(tree.hits(t.as_py() or "")) for t in texts)

        return F.arrow_udf(search, HITS)(text)


def marked_again(hits: Column) -> Column:
    """Hits of several dictionaries in one text, put in order and marked as those of one."""

    def mark(lists: pa.Array) -> pa.Array:
        rows = ([(h["name"], h["start"], h["end"]) for h in x.as_py() or ()] for x in lists)
        return _arrow(marked(sorted(hits, key=lambda h: (h[1], -h[2], h[0]))) for hits in rows)

    return F.arrow_udf(mark, HITS)(hits)
