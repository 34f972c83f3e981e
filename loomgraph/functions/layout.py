"""Lines and sections of a text with their places, counted in characters from 0."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F

SPANS = "array<struct<text: string, start: int, end: int, section: string>>"
_SPANS = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("section", pa.string())]))


def _lines(text: str) -> Iterator[tuple[str, int]]:
    """Lines without what surrounds their text, and where that begins."""
    at = 0
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        yield bare, at + len(line) - len(line.lstrip()) if bare else at
        at += len(line)


def _column(split, text: Column) -> Column:
    def each(texts: pa.Array) -> pa.Array:
        keys = ("text", "start", "end", "section")
        return pa.array([[dict(zip(keys, x)) for x in split(t.as_py() or "")] for t in texts], _SPANS)

    return F.arrow_udf(each, SPANS)(text)


def lines(text: Column, headings: Sequence[str], opening: str) -> Column:
    """Lines with text, each with the heading above it (`opening` before the first); headings are no lines. Null: none."""
    known = frozenset(headings)

    def split(value: str) -> Iterator[tuple]:
        section = opening
        for bare, start in _lines(value):
            if bare in known:
                section = bare
            elif bare:
                yield bare, start, start + len(bare), section

    return _column(split, text)


def sections(text: Column, headings: Sequence[str], opening: str) -> Column:
    """Ranges between headings that are whole lines without surrounding blanks: from behind the heading's line to the next one.

    What stands before the first heading is `opening`, unless a heading begins the text. The text of a range isn't repeated here.
    """
    known = frozenset(headings)

    def split(value: str) -> Iterator[tuple]:
        marks, at = [], 0
        for line in value.split("\n"):
            if line in known:
                marks.append((at, line))
            at += len(line) + 1
        if not marks or marks[0][0] > 0:
            yield None, 0, marks[0][0] if marks else len(value), opening
        for i, (place, heading) in enumerate(marks):
            start = min(place + len(heading) + 1, len(value))
            yield None, start, marks[i + 1][0] if i + 1 < len(marks) else len(value), heading

    return _column(split, text)


# Fixed value: a line that is nothing but a range of dates.
DATE_LINE = r"(?:19|20)\d{2}(?:[./-]\d{1,2})?\s*[-–—~～至到]\s*(?:(?:19|20)\d{2}(?:[./-]\d{1,2})?|至今|现在|[Pp]resent)"


def entries(text: str, headings: dict[str, tuple[str | None, int | None]], dated: re.Pattern) -> Iterator[tuple[str, int, int, int]]:
    """(kind, number, start, end) of the segments of a text's sections, one pass over its lines.

    headings: line -> (kind, lead). A section runs from behind its heading's line to the next heading; kind None: it has no segments;
    lead None: it is one segment. Else each dated line opens a segment, `lead` lines with text above it, as far as they are in the
    section and behind the dated line before, belong to it; without a dated line the section is one segment. What stands before a section's
    first segment belongs to none. Segments are trimmed and numbered through within their kind; empty ones are left out.
    """
    numbers: dict[str, int] = {}

    def cut(kind: str, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
        piece = text[start:end]
        if bare := piece.strip():
            first = start + len(piece) - len(piece.lstrip())
            numbers[kind] = numbers.get(kind, 0) + 1
            yield kind, numbers[kind], first, first + len(bare)

    kind, lead, opened, above, whole = None, None, None, [], None
    at = 0
    for line in [*text.splitlines(keepends=True), None]:
        bare = line.strip() if line is not None else None
        if line is None or bare in headings:
            if kind is not None:
                yield from cut(kind, whole if opened is None else opened, at)
            if line is not None:
                (kind, lead), opened, above, whole = headings[bare], None, [], at + len(line)
        elif kind is not None and lead is not None and bare:
            if dated.fullmatch(bare):
                start = ([*above, at][-1 - lead :] if lead else [at])[0]
                if opened is not None:
                    yield from cut(kind, opened, start)
                opened, above = start, []
            else:
                above.append(at)
        at += len(line or "")


def segments(text: Column, headings: dict[str, tuple[str | None, int | None]], dated: str = DATE_LINE) -> Column:
    """`entries` of a text as structs (kind, number, start, end); null: none."""
    pattern = re.compile(dated)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(texts: pa.Array) -> pa.Array:
        keys = ("kind", "number", "start", "end")
        return pa.array([[dict(zip(keys, x)) for x in entries(t.as_py() or "", headings, pattern)] for t in texts], kind)

    return F.arrow_udf(each, "array<struct<kind: string, number: int, start: int, end: int>>")(text)
