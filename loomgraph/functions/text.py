"""Column functions on texts: fingerprints, names, tokens, n-grams, sentences, sections, keyword matches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
NAME_NOISE = r"[\s、，,.;·\-_（）()]"
FOLD_DROP = "[^a-z0-9一-鿿]"
ENGLISH_TOKEN = r"[A-Za-z0-9][A-Za-z0-9+#.]{1,17}"
HAN_RUN = "[一-鿿]{2,}"
SENTENCE_END = r"(?<=[。；;！？!?])|\n"
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "are", "was", "has", "have", "not", "but", "all", "can", "will", "our", "you", "your", "they")


def fingerprint(title: Column, body: Column) -> Column:
    """MD5 of title, line end and body with white space folded to single spaces and trimmed."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    return F.md5(F.trim(F.regexp_replace(joined, r"\s+", " ")))


def evidence_fingerprint(sentences: Column) -> Column:
    """MD5 of the folded, non-empty sentences in sorted order; the order they came in doesn't matter."""
    folded = F.filter(F.transform(sentences, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    return F.md5(F.array_join(F.array_sort(folded), "∥"))


def norm_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, NAME_NOISE, ""))


def fold_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), FOLD_DROP, "")


def collapse(text: Column, size: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def english_tokens(text: Column) -> Column:
    """Distinct tokens of letters, digits, `+`, `#` and `.`, without trailing marks; two characters or more with a letter, no stop words."""
    found = F.regexp_extract_all(text, F.lit(ENGLISH_TOKEN), F.lit(0))
    cleaned = F.transform(found, lambda t: F.lower(F.regexp_replace(t, "[.+#]+$", "")))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(cleaned, lambda t: (F.length(t) >= 2) & F.regexp_like(t, F.lit("[a-z]")) & ~F.array_contains(stop, t)))


def char_ngrams(run: Column, size: int) -> Column:
    """All n-grams of `size` characters, in order; none for shorter texts. The text is made once, not again for each of its n-grams."""

    def grams(text: Column) -> Column:
        places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(text, i, F.lit(size)))

    return F.transform(F.array(run), grams)[0]


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of character bigrams without punctuation and white space; 0 if either is empty."""
    one, two = (F.array_distinct(char_ngrams(F.regexp_replace(F.lower(x), r"[\p{Punct}\s]", ""), 2)) for x in (a, b))
    union = F.size(F.array_union(one, two))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(F.size(F.array_intersect(one, two)) / union)


def tfidf_tokens(text: Column) -> Column:
    """ASCII words without trailing marks, two characters or more, and sliding bigrams of runs of Han characters."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9+#._-]*"), F.lit(0)), lambda t: F.regexp_replace(t, "[._-]+$", ""))
    runs = F.regexp_extract_all(text, F.lit(HAN_RUN), F.lit(0))
    return F.concat(F.filter(words, lambda t: F.length(t) >= 2), F.flatten(F.transform(runs, lambda r: char_ngrams(r, 2))))


def sentences(text: Column, least: int = 4, most: int = 200) -> Column:
    """Sentences in order, white space folded, shorter ones dropped and longer ones cut."""
    parts = F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.transform(F.filter(parts, lambda s: F.length(s) >= least), lambda s: F.substring(s, 1, most))


def sections(text: Column, heads: dict[str, str], drop: str) -> Column:
    """Text without the lines of sections of kind `drop`. A line that matches a head's pattern opens its section and is left out;
    what comes before the first head is kept. If nothing is left the text stays as it is."""
    any_head = "|".join(f"(?:{pattern})" for pattern in heads.values())
    parts = F.split(text, rf"(?m)(?=^[ \t]*(?:{any_head})[ \t]*$)")

    def kept(part: Column) -> Column:
        line = F.trim(F.substring_index(part, "\n", 1))
        kind = F.when(F.lit(False), F.lit(""))
        for name, pattern in heads.items():
            kind = kind.when(F.regexp_like(line, F.lit(f"^(?:{pattern})$")), name)
        rest = F.when(part.contains("\n"), F.regexp_replace(part, "^[^\n]*\n", "")).otherwise("")
        return F.when(kind.isNull(), part).when(kind != drop, rest).otherwise("")

    joined = F.array_join(F.transform(parts, kept), "")
    return F.when(F.trim(F.regexp_replace(joined, r"\s", "")) == "", text).otherwise(joined)


def clip(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def readable_ratio(text: Column) -> Column:
    """Share of letters, digits, common punctuation and white space."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\s]", "")) / F.length(text))


def packed_map(column: Column) -> Column:
    """Map as `k:v;k:v` in key order."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")


def unpacked_map(column: Column) -> Column:
    """Inverse of packed_map; the value is what follows the last colon."""
    parts = F.filter(F.split(column, ";"), lambda p: p != "")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^(.*):([^:]*)$", 1), F.regexp_extract(p, "^(.*):([^:]*)$", 2))))
