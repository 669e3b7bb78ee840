"""Text expressions that stay in the JVM, but for the composition of characters."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, spelled out: the engines' own classes differ.
SPACES = "\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
BLANK = f"[{SPACES}]+"
#: No letter of plain text stands here: tells most places at once, where what is sought starts with white space or no ASCII.
UNUSUAL = "(?![!-~])"


def wide(spaces: str) -> str:
    """Runs of white space that aren't one space: what has to change so that all are."""
    return f"{UNUSUAL}[{spaces}](?:[{spaces}]+|(?<! ))"


#: Ligatures and what they stand for. Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Characters that show nothing: zero-width space and joiners, byte order mark, soft hyphen. Fixed values.
INVISIBLE = "​‌‍﻿­"
#: Words of numbers and their digits. Fixed values.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000",
}
NUMBER = r"[0-9][0-9,.:/-]*[0-9]|[0-9]"
CITATION = r"\[([A-Za-z0-9_.:-]+)\]"


def composed(text: Column) -> Column:
    """Canonical composition of characters (NFC). Nothing composes in texts of characters below U+0300 alone; they stay in the JVM."""

    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(F.pandas_udf(nfc, "string")(F.when(text.rlike("[^\\x00-\\u02ff]"), text)), text)


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda x: x != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, wide(SPACES), " "))


def _legible(text: Column) -> Column:
    """Characters below U+0300 but the soft hyphen stay as they are: one look at a text tells whether it has others."""
    odd = composed(F.when(text.rlike("[^\\x00-\\xac\\xae-\\u02ff]"), text))
    for one, plain_ in LIGATURES.items():
        odd = F.replace(odd, F.lit(one), F.lit(plain_))
    return F.coalesce(F.translate(odd, INVISIBLE, ""), text)


def canonical(text: Column) -> Column:
    """One form for ids and comparison: characters composed, ligatures apart, invisible characters away, words broken at a
    line end joined, white space collapsed."""
    return collapsed(F.regexp_replace(_legible(text), "-[ \\t]*\\r?\\n[ \\t]*", ""))


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line of a text: nothing composes over a line end, so the text is read once, not line by line. Lines
    keep a space at an end; trim them where they are rows."""
    inline = SPACES.replace("\\n", "")
    return F.split(F.regexp_replace(_legible(text), wide(inline), " "), "\n")


def straight_quotes(text: Column) -> Column:
    for one, plain_ in zip("‘’“”", "''\"\"", strict=True):
        text = F.replace(text, F.lit(one), F.lit(plain_))
    return text


def plain(text: Column) -> Column:
    """Lower case, everything but a-z and digits one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def trigrams(words_: Column) -> Column:
    """Distinct runs of three of an array of words, as 64-bit hashes. Give it a column, not an expression: what a lambda refers
    to is spelled out in it."""
    return F.when(F.size(words_) > 2, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words_) - 3), lambda i: F.xxhash64(F.get(words_, i), F.get(words_, i + 1), F.get(words_, i + 2))))).otherwise(F.array().cast("array<bigint>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of trigrams: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def n_units(text: Column) -> Column:
    """Number of UTF-16 units: those beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{BLANK}|{UNUSUAL}{BLANK}$", "")


def snippet(text: Column, whole: int = 120, side: int = 60, mark: str = " [...] ") -> Column:
    """The text if it is short, else its two ends."""
    return F.when(F.length(text) <= whole, text).otherwise(F.concat(F.left(text, F.lit(side)), F.lit(mark), F.right(text, F.lit(side))))


def chunk_id(source: Column, text: Column) -> Column:
    """Source and the first twelve hex digits of the SHA-256 of the canonical text."""
    return F.concat(source, F.lit(":"), F.substring(F.sha2(canonical(text), 256), 1, 12))


def split_bucket(text: Column, buckets: int = 100) -> Column:
    """A frozen bucket of a text: h * 33 + unit from 5381 over its UTF-16 units, modulo 2**32, modulo ``buckets``."""


    def hashed(s: pd.Series) -> pd.Series:
        most = max((len(x) for x in s if x is not None), default=0)
        powers = np.cumprod(np.concatenate([[1], np.full(2 * most, 33)]).astype(np.uint32), dtype=np.uint32)

        def one(x: str | None) -> int | None:
            if x is None:
                return None
            u = np.frombuffer(x.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
            return (int((u * powers[: len(u)][::-1]).sum(dtype=np.uint32)) + 5381 * int(powers[len(u)])) % 4294967296 % buckets

        return pd.Series([one(x) for x in s], dtype="Int64")

    return F.pandas_udf(hashed, "long")(text)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def numbers(text: Column) -> Column:
    """Number tokens in order, number words as digits."""
    for word, digits in NUMBER_WORDS.items():
        text = F.regexp_replace(text, rf"(?i)\b{word}\b", digits)
    return matches(text, NUMBER)


def ungrounded(answer: Column, cited: Column) -> Column:
    """Number tokens of an answer that don't stand as such in what it cites, in order, repeats kept."""
    known = numbers(F.coalesce(cited, F.lit("")))
    return F.filter(numbers(F.coalesce(answer, F.lit(""))), lambda x: ~F.array_contains(known, x))


def bracketed(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))


def acronyms(text: Column) -> Column:
    """Bracketed runs of capitals, which a source may print itself."""
    return F.array_distinct(F.filter(bracketed(text), lambda x: x.rlike("^[A-Z]+$")))


def cited_ids(text: Column, printed: Column) -> Column:
    """Distinct bracketed ids in the order of their first mention, without ``printed`` acronyms."""
    return F.array_except(F.array_distinct(bracketed(text)), printed)


def without_citations(text: Column, printed: Column | None = None) -> Column:
    """Citation marks go but for ``printed`` acronyms (an array), and the white space that they leave."""
    if printed is None:
        out = F.regexp_replace(text, CITATION, "")
    else:
        # acronyms are capitals alone, so they need no escape in a pattern
        out = F.regexp_replace(text, F.concat(F.lit("\\[(?!(?:"), F.array_join(printed, "|"), F.lit(")\\])[A-Za-z0-9_.:-]+\\]")), F.lit(""))
    out = F.regexp_replace(out, "[ \\t]{2,}", " ")
    return trimmed(F.regexp_replace(out, "[ \\t]+([.,;:!?])", "$1"))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in a text, overlaps counted; none for an empty part."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(part == "", 0).otherwise(F.regexp_count(text, quoted)).cast("long")


def calendar_escaped(text: Column) -> Column:
    """For iCalendar values: backslash, semicolon, comma and line end."""
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def heading_stripped(text: Column, section: Column) -> Column:
    """The text without a repeat of its section at the front, in the same case, unless the section opens with if or unless or
    the repeat ends inside a word; then without leading white space, colons, full stops and dashes."""
    rest = F.substr(text, F.length(section) + 1)
    echo = (F.length(section) > 0) & F.startswith(text, section) & ~rest.rlike("^[A-Za-z0-9]") & ~section.rlike("^(?i:if|unless)(?![A-Za-z0-9_])")
    return F.when(F.coalesce(echo, F.lit(False)), F.regexp_replace(rest, f"^[{SPACES}:.\\-]+", "")).otherwise(text)


def extraction_faults(text: Column, pages: Column, least: int = 100, most_bad: float = 0.02) -> Column:
    """Names of what is wrong with an extraction, its ends trimmed: empty (and nothing else), sparse (under ``least`` UTF-16
    units a page, where pages are known), garbled (over ``most_bad`` replacement or control characters other than tab, line
    feed and return)."""
    text = trimmed(F.coalesce(text, F.lit("")))
    size = n_units(text)
    bad = F.regexp_count(text, F.lit("[\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"))
    sparse = F.coalesce((pages > 0) & (size < pages * least), F.lit(False))
    return F.when(size == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(F.when(sparse, "sparse"), F.when(bad > size * most_bad, "garbled"))))
