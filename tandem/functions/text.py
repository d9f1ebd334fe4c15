"""Text expressions with the white-space, length and case rules of Python strings.

``F.trim`` alone removes only U+0020 and Java's ``\\s`` knows six characters; all functions here use
the 29 characters of ``WHITESPACE``. They stay linear in the length of the text: trimming works on a
character set rather than a regex anchored at the end, and no position-by-position ``substring``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.fixed_values import WHITESPACE

_SPACES = " " * len(WHITESPACE)


def strip(c: Column) -> Column:
    """Remove white space from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """Strip, and turn null into the empty string."""
    return strip(F.coalesce(c, F.lit("")))


def words_all(c: Column) -> Column:
    """White-space separated words, in order, repeats kept; none for an empty text."""
    return F.array_remove(F.split(F.translate(c, WHITESPACE, _SPACES), " "), "")


def words(c: Column) -> Column:
    """Distinct white-space separated words."""
    return F.array_distinct(words_all(c))


def word_count(c: Column) -> Column:
    return F.size(words_all(c))


def squash(c: Column) -> Column:
    """Lower-case, strip, and turn every run of white space into one space."""
    return F.regexp_replace(F.translate(strip(F.lower(c)), WHITESPACE, _SPACES), " {2,}", " ")


def char_pairs(text: Column) -> Column:
    """Distinct adjacent character pairs; none below two characters.

    Two regex passes take the pairs that start at odd and at even positions. ``..`` steps by code
    points, and each pass is linear, where a ``substring`` per position is quadratic.
    """
    pair = F.lit("(?s)..")
    return F.array_union(
        F.regexp_extract_all(text, pair, F.lit(0)),
        F.regexp_extract_all(F.substring(text, 2, 2**31 - 1), pair, F.lit(0)),
    )


def bigrams(c: Column) -> Column:
    """Distinct character pairs of the squashed text."""
    return char_pairs(squash(c))


def marker_hits(c: Column, markers: Sequence[str]) -> Column:
    """How many of the markers occur anywhere in the lower-cased text (presence, not occurrences)."""
    lowered = F.lower(c)
    hits = F.lit(0)
    for marker in markers:
        hits = hits + F.contains(lowered, F.lit(marker)).cast("int")
    return hits


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """True if any needle occurs in the lower-cased text."""
    lowered = F.lower(c)
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(lowered, F.lit(needle))
    return found


def cut_at_any(c: Column, stops: Sequence[str]) -> Column:
    """The text before the earliest stop string; all of it if there is none."""
    for stop in stops:
        c = F.substring_index(c, stop, 1)
    return c


def first_line(c: Column) -> Column:
    """First line that is not blank, stripped; empty if there is none."""
    return strip(F.substring_index(strip(c), "\n", 1))


def content_id(*cols: Column) -> Column:
    """md5 over length-prefixed texts, so that moving a character between columns changes the id."""
    parts = []
    for c in cols:
        parts += [F.length(c).cast("string"), F.lit(":"), c]
    return F.md5(F.concat(*parts))


def pair_key(source: Column, target: Column) -> Column:
    """SHA-256 of the lower-cased pair in 32 bytes: what a pair is known by. A null side is a key of its
    own, apart from every text."""
    sides = []
    for side in (F.lower(source), F.lower(target)):
        size = F.coalesce(F.length(side), F.lit(-1))
        sides += [size.cast("string"), F.lit(":"), F.coalesce(side, F.lit(""))]
    return F.unhex(F.sha2(F.concat(*sides), 256))


def row_hash(seed: int | str, cols: Sequence[Column]) -> Column:
    """md5 hex of the seed and the columns: the source of every random choice.

    A function of row content alone, so task retries, other partitionings and other engines give the
    same choices.
    """
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_number(hash_hex: Column) -> Column:
    """The first 8 hex digits as a number below 2**32."""
    return F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("bigint")
