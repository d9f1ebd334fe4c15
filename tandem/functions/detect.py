"""Language and intent of a text, and clean-up of generated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.text import contains_any, cut_at_any, first_line, marker_hits, strip


def detect_language(
    text: Column,
    markers: Sequence[str] = V.LANGUAGE_MARKERS,
    threshold: int = V.LANGUAGE_THRESHOLD,
    marked: str = V.TARGET_NAME,
    unmarked: str = V.SOURCE_NAME,
) -> Column:
    """Name of the marked language if at least ``threshold`` different markers are present."""
    return F.when(marker_hits(text, markers) >= threshold, marked).otherwise(unmarked)


def intent_mode(message: Column, words: Sequence[str] = V.TRANSLATION_WORDS) -> Column:
    """Whether a message asks for a translation or converses."""
    return F.when(contains_any(message, words), V.MODE_TRANSLATION).otherwise(V.MODE_CONVERSATION)


def clean_output(
    raw: Column, delimiter: str = V.OUTPUT_DELIMITER, stops: Sequence[str] = V.OUTPUT_STOPS
) -> Column:
    """First real line of a generation command's output.

    Takes the section after the first delimiter if there is one, cuts it at the earliest stop
    string, and returns its first line that is not blank.
    """
    section = F.when(
        F.contains(raw, F.lit(delimiter)), F.split_part(raw, F.lit(delimiter), F.lit(2))
    ).otherwise(raw)
    return first_line(cut_at_any(section, stops))


def drop_special_tokens(text: Column) -> Column:
    """Remove the end marks anywhere in the text, then strip."""
    for mark in (V.END_OF_TURN, V.END_OF_TEXT):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return strip(text)


def last_reply(stdout: Column, stderr: Column, marker: str = V.ASSISTANT_MARKER) -> Column:
    """Text after the last assistant header without end-of-turn marks; if empty, the error text."""
    reply = F.when(
        F.contains(stdout, F.lit(marker)),
        strip(F.replace(F.substring_index(stdout, marker, -1), F.lit(V.END_OF_TURN), F.lit(""))),
    ).otherwise(strip(stdout))
    return F.coalesce(F.nullif(reply, F.lit("")), strip(stderr))
