"""Chat markup and prompt texts as concatenations of literals and columns.

User text is only ever a concatenated value, never a format string. Adjacent literals are joined in
Python so that a row costs one concat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.text import clean, hash_number, row_hash


def _concat(parts: Sequence[str | Column]) -> Column:
    """Concat with runs of literal strings merged and empty ones dropped."""
    merged: list[str | Column] = []
    for part in parts:
        if isinstance(part, str) and merged and isinstance(merged[-1], str):
            merged[-1] += part
        elif not (isinstance(part, str) and part == ""):
            merged.append(part)
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in merged])


def _fill(template: str, text: Column) -> list[str | Column]:
    before, after = template.split("{text}")
    return [before, text, after]


def _turn(role: str | Column, text: Sequence[str | Column]) -> list[str | Column]:
    return [V.HEADER_OPEN, role, V.HEADER_CLOSE, *text, V.END_OF_TURN]


def request_text(template: str, text: Column) -> Column:
    """A request such as FORWARD_REQUEST with its phrase filled in."""
    return _concat(_fill(template, text))


def chat_prompt(user: Column | Sequence[str | Column], system: str = V.SYSTEM_PROMPT) -> Column:
    """One system turn, one user turn and the open assistant header."""
    parts = [user] if isinstance(user, Column) else list(user)
    return _concat([
        V.BEGIN_OF_TEXT,
        *_turn("system", [system]),
        *_turn("user", parts),
        V.HEADER_OPEN, "assistant", V.HEADER_CLOSE,
    ])


def serving_prompt(name: str = V.ASSISTANT_NAME) -> str:
    """The system text of a served model that goes by the given name."""
    return V.SERVING_PROMPT.replace("{name}", name)


def chat_turn(role: Column, text: Column) -> Column:
    """One closed turn of a conversation."""
    return _concat(_turn(role, [text]))


def completion(text: Column) -> Column:
    """The stripped answer followed by the end-of-turn mark."""
    return F.concat(clean(text), F.lit(V.END_OF_TURN))


def forward_prompt(source: Column, system: str = V.SYSTEM_PROMPT) -> Column:
    return chat_prompt(_fill(V.FORWARD_REQUEST, clean(source)), system)


def reverse_prompt(target: Column, system: str = V.SYSTEM_PROMPT) -> Column:
    return chat_prompt(_fill(V.REVERSE_REQUEST, clean(target)), system)


def phrasing_index(source: Column, target: Column, seed: int, n: int) -> Column:
    """Which of n phrasings a pair gets: a hash of seed and pair, so any row order agrees."""
    return F.pmod(hash_number(row_hash(seed, [source, target])), F.lit(n)).cast("int")


def question_prompt(
    source: Column,
    target: Column,
    seed: int = V.SEED,
    phrasings: Sequence[str] = V.QUESTION_REQUESTS,
    system: str = V.SYSTEM_PROMPT,
) -> Column:
    """A question about the source in one of several phrasings. Only the words around the phrase are
    chosen, so the long prompt is written out once."""
    halves = [p.split("{text}") for p in phrasings]
    index = phrasing_index(source, target, seed, len(halves))
    before = F.get(F.array(*[F.lit(h[0]) for h in halves]), index)
    after = F.get(F.array(*[F.lit(h[1]) for h in halves]), index)
    return chat_prompt([before, clean(source), after], system)
