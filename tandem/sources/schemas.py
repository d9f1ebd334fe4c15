"""The declared schema of every table. Nothing is inferred at run time; a column that the files lack
is read as null."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _D, _B = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
)

SEED_PAIR = _schema(("ord", _L), ("fr", _S), ("dioula", _S))
HUB_ROW = _schema(("ord", _L), ("fr", _S), ("transcription", _S))
PAIR = _schema(("source", _S), ("target", _S), ("source_lang", _S), ("target_lang", _S))
EXAMPLE = _schema(("prompt", _S), ("completion", _S))
BENCHMARK = _schema(("item_id", _L), ("fr", _S), ("dioula", _S))
SMOKE_CASE = _schema(("case_id", _L), ("type", _S), ("prompt", _S))
CHAT_REQUEST = _schema(
    ("request_id", _S), ("message", _S), ("session_id", _S), ("max_tokens", _I), ("temperature", _D)
)
TRANSLATE_REQUEST = _schema(("request_id", _S), ("texte", _S), ("direction", _S))
GENERATED = _schema(("output", _S), ("latence_ms", _I), ("success", _B), ("error", _S))
REPORT = _schema(
    ("benchmark", _S), ("score_exact_pct", _D), ("score_global_pct", _D), ("avg_char_similarity_pct", _D),
    ("exact", _L), ("partial", _L), ("total", _L),
)
