"""Chat and translation jobs over tables or streams of requests.

Both are one chain of narrow steps, so the same function serves a batch and a streaming frame.
Requests that fail validation are left out here; ``rejected(validate_...(requests))`` lists them.
Without a ``system`` text of their own they send ``serving_prompt()``, which names the assistant.
With ``batched`` the model takes whole batches, as ``generate`` describes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions.detect import detect_language, drop_special_tokens, intent_mode
from tandem.functions.templates import chat_prompt, serving_prompt
from tandem.operators.generate import BatchGenerator, Generator, generate
from tandem.operators.requests import (
    accepted,
    direction_request,
    fill_chat_defaults,
    fill_translate_defaults,
    validate_chat,
    validate_translate,
)


def chat_job(
    requests: DataFrame,
    make_generator: Callable[[], Generator | BatchGenerator],
    model_name: str = "model",
    system: str | None = None,
    batched: bool = False,
) -> DataFrame:
    """Replies to (request_id, message, session_id, max_tokens, temperature)."""
    filled = fill_chat_defaults(accepted(validate_chat(requests)))
    prompted = filled.withColumn("prompt", chat_prompt(F.col("message"), system or serving_prompt()))
    answered = generate(prompted, make_generator, batched).withColumn(
        "reponse", drop_special_tokens(F.col("generated.output"))
    )
    return answered.select(
        "request_id",
        F.col("generated.success").alias("success"),
        "session_id",
        "reponse",
        detect_language(F.col("message")).alias("langue_detectee"),
        F.when(F.col("reponse").isNotNull(), detect_language(F.col("reponse"))).alias(
            "langue_reponse"
        ),
        intent_mode(F.col("message")).alias("mode"),
        F.col("generated.latence_ms").alias("latence_ms"),
        F.create_map(F.lit("model"), F.lit(model_name)).alias("metadata"),
        F.col("generated.error").alias("error"),
    )


def translate_job(
    requests: DataFrame,
    make_generator: Callable[[], Generator | BatchGenerator],
    system: str | None = None,
    batched: bool = False,
) -> DataFrame:
    """Translations of (request_id, texte, direction)."""
    directed = direction_request(fill_translate_defaults(accepted(validate_translate(requests))))
    prompted = directed.withColumns({
        "prompt": chat_prompt(F.col("message"), system or serving_prompt()),
        "max_tokens": F.lit(V.TRANSLATE_MAX_TOKENS),
        "temperature": F.lit(V.TRANSLATE_TEMPERATURE),
    })
    answered = generate(prompted, make_generator, batched)
    return answered.select(
        "request_id",
        F.col("generated.success").alias("success"),
        F.col("texte").alias("texte_original"),
        drop_special_tokens(F.col("generated.output")).alias("traduction"),
        "direction",
        "langue_source",
        "langue_cible",
        F.col("generated.latence_ms").alias("latence_ms"),
        F.col("generated.error").alias("error"),
    )
