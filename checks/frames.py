"""Pairs, requests, outputs and predictions derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.operators.pairs import to_pairs

#: Numbers that ``ord`` has for the pairs of a document.
PAIRS_OF_DOCUMENT = 1 << 24

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
])
TURN = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

EVENT = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """A table as a stream of files. A table that is one file is picked out of its folder, a table
    of many files is a folder itself; the braces make either a pattern."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def line_pairs(documents: DataFrame) -> DataFrame:
    """All lines of each document, two by two, as raw rows of a hub data set, an empty line as null.

    ``ord`` is in order of doc_id and then of lines; a document has fewer than 2**24 pairs.
    """
    lines = F.split("text", "\n")
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 2).cast("int")),
        lambda k: F.struct(
            F.nullif(F.get("lines", 2 * k), F.lit("")).alias("fr"),
            F.nullif(F.get("lines", 2 * k + 1), F.lit("")).alias("transcription"),
        ),
    )
    each = documents.select("doc_id", lines.alias("lines")).select(
        "doc_id", F.posexplode(pairs).alias("at", "pair")
    )
    return each.select(
        (F.col("doc_id") * PAIRS_OF_DOCUMENT + F.col("at")).alias("ord"), "pair.fr", "pair.transcription"
    )


def document_pairs(documents: DataFrame) -> DataFrame:
    """The lines of each document in pairs, in order of doc_id and line."""
    return to_pairs(line_pairs(documents), "fr", "transcription", keep=["ord"])


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(table(spark, sf_dir, "documents"))


def curated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents labelled as good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return document_pairs(table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi"))


def unlabelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    return document_pairs(table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_anti"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it.

    Both turns are brought together under the number of the user turn: one scan and one exchange,
    evenly spread however long one conversation is.
    """
    role = F.col("role")
    turns = table(spark, sf_dir, "conversations").filter(role.isin("user", "assistant"))
    asked = F.when(role == "user", F.col("turn")).otherwise(F.col("turn") - 1)
    both = turns.groupBy("conv_id", asked.alias("turn")).agg(
        F.max(F.when(role == "user", F.col("text"))).alias("question"),
        F.max(F.when(role == "assistant", F.col("text"))).alias("answer"),
    )
    answered = both.filter(F.col("question").isNotNull() & F.col("answer").isNotNull())
    return to_pairs(answered, "question", "answer", keep=["conv_id", "turn"])


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", "source", F.col("target").alias("reference")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right but for case, cut short, or copied from the source, by conversation; every fifth
    conversation has no prediction for its first turns."""
    target = F.col("reference")
    kind = F.col("conv_id") % 3
    made = (
        F.when(kind == 0, F.lower(target))
        .when(kind == 1, F.substring(target, F.lit(1), F.expr("length(reference) * 3 div 10")))
        .otherwise(F.col("source"))
    )
    rows = references(spark, sf_dir).select("conv_id", "turn", made.alias("prediction"))
    return rows.filter((F.col("conv_id") % 5 != 4) | (F.col("turn") > 1))


def user_turns(conversations: DataFrame) -> DataFrame:
    return conversations.filter("role = 'user'").withColumn(
        "request_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )


def chat_requests(conversations: DataFrame) -> DataFrame:
    """User turns as chat requests, some with broken or missing settings."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    message = (
        F.when(conv % 17 == 3, "")
        .when(conv % 17 == 4, F.repeat(text, F.lit(40)))
        .when(turn % 2 == 0, F.concat(F.lit("Traduis en Dioula : "), text))
        .otherwise(text)
    )
    return user_turns(conversations).select(
        "request_id",
        message.alias("message"),
        F.when(conv % 5 == 1, "").when(conv % 5 != 0, F.concat(F.lit("s"), conv.cast("string")))
        .alias("session_id"),
        F.when(conv % 11 == 0, 9).when(conv % 11 == 1, 513).when(conv % 11 == 2, 10)
        .when(conv % 11 == 3, 512).when(conv % 11 != 4, 100).alias("max_tokens"),
        F.when(conv % 13 == 0, -0.5).when(conv % 13 == 1, 1.5).when(conv % 13 == 2, 0.0)
        .when(conv % 13 == 3, 1.0).when(conv % 13 != 4, 0.5).alias("temperature"),
    )


def translate_requests(conversations: DataFrame) -> DataFrame:
    """User turns as translation requests, some with broken or missing settings."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    return user_turns(conversations).select(
        "request_id",
        F.when(conv % 17 == 3, "").when(conv % 17 == 4, F.repeat(text, F.lit(40)))
        .otherwise(text).alias("texte"),
        F.when(conv % 7 == 0, "fr_to_en").when((conv % 7 != 1) & (turn % 2 == 0), "fr_to_dioula")
        .when(conv % 7 != 1, "dioula_to_fr").alias("direction"),
    )


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns dressed up as the output of a generation command."""
    conv, text = F.col("conv_id"), F.col("text")
    lit = F.lit
    dressed = (
        F.when(conv % 6 == 0, F.concat(
            lit("Loading\n==========\n \u00a0\n"), text, lit("\n==========\nPrompt: 12 tokens")))
        .when(conv % 6 == 1, F.concat(lit("\n \t"), text, lit("<|eot_id|>rest Peak memory")))
        .when(conv % 6 == 2, F.concat(lit("Generation: 3 tokens-per-sec"), text))
        .when(conv % 6 == 3, F.concat(
            lit("x<|start_header_id|>assistant<|end_header_id|>\nfirst<|eot_id|>"
                "<|start_header_id|>assistant<|end_header_id|>\n"),
            text, lit("<|eot_id|>")))
        .when(conv % 6 == 4, lit(" \n"))
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", dressed.alias("raw"),
        F.concat(lit(" error in "), F.col("role")).alias("stderr"),
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: the type as mode, the value as whole milliseconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"), F.floor("value").cast("int").alias("latence_ms")
    )


def stub_factory() -> Callable[[], Callable[[str, int, float], str]]:
    """A model that answers with its prompt in lower case. Nested, so that it travels by value."""

    def make():
        def answer(prompt: str, max_tokens: int, temperature: float) -> str:
            return f"stub {max_tokens}: {prompt.lower()}"

        return answer

    return make


def failing_factory() -> Callable[[], Callable[[str, int, float], str]]:
    """A model that cannot answer prompts with the letters 'ei'."""

    def make():
        def answer(prompt: str, max_tokens: int, temperature: float) -> str:
            if "ei" in prompt:
                raise ValueError("no answer to ei")
            return prompt

        return answer

    return make


def batch_factory() -> Callable[[], Callable[[list[str], list[int], list[float]], list[str]]]:
    """A model for whole batches that fails on those with a prompt with the letters 'ei'."""

    def make():
        def answer(prompts: list[str], max_tokens: list[int], temperatures: list[float]) -> list[str]:
            if any("ei" in prompt for prompt in prompts):
                raise ValueError("no answer to ei")
            return prompts

        return answer

    return make


def mixed_factory() -> Callable[[], Callable[[str, int, float], str]]:
    """A model that answers some phrases at length, some shortly or not at all, and fails on others."""

    def make():
        def answer(prompt: str, max_tokens: int, temperature: float) -> str:
            phrase = prompt.split("Traduis en Dioula : ")[1].split("<|eot_id|>")[0]
            if "ei" in phrase:
                raise ValueError("no answer to ei")
            if "qu" in phrase:
                return ""
            if "sh" in phrase:
                raise ValueError("no")
            return "ok" if "an" in phrase else f"a reply to {phrase}"

        return answer

    return make


def echo_factory() -> Callable[[], Callable[[str, int, float], str]]:
    """A model that prints the phrase it should translate, like a generation command would."""

    def make():
        def answer(prompt: str, max_tokens: int, temperature: float) -> str:
            phrase = prompt.split("Traduis en Dioula : ")[1].split("<|eot_id|>")[0]
            return f"==========\n{phrase}\n==========\nPrompt: {max_tokens} tokens"

        return answer

    return make
