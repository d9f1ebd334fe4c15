import pytest
from pyspark.sql import functions as F

from tandem.functions import detect as D

HEADER = "<|start_header_id|>assistant<|end_header_id|>"


def one(spark, expression, *values):
    names = "abc"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(expression(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "text, name",
    [("Bonjour", "français"), ("I NI CE", "dioula"), ("de de de", "français"), ("", "français"),
     ("Traduis en Dioula : de", "dioula")],
)
def test_language(spark, text, name):
    assert one(spark, D.detect_language, text) == name


@pytest.mark.parametrize(
    "text, mode",
    [("TRADUIS ceci", "traduction"), ("Comment dit-on merci", "traduction"), ("ça va", "conversation"),
     ("la traduction.", "traduction"), ("", "conversation")],
)
def test_intent(spark, text, mode):
    assert one(spark, D.intent_mode, text) == mode


@pytest.mark.parametrize(
    "raw, line",
    [
        ("log\n==========\n i ni ce \nplus\n==========\nPrompt: 3", "i ni ce"),
        ("==========", ""),
        ("x==========", ""),
        ("\n  \n mot <|eot_id|>", "mot"),
        ("a Peak b", "a"),
        ("Prompt: a", ""),
        ("a tokens-per-sec Generation: b", "a"),
        ("a<|end_of_text|>b\nc", "a"),
        (" \n\t", ""),
        ("", ""),
    ],
)
def test_clean_output(spark, raw, line):
    assert one(spark, D.clean_output, raw) == line


def test_special_tokens_anywhere(spark):
    assert one(spark, D.drop_special_tokens, " a<|eot_id|>b<|end_of_text|>\n") == "ab"


@pytest.mark.parametrize(
    "out, err, reply",
    [
        (f"x{HEADER}a{HEADER}\n b<|eot_id|>\n", "e", "b"),
        (f"x{HEADER}<|eot_id|> ", " e ", "e"),
        (" plain<|eot_id|> ", "e", "plain<|eot_id|>"),
        ("  ", " e\n", "e"),
        ("", "", ""),
    ],
)
def test_last_reply(spark, out, err, reply):
    assert one(spark, D.last_reply, out, err) == reply
