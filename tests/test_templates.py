from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.functions import templates as P
from tandem.operators.examples import (
    budget_report,
    expand,
    length_budget,
    render_conversations,
    render_parts,
    with_pair_id,
    with_text,
)

SYSTEM_TURN = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\nS<|eot_id|>"
REPLY_HEADER = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"


def prompt(user):
    return f"{SYSTEM_TURN}<|start_header_id|>user<|end_header_id|>\n{user}{REPLY_HEADER}"


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target string")


def test_three_examples_per_pair(spark):
    df = with_pair_id(pairs(spark, (" {x} %s ", "b\\n")))
    rows = {r.kind: r for r in expand(df, phrasings=["Q1 {text} ?"], system="S").collect()}
    assert rows["forward"].prompt == prompt("Traduis en Dioula : {x} %s")
    assert rows["forward"].completion == "b\\n<|eot_id|>"
    assert rows["reverse"].prompt == prompt("Traduis en français : b\\n")
    assert rows["reverse"].completion == "{x} %s<|eot_id|>"
    assert rows["question"].prompt == prompt("Q1 {x} %s ?")
    assert rows["question"].completion == "b\\n<|eot_id|>"
    assert len({r.pair_id for r in rows.values()}) == 1


def test_phrasing_depends_on_seed_and_pair_alone(spark):
    rows = pairs(spark, *[(f"mot {i}", f"k {i}") for i in range(400)])

    def picks(df, seed):
        index = P.phrasing_index(F.col("source"), F.col("target"), seed, 4)
        return {r.source: r.i for r in df.select("source", index.alias("i")).collect()}

    first = picks(rows, 42)
    assert first == picks(rows.repartition(7), 42)
    assert first != picks(rows, 43)
    assert set(first.values()) == {0, 1, 2, 3}


def test_question_uses_its_phrasing(spark):
    rows = pairs(spark, *[(f"mot {i}", f"k {i}") for i in range(40)])
    picked = rows.select(
        "source",
        P.phrasing_index(F.col("source"), F.col("target"), 42, 4).alias("i"),
        P.question_prompt(F.col("source"), F.col("target"), 42, system="S").alias("p"),
    )
    for r in picked.collect():
        assert r.p == prompt(V.QUESTION_REQUESTS[r.i].replace("{text}", r.source))


def test_text_modes(spark):
    df = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    assert with_text(df).first().text == "pc"
    assert with_text(df, "prompt").first().text == "p"


def test_conversations_are_rendered_whole(spark):
    turns = [(1, t, "user" if t % 2 else "assistant", None if t == 9 else f"t{t}") for t in range(5, 2005)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    whole = render_conversations(df.repartition(5)).collect()
    assert [r.rendered for r in whole] == ["<|begin_of_text|>" + "".join(
        f"<|start_header_id|>{r}<|end_header_id|>\n{x or ''}<|eot_id|>" for _, _, r, x in turns
    )]


def test_length_budget(spark):
    df = spark.createDataFrame([("a", "x y z"), ("a", "x"), ("b", "")], "kind string, text string")
    rows = {r.kind: r for r in budget_report(length_budget(df, 2)).collect()}
    assert (rows["a"].n_examples, rows["a"].n_over, rows["a"].max_tokens) == (2, 1, 3)
    assert (rows["b"].n_examples, rows["b"].n_over, rows["b"].max_tokens) == (1, 0, 0)
    custom = length_budget(df, 4, F.length("text"))
    assert custom.filter("over_limit").count() == 1


def test_serving_prompt_names_the_assistant():
    text = P.serving_prompt("{x}")
    assert text.startswith("Tu es {x}, un assistant expert") and "{name}" not in text
    assert P.serving_prompt() == P.serving_prompt(V.ASSISTANT_NAME)


def test_parts_of_a_conversation_are_the_whole(spark):
    rows = [(1, k, "user" if k % 2 else None, "é" * (k * 37 % 200) if k % 11 else None) for k in range(500)]
    rows += [(2, 0, "user", "x" * 5000), (2, 1, "user", "y"), (None, 4, "user", "a"), (None, 2, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {r.conv_id: r.rendered for r in render_conversations(df).collect()}
    for block in (1, 7, 1024):
        parts = {}
        for r in render_parts(df, 1000, block).collect():
            parts.setdefault(r.conv_id, {})[r.part] = r.rendered
        assert {c: "".join(p[k] for k in range(len(p))) for c, p in parts.items()} == whole
        assert len(parts[1]) > 30 and max(len(x.encode()) for x in parts[1].values()) < 1000 + 500
