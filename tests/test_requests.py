import hashlib

from tandem.operators.generate import generate
from tandem.operators import requests as Q
from tandem.plans.serve import chat_job, translate_job
from tandem.sources.schemas import CHAT_REQUEST, TRANSLATE_REQUEST


def test_chat_bounds(spark):
    rows = [
        ("a", "x", None, None, None),
        ("b", "x" * 2000, "s", 10, 0.0),
        ("c", "😀" * 2000, "", 512, 1.0),
        ("d", "", None, 9, -0.1),
        ("e", "x" * 2001, None, 513, 1.1),
        ("f", None, None, None, float("nan")),
    ]
    df = spark.createDataFrame(rows, CHAT_REQUEST)
    errors = {r.request_id: r.errors for r in Q.validate_chat(df).collect()}
    assert errors == {
        "a": [], "b": [], "c": [],
        "d": ["message_too_short", "max_tokens_too_low", "temperature_too_low"],
        "e": ["message_too_long", "max_tokens_too_high", "temperature_too_high"],
        "f": ["message_missing", "temperature_too_high"],
    }
    checked = Q.validate_chat(df)
    assert Q.accepted(checked).count() == 3 and Q.rejected(checked).count() == 3


def test_chat_defaults(spark):
    rows = [("a", "x", None, None, None), ("b", "x", "", 10, 0.0), ("c", "x", "s", 512, 1.0)]
    filled = {r.request_id: r for r in Q.fill_chat_defaults(spark.createDataFrame(rows, CHAT_REQUEST)).collect()}
    assert (filled["a"].max_tokens, filled["a"].temperature) == (256, 0.3)
    assert (filled["b"].max_tokens, filled["b"].temperature) == (10, 0.0)
    assert filled["a"].session_id == hashlib.sha256(b"a").hexdigest()
    assert filled["b"].session_id == hashlib.sha256(b"b").hexdigest()
    assert filled["c"].session_id == "s"


def test_translate_rules_and_directions(spark):
    rows = [
        ("a", "oui", None), ("b", "ɔwɔ", "dioula_to_fr"), ("c", "x", "fr_to_dioula\n"),
        ("d", "x" * 1001, "fr_to_dioula"), ("e", None, "en_to_fr"),
    ]
    checked = Q.validate_translate(spark.createDataFrame(rows, TRANSLATE_REQUEST))
    assert {r.request_id: r.errors for r in checked.collect()} == {
        "a": [], "b": [], "c": ["direction_unknown"], "d": ["texte_too_long"],
        "e": ["texte_missing", "direction_unknown"],
    }
    directed = Q.direction_request(Q.fill_translate_defaults(Q.accepted(checked)))
    found = {r.request_id: (r.message, r.langue_source, r.langue_cible) for r in directed.collect()}
    assert found == {
        "a": ("Traduis en Dioula : oui", "français", "dioula"),
        "b": ("Traduis en français : ɔwɔ", "dioula", "français"),
    }


def factory_for(log):
    def make():
        with open(log, "a") as f:
            f.write("made\n")

        def model(prompt, max_tokens, temperature):
            if "bad" in prompt:
                raise ValueError("refused")
            return f"{prompt[-3:]}|{max_tokens}|{temperature}<|eot_id|>"

        return model

    return make


def test_generate_once_per_task_and_errors_per_row(spark, tmp_path):
    rows = [(i, "bad" if i % 10 == 0 else f"p{i}", 5, 0.5) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, prompt string, max_tokens int, temperature double")
    log = str(tmp_path / "log")
    found = generate(df.repartition(4), factory_for(log)).collect()
    assert open(log).read().count("made") == 4
    for r in found:
        g = r.generated
        assert g.latence_ms >= 0
        if r.id % 10 == 0:
            assert (g.output, g.success, g.error) == (None, False, "refused")
        else:
            assert (g.output, g.success, g.error) == (f"{r.prompt[-3:]}|5|0.5<|eot_id|>", True, None)


def test_batches_with_errors_per_row(spark):
    def make():
        def model(prompts, max_tokens, temperatures):
            assert len(prompts) == len(max_tokens) == len(temperatures)
            if "bad" in prompts:
                raise ValueError("refused")
            if "short" in prompts and len(prompts) > 1:
                return []
            return [f"{p}|{n}|{t}" for p, n, t in zip(prompts, max_tokens, temperatures)]

        return model

    for odd in ("bad", "short", "fine"):
        rows = [(i, odd if i == 3 else f"p{i}", 5, 0.5) for i in range(20)]
        df = spark.createDataFrame(rows, "id bigint, prompt string, max_tokens int, temperature double")
        for r in generate(df.coalesce(1), make, batched=True).collect():
            g = r.generated
            if r.prompt == "bad":
                assert (g.output, g.success, g.error) == (None, False, "refused")
            else:
                assert (g.output, g.success, g.error) == (f"{r.prompt}|5|0.5", True, None)


def calls_of(spark, tmp_path, n, bad, **settings):
    log = str(tmp_path / f"{n}-{len(bad)}-{len(settings)}")

    def make():
        def model(prompts, max_tokens, temperatures):
            with open(log, "a") as f:
                f.write(f"{len(prompts)} {max(map(len, prompts))}\n")
            if any(p.startswith("bad") for p in prompts):
                raise ValueError(f"{len(prompts)} refused")
            return [p.upper() for p in prompts]

        return model

    rows = [(i, "bad" * (1 + i % 3) if i in bad else "x" * (i * 7 % 50 + 1), 5, 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, prompt string, max_tokens int, temperature double")
    for r in generate(df.coalesce(1), make, batched=True, **settings).collect():
        g = r.generated
        expected = (None, False, "1 refused") if r.id in bad else (r.prompt.upper(), True, None)
        assert (g.output, g.success, g.error) == expected
    return [tuple(map(int, x.split())) for x in open(log).read().splitlines()]


def test_bad_rows_are_found_by_halving(spark, tmp_path):
    assert len(calls_of(spark, tmp_path, 256, set())) == 1
    assert len(calls_of(spark, tmp_path, 256, {77})) == 1 + 2 * 8
    assert len(calls_of(spark, tmp_path, 256, {3, 100, 200})) <= 1 + 2 * 8 * 3
    assert len(calls_of(spark, tmp_path, 1, {0})) == 1


def test_lists_of_like_lengths_within_a_budget(spark, tmp_path):
    calls = calls_of(spark, tmp_path, 200, {9}, batch_rows=16, batch_chars=300)
    assert all(rows <= 16 and (rows == 1 or rows * longest <= 300) for rows, longest in calls)
    assert len(calls) < 45
    long = calls_of(spark, tmp_path, 30, set(), batch_chars=10)
    assert all(rows == 1 or rows * longest <= 10 for rows, longest in long) and sum(r for r, _ in long) == 30


def test_generated_fields_come_from_one_evaluation(spark, tmp_path):
    df = spark.createDataFrame([("p", 5, 0.5)], "prompt string, max_tokens int, temperature double")
    log = str(tmp_path / "log")
    done = generate(df, factory_for(log))
    done.select("generated.output", "generated.success", "generated.error").filter("success").collect()
    assert open(log).read().count("made") == 1


def test_chat_job(spark, tmp_path):
    rows = [("a", "Traduis la de", None, None, None), ("b", "", None, None, None),
            ("c", "bad", "s", 20, 0.0)]
    df = spark.createDataFrame(rows, CHAT_REQUEST)
    replies = {r.request_id: r for r in chat_job(df, factory_for(str(tmp_path / "l")), "m").collect()}
    assert set(replies) == {"a", "c"}
    a, c = replies["a"], replies["c"]
    assert (a.success, a.mode, a.langue_detectee, a.langue_reponse) == (
        True, "traduction", "dioula", "français"
    )
    assert a.reponse.endswith("|256|0.3") and a.metadata == {"model": "m"} and a.error is None
    assert (c.success, c.reponse, c.error, c.session_id, c.langue_reponse) == (
        False, None, "refused", "s", None
    )


def test_translate_job(spark, tmp_path):
    df = spark.createDataFrame([("a", "oui", None), ("b", "", None)], TRANSLATE_REQUEST)
    (r,) = translate_job(df, factory_for(str(tmp_path / "l"))).collect()
    assert (r.texte_original, r.direction, r.langue_source, r.langue_cible, r.success) == (
        "oui", "fr_to_dioula", "français", "dioula", True
    )
    assert r.traduction.endswith("|256|0.1")
