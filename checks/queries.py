"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import frames as R
from tandem.functions.detect import (
    clean_output,
    detect_language,
    drop_special_tokens,
    intent_mode,
    last_reply,
)
from tandem.functions.text import bigrams, strip, word_count, words
from tandem.operators import stats
from tandem.operators.examples import (
    budget_report,
    expand,
    length_budget,
    render_conversations,
    render_parts,
    with_pair_id,
    with_text,
)
from tandem.operators.generate import generate
from tandem.operators.groups import leakage_by_side, split_groups, with_group
from tandem.operators.pairs import (
    coverage,
    coverage_rate,
    min_chars,
    novel_rows,
    pair_predictions,
    to_pairs,
)
from tandem.operators.packing import pack_examples, packed_texts, packing_report
from tandem.operators.passages import passage_coverage, passage_hits
from tandem.operators.requests import (
    fill_chat_defaults,
    fill_translate_defaults,
    rejected,
    validate_chat,
    validate_translate,
)
from tandem.operators.sample import (
    cap,
    first_shuffled,
    leakage,
    shuffle_pos,
    split,
    split_at,
    split_hash,
)
from tandem.operators.score import (
    score_items,
    score_report,
    score_totals,
    score_verdict,
    smoke_report,
)
from tandem.plans.corpus import build_corpus, prepare_examples
from tandem.plans.evaluate import publish, publish_version, read_report, run_benchmark, run_smoke
from tandem.plans.serve import chat_job, translate_job
from tandem.sources.readers import (
    read_benchmark,
    read_cases,
    read_examples,
    read_optional,
    read_pairs,
    read_raw,
    read_seed,
    read_splits,
)
from tandem.sources.schemas import PAIR
from tandem.sources.shards import write_shards
from tandem.sources.workspace import fresh_path, stage
from tandem.sources.writers import (
    preview,
    split_sizes,
    write_array,
    write_examples,
    write_pairs,
    write_raw,
)
from tandem.streaming.append import stream_append
from tandem.streaming.corpus_table import append_batch, compact, read_corpus, stream_grow
from tandem.streaming.latency import latency_quantiles, read_latencies, stream_latencies
from tandem.streaming.serve import read_side, stream_job, stream_sides

SEED = 42
TURN_KEYS = ["conv_id", "turn"]
PAIR_TEXTS = ["source", "target", "source_lang", "target_lang"]


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return build_corpus([
        ("curated", R.curated_pairs(spark, sf)), ("documents", R.all_pairs(spark, sf))
    ])


def _turn_examples(spark: SparkSession, sf: str) -> DataFrame:
    return expand(with_pair_id(R.turn_pairs(spark, sf)), SEED)


def _staged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Turn pairs written once: the passes that count and cut then read just their keys."""
    return stage(with_pair_id(R.turn_pairs(spark, sf)), "turns")


def _staged_examples(spark: SparkSession, sf: str) -> DataFrame:
    return expand(_staged_pairs(spark, sf), SEED)


def _example_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Examples split one by one, so that pairs leak."""
    return split(
        _staged_examples(spark, sf), seed=SEED, by=["conv_id", "turn", "kind"], unique=True
    )


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    matched = pair_predictions(R.predictions(spark, sf), R.references(spark, sf), TURN_KEYS)
    return score_items(matched)


# corpus


def corpus_clean(spark, sf):
    return _corpus(spark, sf).select("pri", "ord", *PAIR_TEXTS)


def corpus_stats(spark, sf):
    return stats.length_stats(_corpus(spark, sf))


def corpus_composition(spark, sf):
    return stats.composition(_corpus(spark, sf))


def novel_pairs(spark, sf):
    new = R.unlabelled_pairs(spark, sf)
    return novel_rows(new, R.curated_pairs(spark, sf)).select("ord", "source", "target")


def min_length(spark, sf):
    return min_chars(R.all_pairs(spark, sf), 40).select("ord", "source", "target")


def benchmark_coverage(spark, sf):
    benchmark, corpus = R.curated_pairs(spark, sf), R.unlabelled_pairs(spark, sf)
    return coverage(benchmark, corpus, "pair").select("ord", "source", "target", "covered")


def benchmark_coverage_rate(spark, sf):
    benchmark, corpus = R.curated_pairs(spark, sf), R.unlabelled_pairs(spark, sf)
    return coverage_rate(coverage(benchmark, corpus, "source"))


def benchmark_passages(spark, sf):
    """Every benchmark item in every document that contains its text."""
    return passage_hits(R.table(spark, sf, "benchmark"), R.table(spark, sf, "documents"))


def benchmark_passage_coverage(spark, sf):
    items = R.table(spark, sf, "benchmark").select("item_id", "text")
    return passage_coverage(items, passage_hits(items, R.table(spark, sf, "documents"))).drop("text")


def text_measures(spark, sf):
    text = F.col("text")
    return R.table(spark, sf, "documents").select(
        "doc_id",
        F.length(strip(text)).alias("n_stripped"),
        word_count(text).alias("n_words"),
        F.size(words(F.lower(text))).alias("n_distinct_words"),
        F.size(bigrams(text)).alias("n_bigrams"),
    )


# examples


def examples(spark, sf):
    return _turn_examples(spark, sf)


def text_modes(spark, sf):
    rows = _turn_examples(spark, sf)
    full = with_text(rows, "full").select(*TURN_KEYS, "kind", F.lit("full").alias("mode"), "text")
    prompt = with_text(rows, "prompt").select(
        *TURN_KEYS, "kind", F.lit("prompt").alias("mode"), "text"
    )
    return full.unionByName(prompt)


def render(spark, sf):
    """Whole conversations, every turn of them."""
    return render_conversations(R.table(spark, sf, "conversations"))


def render_in_parts(spark, sf):
    """Whole conversations in parts of some turns."""
    return render_parts(R.table(spark, sf, "conversations"), part_bytes=400, block=3)


def length_budget_report(spark, sf):
    return budget_report(length_budget(with_text(_turn_examples(spark, sf)), limit=120))


def packed_examples(spark, sf):
    """Examples packed to the sequence length: nothing lost, repeated, cut or over, and no pack too many."""
    keys = [*TURN_KEYS, "kind"]
    counted = stage(length_budget(with_text(_turn_examples(spark, sf))).select(*keys, "text", "n_tokens"), "counted")
    packs = stage(pack_examples(counted, keys), "packs")
    texts = packed_texts(counted, packs, keys)
    chars = texts.agg(F.sum(F.length("text")).alias("n_chars"))
    report = packing_report(packs).withColumn("n_chars", chars.scalar())
    least = F.ceil((F.col("n_tokens") - F.col("n_over")) / 512)
    return report.select(
        "n_examples", "n_tokens", "n_over", "n_chars", (F.col("fullest") <= 512).alias("within"),
        ((F.col("n_packs") >= least) & (F.col("n_packs") <= 1.5 * least + 1)).alias("few_packs"),
    )


# sampling and splits


def shuffle(spark, sf):
    placed = shuffle_pos(_staged_pairs(spark, sf), SEED, TURN_KEYS, unique=True)
    return placed.select(*TURN_KEYS, "pos")


def shuffle_copies(spark, sf):
    """Languages of all documents, shuffled: few different rows in very many copies."""
    langs = R.table(spark, sf, "documents").select("lang")
    return shuffle_pos(langs, SEED, ["lang"]).select("lang", "pos")


def cap_pairs(spark, sf):
    return cap(_staged_pairs(spark, sf), 100, SEED, TURN_KEYS, unique=True).select(
        *TURN_KEYS, "source"
    )


def cap_copies(spark, sf):
    pairs = R.all_pairs(spark, sf).select("source", "target")
    return cap(pairs, 500, SEED, ["source", "target"])


def split_rows(spark, sf):
    return _example_splits(spark, sf).select(*TURN_KEYS, "kind", "split")


def split_by_position(spark, sf):
    placed = shuffle_pos(_staged_pairs(spark, sf), SEED, TURN_KEYS, unique=True)
    return split_at(placed).select(*TURN_KEYS, "pos", "split")


def split_pairs(spark, sf):
    rows = split(_staged_examples(spark, sf), seed=SEED, by=["pair_id"])
    return rows.select(*TURN_KEYS, "kind", "split")


def split_threshold(spark, sf):
    rows = split_hash(_turn_examples(spark, sf), seed=SEED, by=["pair_id"])
    return rows.select(*TURN_KEYS, "kind", "split")


def leakage_rows(spark, sf):
    return leakage(_example_splits(spark, sf))


def leakage_pairs(spark, sf):
    return leakage(split(_staged_examples(spark, sf), seed=SEED, by=["pair_id"]))


def _grouped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All line pairs of the documents with the group they are linked to."""
    pairs = stage(R.all_pairs(spark, sf).select("ord", "source", "target"), "pairs")
    return stage(with_group(pairs), "grouped")


def side_groups(spark, sf):
    """Splits of whole groups: pairs that share a source or a target are in one."""
    return split_groups(_grouped_pairs(spark, sf), seed=SEED).select("ord", "group_id", "split")


def leakage_sides(spark, sf):
    """Sources and targets in more than one split: drawn by pair, and by group."""
    pairs = with_pair_id(_grouped_pairs(spark, sf))
    by_pair = leakage_by_side(split(pairs, seed=SEED, by=["pair_id"]))
    by_group = leakage_by_side(split_groups(pairs, seed=SEED))
    return by_pair.withColumn("drawn_by", F.lit("pair")).unionByName(by_group.withColumn("drawn_by", F.lit("group")))


def split_report(spark, sf):
    return split_sizes(_example_splits(spark, sf))


def split_totals(spark, sf):
    return stats.split_counts(_example_splits(spark, sf))


def preview_raw(spark, sf):
    return preview(R.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 5)


def preview_shuffled(spark, sf):
    return first_shuffled(R.turn_pairs(spark, sf), 5, SEED, TURN_KEYS).select("source", "target")


def example_build(spark, sf):
    """Corpus, cap, fan-out and pair-safe split; examples and bytes per split and kind."""
    corpus = stage(_corpus(spark, sf).select(*PAIR_TEXTS), "corpus")
    rows = prepare_examples(corpus, SEED, unique=True)
    return rows.groupBy("split", "kind").agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.sum(F.octet_length("prompt")).alias("prompt_bytes"),
        F.sum(F.octet_length("completion")).alias("completion_bytes"),
    )


def shuffled_examples(spark, sf):
    """The corpus as training examples: a pair's three in one split, all in the seeded order."""
    corpus = stage(_corpus(spark, sf).select(*PAIR_TEXTS), "corpus")
    return prepare_examples(corpus, SEED, unique=True).select("pair_id", "kind", "pos", "split")


def example_copies(spark, sf):
    """Examples of all pairs, repeated ones too, split one by one: the sizes are floored exactly."""
    pairs = stage(R.all_pairs(spark, sf).select(*PAIR_TEXTS), "copies")
    rows = prepare_examples(pairs, SEED, split_pairs=False)
    return rows.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n_examples"))


# files


def ordered_shards(spark, sf):
    """Split examples in their seeded order as numbered shards: the manifest, and what the files hold."""
    placed = split_at(shuffle_pos(_staged_examples(spark, sf), SEED, [*TURN_KEYS, "kind"], unique=True))
    path = fresh_path(spark, "shards")
    manifest = write_shards(stage(placed, "placed"), path, 1 << 16)
    files = spark.read.text(path, wholetext=True).select("split", "shard", F.md5("value").alias("content"))
    return manifest.join(files, ["split", "shard"])


def split_priority(spark, sf):
    """Two splits with the same pairs in different case, in both orders: the first split's row wins."""
    rows = R.line_pairs(R.table(spark, sf, "documents"))
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    paths = {"plain": fresh_path(spark, "split"), "loud": fresh_path(spark, "split")}
    write_raw(rows, paths["plain"])
    write_raw(rows.withColumn("fr", F.translate("fr", small, large)), paths["loud"])

    def winners(*order: str) -> DataFrame:
        landed = read_splits(spark, {name: paths[name] for name in order})
        pairs = to_pairs(landed, "fr", "transcription", keep=["split", "split_ord", "ord"])
        return build_corpus([("hub", pairs)]).select(
            F.lit(order[0]).alias("leader"), "split", "ord", "source", "target"
        )

    return winners("plain", "loud").unionByName(winners("loud", "plain"))


def corpus_array(spark, sf):
    """The corpus written as JSON arrays and read back."""
    path = fresh_path(spark, "corpus")
    write_array(_corpus(spark, sf), path)
    return read_pairs(spark, path, "json_array")


def report_details(spark, sf):
    """The table of items that a report leaves beside its summary."""
    items, path = fresh_path(spark, "items"), fresh_path(spark, "report")
    pairs = R.turn_pairs(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"),
        F.col("source").alias("fr"),
        F.col("target").alias("dioula"),
    )
    write_raw(pairs, items, "json")
    publish(run_benchmark(read_benchmark(spark, items), R.echo_factory()), path)
    return spark.read.parquet(f"{path}/details").select(
        "item_id", "prediction", "char_similarity", "exact", "partial", "status"
    )


def report_versions(spark, sf):
    """A report published twice, first of half of the items; the newest one's details and sum."""
    path = fresh_path(spark, "report")
    scored = _scored(spark, sf)
    publish_version(scored.filter("turn < 3"), path)
    publish_version(scored, path)
    details, summary = read_report(spark, path)
    return summary.withColumn("n_details", details.agg(F.count(F.lit(1)).alias("n")).scalar())


def split_files(spark, sf):
    """Documents landed as two named splits, read back as nullable sides and cleaned."""
    labelled = R.table(spark, sf, "labels").select("doc_id")
    rows = R.line_pairs(R.table(spark, sf, "documents"))
    known = rows.join(labelled, F.shiftright("ord", 24) == F.col("doc_id"), "left_semi")
    other = rows.join(labelled, F.shiftright("ord", 24) == F.col("doc_id"), "left_anti")
    paths = {"labelled": fresh_path(spark, "split"), "other": fresh_path(spark, "split")}
    write_raw(known, paths["labelled"])
    write_raw(other, paths["other"])
    landed = read_splits(spark, paths)
    return to_pairs(landed, "fr", "transcription", keep=["split", "ord"])


def raw_files(spark, sf):
    """Conversations landed as JSON lines and read back with their declared schema."""
    path = fresh_path(spark, "raw")
    write_raw(R.table(spark, sf, "conversations"), path, "json")
    return read_raw(spark, path, R.TURN, "json")


def seed_files(spark, sf):
    """Curated lines landed as a csv file of seed pairs, read back and cleaned."""
    good = R.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    lines = R.line_pairs(R.table(spark, sf, "documents").join(good, "doc_id", "left_semi"))
    path = fresh_path(spark, "seed")
    named = lines.select("ord", "fr", F.col("transcription").alias("dioula"))
    named.write.option("escape", '"').csv(path, header=True)
    return to_pairs(read_seed(spark, path, "csv"), "fr", "dioula", keep=["ord"])


def corpus_files(spark, sf):
    """The corpus written as JSON lines and read back, joined by a source that does not exist."""
    path, missing = fresh_path(spark, "corpus"), fresh_path(spark, "missing")
    write_pairs(_corpus(spark, sf), path, "json")
    extra = read_optional(spark, lambda: read_pairs(spark, missing), PAIR)
    return read_pairs(spark, path, "json").unionByName(extra)


def example_files(spark, sf):
    """Split examples written once into one folder per split, and read back."""
    path = fresh_path(spark, "examples")
    write_examples(_example_splits(spark, sf), path)
    return read_examples(spark, path)


def report_files(spark, sf):
    """Benchmark items read from JSON, generated, cleaned, scored and published."""
    items, path = fresh_path(spark, "items"), fresh_path(spark, "report")
    pairs = R.turn_pairs(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"),
        F.col("source").alias("fr"),
        F.col("target").alias("dioula"),
    )
    write_raw(pairs, items, "json")
    return publish(run_benchmark(read_benchmark(spark, items), R.echo_factory()), path)


def smoke_files(spark, sf):
    """Smoke prompts read from JSON, generated and judged."""
    path = fresh_path(spark, "cases")
    cases = R.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"),
        F.col("role").alias("type"),
        F.concat(F.lit("Traduis en Dioula : "), F.col("text")).alias("prompt"),
    )
    write_raw(cases, path, "json")
    return run_smoke(read_cases(spark, path), R.mixed_factory())


# language, intent, clean-up


def language(spark, sf):
    return R.table(spark, sf, "documents").select(
        "doc_id", detect_language(F.col("text")).alias("detected")
    )


def language_confusion(spark, sf):
    return stats.detection_confusion(R.table(spark, sf, "documents"))


def intent(spark, sf):
    asked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Comment DIT-ON : "), F.col("text")))
    return R.table(spark, sf, "conversations").select(
        *TURN_KEYS, intent_mode(F.coalesce(asked, F.col("text"))).alias("mode")
    )


def output_cleanup(spark, sf):
    raw = F.col("raw")
    return R.raw_outputs(spark, sf).select(
        *TURN_KEYS,
        clean_output(raw).alias("line"),
        drop_special_tokens(raw).alias("plain"),
        last_reply(raw, F.col("stderr")).alias("reply"),
    )


# requests and generation


def chat_validation(spark, sf):
    rows = validate_chat(R.chat_requests(R.table(spark, sf, "conversations")))
    filled = fill_chat_defaults(rows)
    return filled.select(
        "request_id", "session_id", "max_tokens", "temperature",
        F.concat_ws(",", "errors").alias("errors"),
    )


def translate_validation(spark, sf):
    rows = validate_translate(R.translate_requests(R.table(spark, sf, "conversations")))
    return fill_translate_defaults(rows).select(
        "request_id", "direction", F.concat_ws(",", "errors").alias("errors")
    )


def generate_stub(spark, sf):
    turns = R.user_turns(R.table(spark, sf, "conversations")).select(
        "request_id", F.col("text").alias("prompt"),
        F.lit(100).alias("max_tokens"), F.lit(0.3).alias("temperature"),
    )
    return generate(turns, R.stub_factory()).select(
        "request_id", "generated.output", "generated.success"
    )


def generate_errors(spark, sf):
    """A model that fails on some prompts: their rows carry the error, all others their reply."""
    turns = R.user_turns(R.table(spark, sf, "conversations")).select(
        "request_id", F.col("text").alias("prompt"),
        F.lit(100).alias("max_tokens"), F.lit(0.3).alias("temperature"),
    )
    return generate(turns, R.failing_factory()).select("request_id", "generated.*").drop(
        "latence_ms"
    )


def generate_batches(spark, sf):
    """A model that takes whole batches and fails on some: rows are then tried one by one."""
    turns = R.user_turns(R.table(spark, sf, "conversations")).select(
        "request_id", F.col("text").alias("prompt"),
        F.lit(100).alias("max_tokens"), F.lit(0.3).alias("temperature"),
    )
    replies = generate(turns, R.batch_factory(), batched=True)
    return replies.select("request_id", "generated.*").drop("latence_ms")


def generate_buckets(spark, sf):
    """The same in lists of like lengths under a budget: failing ones are halved until the bad rows are alone."""
    turns = R.user_turns(R.table(spark, sf, "conversations")).select(
        "request_id", F.col("text").alias("prompt"),
        F.lit(100).alias("max_tokens"), F.lit(0.3).alias("temperature"),
    )
    replies = generate(turns, R.batch_factory(), batched=True, batch_rows=64, batch_chars=1 << 14)
    return replies.select("request_id", "generated.*").drop("latence_ms")


def rejected_requests(spark, sf):
    chats = rejected(validate_chat(R.chat_requests(R.table(spark, sf, "conversations"))))
    return chats.select("request_id", F.concat_ws(",", "errors").alias("errors"))


def _reply_columns(replies: DataFrame) -> DataFrame:
    return replies.withColumn("model", F.col("metadata")["model"]).drop(
        "latence_ms", "metadata", "error"
    )


def chat(spark, sf):
    requests = R.chat_requests(R.table(spark, sf, "conversations"))
    return _reply_columns(chat_job(requests, R.stub_factory(), "stub"))


def translate(spark, sf):
    requests = R.translate_requests(R.table(spark, sf, "conversations"))
    return translate_job(requests, R.stub_factory()).drop("latence_ms", "error")


def latency(spark, sf):
    return stats.latency_stats(R.latencies(spark, sf))


# evaluation


def matched_predictions(spark, sf):
    return pair_predictions(R.predictions(spark, sf), R.references(spark, sf), TURN_KEYS)


def scored_items(spark, sf):
    return _scored(spark, sf).select(
        *TURN_KEYS, "char_similarity", "exact", "partial", "status"
    )


def benchmark_report(spark, sf):
    return score_report(score_totals(_scored(spark, sf)))


def benchmark_verdict(spark, sf):
    return score_verdict(score_totals(_scored(spark, sf)))


def scores_by_kind(spark, sf):
    kinds = _scored(spark, sf).withColumn("kind", F.col("conv_id") % 3)
    return score_totals(kinds, ["kind"])


def smoke(spark, sf):
    outputs = R.raw_outputs(spark, sf)
    return smoke_report(outputs.select(last_reply(F.col("raw"), F.lit("")).alias("response")))


def dataset_profile(spark, sf):
    return stats.profile(R.table(spark, sf, "documents"))


# streams


def corpus_stream(spark, sf):
    pairs = R.document_pairs(R.stream(spark, sf, "documents", R.DOCUMENT))
    path = fresh_path(spark, "corpus")
    stream_append(pairs, path, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(pairs.schema).parquet(path).select("ord", *PAIR_TEXTS)


def _files_a_batch(spark: SparkSession, landed: str, batches: int) -> int:
    """Files that a trigger takes so that the landed ones come in ``batches`` batches, or a few more if
    they cannot be dealt evenly: more input makes larger batches and not more of them."""
    return max(1, len(spark.read.schema(R.DOCUMENT).parquet(landed).inputFiles()) // batches)


def corpus_growth(spark, sf):
    """A written corpus of curated pairs, grown by all documents in three batches or more; its keys."""
    landed, path = fresh_path(spark, "landed"), fresh_path(spark, "corpus")
    documents = R.table(spark, sf, "documents").select(*R.DOCUMENT.names)
    for part in range(3):
        arrived = documents.filter(F.col("doc_id") % 3 == part)
        arrived.write.mode("append").parquet(landed)
    write_pairs(build_corpus([("curated", R.curated_pairs(spark, sf))]), path)
    files = _files_a_batch(spark, landed, 3)
    rows = spark.readStream.schema(R.DOCUMENT).option("maxFilesPerTrigger", files).parquet(landed)
    pairs = R.document_pairs(rows)
    stream_append(pairs, path, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(PAIR).parquet(path).select(
        F.lower("source").alias("source_key"), F.lower("target").alias("target_key")
    )


def corpus_compacted(spark, sf):
    """A corpus table of curated pairs, grown by all documents in batches; its keys before and after it is
    compacted for the last time."""
    landed, path = fresh_path(spark, "landed"), fresh_path(spark, "table")
    documents = R.table(spark, sf, "documents").select(*R.DOCUMENT.names)
    parts = 4 * documents.rdd.getNumPartitions()  # a batch has as many files as the table has parts
    documents.repartition(parts, "doc_id").write.parquet(landed)
    append_batch(build_corpus([("curated", R.curated_pairs(spark, sf))]).drop("pri", "origin"), path)
    files = _files_a_batch(spark, landed, 4)
    rows = spark.readStream.schema(R.DOCUMENT).option("maxFilesPerTrigger", files).parquet(landed)
    pairs = R.document_pairs(rows)
    stream_grow(pairs, path, fresh_path(spark, "checkpoint"), compact_after=3).awaitTermination()
    before = read_corpus(spark, path)
    compact(spark, path)
    both = before.withColumn("state", F.lit("grown")).unionByName(
        read_corpus(spark, path).withColumn("state", F.lit("compacted"))
    )
    return both.select("state", F.lower("source").alias("source_key"), F.lower("target").alias("target_key"))


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Run a streaming frame into a folder and read that back."""
    path = fresh_path(spark, "replies")
    stream_job(rows, path, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def request_stream(spark, sf):
    requests = R.chat_requests(R.stream(spark, sf, "conversations", R.TURN))
    return _streamed(spark, _reply_columns(chat_job(requests, R.stub_factory(), "stub")))


def translate_stream(spark, sf):
    requests = R.translate_requests(R.stream(spark, sf, "conversations", R.TURN))
    replies = translate_job(requests, R.stub_factory())
    return _streamed(spark, replies.drop("latence_ms", "error"))


def reject_stream(spark, sf):
    requests = R.chat_requests(R.stream(spark, sf, "conversations", R.TURN))
    bad = rejected(validate_chat(requests))
    return _streamed(spark, bad.select("request_id", F.concat_ws(",", "errors").alias("errors")))


def request_sides(spark, sf):
    """Chat requests as one stream that leaves replies and rejects."""
    path = fresh_path(spark, "sides")
    stream_sides(
        R.chat_requests(R.stream(spark, sf, "conversations", R.TURN)), validate_chat,
        lambda good: chat_job(good, R.stub_factory(), "stub"), path, fresh_path(spark, "checkpoint"),
    ).awaitTermination()
    good = read_side(spark, path, "accepted").select("request_id", F.lit("").alias("errors"), "reponse")
    return good.unionByName(
        read_side(spark, path, "rejected").select(
            "request_id", F.concat_ws(",", "errors").alias("errors"), F.lit(None).cast("string").alias("reponse")
        )
    )


def latency_stream(spark, sf):
    """Events as a stream of calls: hourly quantiles by mode, from counts by bucket."""
    events = R.stream(spark, sf, "events", R.EVENT)
    calls = events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("mode"),
        F.floor(F.col("value") * 37).alias("latence_ms"),
    )
    path = fresh_path(spark, "latencies")
    stream_latencies(calls, path, fresh_path(spark, "checkpoint")).awaitTermination()
    return latency_quantiles(read_latencies(spark, path)).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        corpus_clean, corpus_stats, corpus_composition, novel_pairs, min_length,
        benchmark_coverage, benchmark_coverage_rate, benchmark_passages,
        benchmark_passage_coverage, text_measures,
        examples, text_modes, render, render_in_parts, length_budget_report, packed_examples,
        shuffle, shuffle_copies, cap_pairs, cap_copies, split_rows, split_by_position,
        side_groups, leakage_sides,
        split_pairs, split_threshold, leakage_rows, leakage_pairs, split_report, split_totals,
        preview_raw, preview_shuffled, example_build, shuffled_examples, example_copies,
        split_priority, corpus_array, report_details, report_versions, generate_batches, generate_buckets, corpus_growth, corpus_compacted,
        split_files, raw_files, seed_files, corpus_files, example_files, ordered_shards, report_files,
        smoke_files,
        language, language_confusion, intent, output_cleanup,
        chat_validation, translate_validation, generate_stub, generate_errors,
        rejected_requests, chat, translate, latency,
        matched_predictions, scored_items, benchmark_report, benchmark_verdict, scores_by_kind,
        smoke, dataset_profile, corpus_stream, request_stream,
        translate_stream, reject_stream, request_sides, latency_stream,
    )
}
