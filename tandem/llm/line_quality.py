"""Quality rules: base counts of a text, and lines that too many documents of a host share.

All of it is DataFrame code; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import BLANKS, let

SYMBOLS = "#*$%&|<>"
#: Words of a window; three doublings make it.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A line is over the limit if more distinct documents of its host have it.
MOST_DOCUMENTS = 20
#: Per cent of its words that a document must keep once such lines are gone.
LEAST_LEFT = 30


def repeated_words(hashes: Column) -> Column:
    """The number of words in windows of eight that occur twice or more, from the hashes of a text's words.

    Hashes of windows come from three doublings. Most texts repeat none, which a distinct count shows;
    only for others are windows sorted by hash, to find equal neighbours, and their places merged.
    """

    def double(h: Column, by: int) -> Column:
        a = F.slice(h, F.lit(1), F.greatest(F.size(h) - by, F.lit(0)))
        return F.zip_with(a, F.slice(h, F.lit(by + 1), F.size(a)), lambda x, y: F.xxhash64(x, y))

    def covered(places: Column) -> Column:
        until_next = F.transform(
            places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(until_next, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(ordered: Column) -> Column:
        def here(e: Column, k: Column) -> Column:
            same_before = F.get(ordered, k - 1)["h"] == e["h"]
            same_after = F.get(ordered, k + 1)["h"] == e["h"]
            return F.coalesce(same_before, F.lit(False)) | F.coalesce(same_after, F.lit(False))

        return F.transform(F.filter(ordered, here), lambda e: e["p"])

    def of_windows(h: Column) -> Column:
        pairs = F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p")))
        slow = let(F.array_sort(pairs), lambda s: let(F.array_sort(repeats(s)), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(slow)

    two = let(hashes, lambda h: double(h, 1))
    four = let(two, lambda h: double(h, 2))
    eight = let(four, lambda h: double(h, 4))
    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(let(eight, of_windows))


def plain_words(text: Column) -> Column:
    """The words of a text, as ``words`` gives them, without a pattern."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def base_counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); all 0 for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(
        F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0
    )
    blank = F.length(text) - F.length(F.translate(text, BLANKS, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    again = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of(found: Column) -> Column:
        hashes = F.transform(found, lambda w: F.xxhash64(w))
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            (F.length(text) - blank).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            again.cast("long").alias("n_dup_lines"),
            let(hashes, repeated_words).alias("n_repeat_words"),
        )

    return let(plain_words(text), of)


def normal_lines(text: Column) -> Column:
    """The lines of a text: lower case, digits as 0, white space as one blank. A pattern is only run on
    lines in which blanks follow each other."""
    blanks = "\t\x0b\f\r"
    folded = F.translate(F.lower(text), "123456789" + blanks, "0" * 9 + " " * len(blanks))
    single = F.transform(
        F.split(folded, "\n"),
        lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, "  +", " ")).otherwise(x),
    )
    return F.transform(single, lambda x: F.btrim(x))


def blank_words(line: Column) -> Column:
    """Words of a line that has one blank between two of them and is not empty."""
    return F.length(line) - F.length(F.translate(line, " ", "")) + 1


def document_lines(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, version, at, line, n, of): the lines with a word, hashed with their host; ``n`` of the
    text's ``of`` words."""

    def all_words(lines: Column) -> Column:
        return F.aggregate(
            lines, F.lit(0).cast("long"), lambda n, x: n + F.when(F.length(x) > 0, blank_words(x)).otherwise(0)
        )

    # What is known of a whole text is computed before its lines become rows.
    whole = docs.select("doc_id", F.col(host).alias("host"), "text").select(
        "doc_id", "host", F.xxhash64("text", "host").alias("version"), normal_lines(F.col("text")).alias("lines")
    )
    each = whole.withColumn("of", all_words(F.col("lines"))).select(
        "doc_id", "host", "version", "of", F.posexplode("lines").alias("at", "words")
    )
    return each.filter(F.length("words") > 0).select(
        "doc_id", "version", "at", "of",
        F.xxhash64("host", "words").alias("line"),
        blank_words(F.col("words")).alias("n"),
    )


def frequent_words(docs: DataFrame, host: str, most_documents: int) -> DataFrame:
    """(in_doc, in_version, n_words, n_frequent_words, places) of the texts that have lines over the
    limit; ``places`` are those of the lines in the text."""
    lines = document_lines(docs, host)
    texts = lines.select("line", "version").distinct().groupBy("line").agg(F.count("*").alias("texts"))
    frequent = texts.filter(F.col("texts") > most_documents).select("line")
    return (
        lines.join(frequent, "line")
        .groupBy("doc_id", "version", "at").agg(F.max("n").alias("n"), F.max("of").alias("of"))
        .groupBy(F.col("doc_id").alias("in_doc"), F.col("version").alias("in_version"))
        .agg(
            F.max("of").alias("n_words"), F.sum("n").cast("long").alias("n_frequent_words"),
            F.collect_list("at").alias("places"),
        )
    )


def base_fails(base: Column) -> Column:
    return (base["n_words"] < LEAST_WORDS) | (
        100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"]
    )


def depleted(n_words: Column, n_frequent: Column, least_left: int) -> Column:
    return 100 * (n_words - n_frequent) < least_left * n_words


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines at ``places``; the others as they are, in order."""

    def left(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.transform(F.array_except(every, places), lambda k: F.get(lines, k))

    return F.array_join(let(F.split(text, "\n"), left), "\n")


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    most_documents: int = MOST_DOCUMENTS,
    least_left: int = LEAST_LEFT,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_frequent_words for each row of ``docs``.

    A document fails the base rules with under 20 words, or over 30 % of its words in windows of eight
    that its text repeats. Lines in over ``most_documents`` distinct texts of a host count as
    boilerplate; exact copies are one text. A document that passed is not kept if under
    ``least_left`` per cent of its words are left without such lines.

    Null and empty texts have no words and fail. A null host is a host. Rows alike in doc_id, host and
    text are judged once and all returned. Columns other than doc_id, text and host are not read.
    Window and line hashes have 64 bits.
    """
    removed = frequent_words(docs, host, most_documents).drop("n_words", "places")
    base = docs.select(
        "doc_id", F.xxhash64("text", host).alias("version"), base_counts(F.col("text")).alias("base")
    )
    same = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("version") == F.col("in_version"))
    gone = F.coalesce(F.col("n_frequent_words"), F.lit(0).cast("long"))
    failed = base_fails(F.col("base"))
    return base.join(removed, same, "left").select(
        "doc_id", "base.*", failed.alias("base_failed"),
        (~failed & ~depleted(F.col("base.n_words"), gone, least_left)).alias("kept"),
        gone.alias("n_frequent_words"),
    )


def keep_documents(
    docs: DataFrame,
    host: str = "source",
    most_documents: int = MOST_DOCUMENTS,
    least_left: int = LEAST_LEFT,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, whatever their names;
    ``text`` is without the lines over the limit.

    The base rules filter in place; the keys of texts with such lines are joined, with the places of
    the lines. Lines that stay are not changed, nor are texts that have none over the limit.
    """
    found = frequent_words(docs, host, most_documents).withColumn(
        "gone", depleted(F.col("n_words"), F.col("n_frequent_words"), least_left)
    )
    # A text that goes as a whole needs no places.
    found = found.select(
        "in_doc", "in_version", "gone", F.when(~F.col("gone"), F.col("places")).alias("places")
    )
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    row = rows.withColumn("version", F.xxhash64("doc.text", f"doc.{host}"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("in_doc")) & (F.col("version") == F.col("in_version"))
    base = base_counts(F.col("doc.text"))
    text = F.when(F.col("places").isNull(), F.col("doc.text")).otherwise(
        without_lines(F.col("doc.text"), F.col("places"))
    )
    kept = row.filter(~let(base, base_fails)).join(found, same, "left").filter(
        ~F.coalesce(F.col("gone"), F.lit(False))
    )
    return kept.select(
        *[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    )
