"""Every operator against its plain restatement, on the smallest tables and on awkward rows."""

from __future__ import annotations

import io
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tandem.llm import bitplanes, classifier, curriculum, line_quality, pieces, queries, sharding
from tandem.llm import shingle_join, style_tree, topk, warc
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, size int, _part int, doc string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed: int, n: int = 120) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in draw.integers(0, 5000, n))


TEXTS = [
    None, "", " \n\t ", "one", "a b c", prose(1), prose(1), prose(1) + " end", prose(2, 30) + "\n\n  x  y ",
    "same words here " * 40, "Line A 1\nLine A 2\n" + prose(3), "#$% | <a> & *", "x" * 5000, "日本語 é ▁ \x00 \x1c z",
    prose(4, 12000), "tail ", "<s> <|endoftext|> </s>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, [None, "a", "B", "é"][i % 4], 0, 9, 9, "d") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", None, "a", 0, 9, 9, "d"), (None, "lost words", None, None, 0, 9, 9, "d")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]


def documents(spark):
    return [r[:4] for r in table(spark, "documents")]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def result(df):
    return ordered(tuple(r) for r in df.collect())


# 1


def test_mixing_meets_targets(spark, docs):
    for frame in (docs, spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = curriculum.assign(frame).collect()
        assert len(rows) == frame.count()
        sizes = {}
        for r in rows:
            assert r["size"] == len(brute.words(r.doc.text)) and 0 <= r.taken <= 2 * r["size"]
            sizes[r.doc.source] = sizes.get(r.doc.source, 0) + r["size"]
        targets = brute.targets(sizes)
        for source, target in targets.items():
            mine = [r for r in rows if r.doc.source == source]
            assert mine[0].target == pytest.approx(target) and mine[0].source_size == sizes[source]
            assert abs(sum(r.taken for r in mine) - target) <= 0.5
        assert all(0 <= p <= 1 for r in rows for p in r.places)
        assert [len(r.places) for r in rows] == [-(-r.taken // r["size"]) if r.taken else 0 for r in rows]


def test_mixing_is_stable_and_sorted(docs):
    again = curriculum.assign(docs.repartition(7))
    assert result(curriculum.assign(docs).select("doc.doc_id", "taken", "places")) == result(
        again.select("doc.doc_id", "taken", "places")
    )
    places = [r.place for r in curriculum.stream(again).collect()]
    assert places == sorted(places) and len(places) > 0


def test_mix_reads_what_assign_says(spark, docs):
    """Rows of any content and number, in the order of their places."""
    many = docs.unionByName(docs).unionByName(docs.limit(3)).repartition(5)
    for frame in (many, many.withColumnsRenamed({"lang": "key", "n_chars": "place"}), docs.limit(0)):
        wanted = [(r.place, tuple(r.doc)) for r in curriculum.stream(curriculum.assign(frame)).collect()]
        mixed = curriculum.mix(frame)
        assert mixed.columns == frame.columns
        got = [tuple(r) for r in mixed.collect()]
        assert ordered(got) == ordered(r for _, r in wanted)
        place: dict = {}
        for p, r in wanted:
            place.setdefault(r, []).append(p)
        assert all(place[a][0] <= place[b][-1] for a, b in zip(got, got[1:]))


def test_places_follow_the_schedule(spark):
    from pyspark.sql import functions as F

    df = spark.range(1001).select((F.col("id") / 1000).alias("u"), (F.col("id") % 3).alias("kind"))
    for r in df.select("u", "kind", curriculum.place_in_training(F.col("kind"), F.col("u")).alias("t")).collect():
        t = np.linspace(0, 1, 20001)
        w = np.interp(t, [k for k, _ in curriculum.SCHEDULE], [w[r.kind] for _, w in curriculum.SCHEDULE])
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.interp(r.t, t, area / area[-1]) == pytest.approx(r.u, abs=1e-4)


# 2


def test_shards(docs):
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.shard == brute.jump(r.doc_id or 0, 24) and r.grown_shard == brute.jump(r.doc_id or 0, 25)
        assert r.grown_shard in (r.shard, 24)
    for shard in {r.shard for r in rows}:
        slots = sorted((r.slot, -1 if r.doc_id is None else r.doc_id) for r in rows if r.shard == shard)
        assert [s for s, _ in slots] == list(range(len(slots)))
        assert [d for _, d in slots] == sorted(d for _, d in slots)


# 3


def test_quality_rules(spark, docs):
    rows = documents(spark)
    got = result(queries.op3_line_frequency(spark, SMALL))
    assert got == ordered(brute.quality([(r[0], r[1], r[3]) for r in rows]))
    mine = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert result(line_quality.quality_rules(docs, most_documents=1)) == ordered(brute.quality(mine, 1))


def test_depleted_documents_go(spark):
    common = "\n".join(f"Common  line NUMBER {i} of many" for i in range(9))
    rows = [(i, f"{common}\n{prose(i, 5)}", "h") for i in range(30)] + [(99, f"{common}\n{prose(9)}", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = result(line_quality.quality_rules(df))
    assert got == ordered(brute.quality(rows)) and [r[0] for r in got if r[7]] == [99]
    assert [r.doc_id for r in line_quality.keep_documents(df).collect()] == [99]


def test_lines_over_the_limit_are_removed(spark):
    rows = [(i, f"{prose(i)}\n\nCommon LINE 7\n {prose(900 + i, 9)} \ncommon line 8 \n", "h") for i in range(22)]
    rows += [(50, f"{prose(50)}\ncommon line 1\n", "other"), (0, rows[0][1], "h"), (None, rows[3][1], "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    expected = [
        (i, "\n".join(x for x in t.split("\n") if h == "other" or not x.lower().startswith("common")), h)
        for i, t, h in rows
    ]
    assert result(line_quality.keep_documents(df)) == ordered(expected)
    assert result(line_quality.keep_documents(df, most_documents=22)) == ordered(rows)


# 4


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_ids_round_trip(spark, docs, planes, tmp_path):
    manifest = bitplanes.write_ids(docs, str(tmp_path), BPE, 2, planes, chunk=1000, file_ids=9000)
    tokenizer = Tokenizer.from_file(BPE)
    expected = ordered(
        (r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]))
        for r in docs.collect()
    )
    rows = bitplanes.read_ids(manifest, str(tmp_path)).collect()
    assert ordered((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == expected
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


# 5


def test_pieces_equal_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for frame in (docs, spark.read.parquet(f"{SMALL}/documents.parquet")):
        for r in pieces.encode(frame.select("doc_id", "text", "n_chars"), PIECES).join(
            frame.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id"
        ).collect():
            assert r.ids == library.encode(r.text or "") and r.round_trip and r.n_tokens == len(r.ids)
            assert r.ids_crc32 == brute.crc_ids(r.ids)


def test_viterbi_of_random_strings():
    with open(PIECES, "rb") as f:
        model = pieces.Pieces(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("abcdehinorst .,-*/=(){}\n  éü▁01"), draw.integers(1, 40))) for _ in range(2000)]
    texts += ["".join(model.text[i] for i in draw.integers(259, 32000, 6)) for _ in range(500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts, {})]
    assert got == library.encode(texts)


def test_decode(spark, docs):
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()
    assert ordered((r.doc_id, r.text) for r in back) == ordered(
        (r.doc_id, (r.text or "").replace("▁", " ")) for r in docs.collect()
    )


# 6


def test_classifier(spark, docs):
    rows = queries.op6_fourier_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.9
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in classifier.classify(docs, empty).collect():
        assert r.score == 0.5 and r.predicted == 1


def test_the_most_repeated_word_is_of_the_whole_text():
    for n in (10, 4996, 4997, 9000):
        assert classifier.statistics("a b c " + "spam " * n)[7] == n / (n + 3)
    assert classifier.statistics("")[7] == 0 and classifier.statistics("one two")[7] == 0.5


def test_isotonic():
    assert classifier.isotonic(np.array([1, 0, 2, 3.0]), np.array([2, 2, 2, 3.0])).tolist() == [0.25, 0.25, 1, 1]


# 7


def test_top_k(spark):
    rows = [(r[0], r[1]) for r in table(spark, "embeddings")]
    assert result(queries.op7_uniform_threshold(spark, SMALL)) == ordered(brute.top_k(rows))
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(0, 300)]
    rows += [(i, rows[50][1]) for i in range(300, 420)]  # a hot vector, ties to the smaller id
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 6), (650, []), (700, [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert result(topk.top_k(df)) == ordered(brute.top_k(rows))
    assert result(topk.top_k(df, block=2)) == ordered(brute.top_k(rows))
    assert topk.top_k(df.limit(0)).count() == 0


# 8


def edited(text: str, seed: int, changes: int) -> str:
    draw, words = np.random.default_rng(seed), text.split()
    for k in draw.integers(0, len(words), changes):
        words[k] = f"e{draw.integers(0, 10**6)}"
    return " ".join(words)


def test_jaccard_components(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(shingle_join.jaccard_components(docs)) == ordered(brute.jaccard_components(rows))


@pytest.mark.parametrize("percent", [85, 50])
def test_near_copies_and_shared_passages(spark, percent):
    shared, rows = prose(7, 80), []
    for g in range(12):
        base = prose(100 + g, 20 + 25 * g)
        rows += [(g * 100 + k, edited(base, g * 100 + k, k % 7)) for k in range(30)]
    rows += [(5000 + k, shared + " " + prose(900 + k, 25 + k)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = result(shingle_join.jaccard_components(df, percent=percent))
    assert got == ordered(brute.jaccard_components(rows, percent=percent))


def test_plans_stand_all_differences():
    for percent in (50, 60, 80, 85, 95):
        for n in range(1, 600):
            for band, differ in shingle_join.contexts(n, percent):
                segments, deletion = shingle_join.plan(band, percent)
                assert segments * (2 if deletion else 1) > differ


# 9


def test_articles(spark):
    rows = queries.op9_style_tree(spark, SMALL).collect()
    pages = {r[0]: r[2] for r in table(spark, "pages")}
    assert {r.page_id: r.text for r in rows} == {i: brute.article(p) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_style_trees_cut_what_pages_share(spark):
    page = (
        "<html><body><div class=top><p>Our site</p></div><div class='x1'><p>Story {0} begins</p>"
        "<ul><li>item &amp; {0}<li>more</ul></div><div class=foot9><p>All rights</p></div></body></html>"
    )
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(20)]
    rows += [(50, "http://one.example/", page.format(50)), (51, None, None), (52, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(df).collect()}
    assert got[3] == "Story 3 begins\nitem & 3\nmore"
    assert got[50] == "Our site\nStory 50 begins\nitem & 50\nmore\nAll rights"
    assert got[51] == "" and got[52] == ""


def test_copies_of_a_page_are_one_page(spark):
    page = "<html><body><div class=text><p>Story {0}</p><table><tr><td>cell {0}</table></div></body></html>"
    rows = [(i, "http://mirror.example/a", page.format("one")) for i in range(20)]
    rows += [(100 + i, f"http://mirror.example/{i}", page.format(i)) for i in range(5)]
    rows += [(200 + i, f"http://only.example/{i}", page.format("two")) for i in range(20)]
    rows += [(300 + i, f"http://more.example/{i % 6}", page.format(i % 6).replace("cell", "<p>Ours</p>")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in style_tree.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == "Story one\ncell one" for i in range(20))
    assert all(got[100 + i] == f"Story {i}\ncell {i}" for i in range(5))
    assert all(got[200 + i] == "Story two\ncell two" for i in range(20))
    assert all(got[300 + i] == f"Story {i % 6}\n{i % 6}" for i in range(60))


@pytest.mark.parametrize("page, text", [
    ("<article>a<script>x</p></script> b<p>c<br>d<p>e &eacute;&#x41;", "a b\nc d\ne éA"),
    ("<main><header><h1>T</h1></header><p>x</p><aside>no</aside></main><footer>f</footer>", "T\nx"),
    ("<body><div class='user-comments'>no</div><p>yes", "yes"),
    ("<article><p title='a>b'>q</p><form>f</form><!-- <p>n</p> --></article>", "q"),
    ("<article", ""), ("plain", "plain"), ("<p>un<b>closed", "unclosed"),
])
def test_main_text(page, text):
    assert style_tree.main_text(style_tree.parse(page)) == text


@pytest.mark.parametrize("part", [
    '<h2 id="social-history">T</h2>', '<p id="share-prices">T</p>', '<h2 id="notice">T</h2>', '<p class="notice">T</p>',
    '<ul class="menu-of-dishes"><li>T</ul>', '<div class="article-header"><h1>T</h1></div>', '<div id="comments">T</div>',
])
def test_what_an_article_says_stays(part):
    page = f'<body><div class="ad">no</div><article>{part}<div class="ad-box">no</div><p>x</p></article>'
    assert style_tree.main_text(style_tree.parse(page)) == "T\nx"


def test_a_page_without_an_article_keeps_its_text():
    page = '<body><div class="related-topics">only <b>this</b></div><p class="cookie-notice">no</p><div class="comments">no'
    assert style_tree.main_text(style_tree.parse(page)) == "only this"


@pytest.mark.parametrize("page", ["<div>" * 20000 + "t", "<div class=a>" * 20000 + "</section>" * 20000, "<b>" * 20000 + "<li>x" * 9999])
def test_deep_pages_take_time_by_their_length(page):
    start = time.monotonic()
    tree = style_tree.parse(page)
    nodes = style_tree.style_nodes(tree)
    style_tree.main_text(tree, frozenset(nodes))
    assert time.monotonic() - start < 10


# 10


def test_archives(spark, tmp_path):
    rows = [(r[0], r[2]) for r in table(spark, "pages")]
    got = result(queries.op10_warc(spark, SMALL).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert got == ordered(brute.warc(rows))
    rows = [(i, ["dup", "", None, f"p{i}\r\n\r\nWARC/1.1\r\n", "é" * i][i % 5]) for i in range(40)]
    df = spark.createDataFrame([(i, "u\r\nv" if i % 2 else None, h) for i, h in rows], "page_id long, url string, html string")
    warc.write_pages(df.repartition(4), str(tmp_path))
    found = warc.read_records(spark, str(tmp_path)).collect()
    assert ordered(
        (int(r.record_id[10:-1]), r.payload_length, r.payload_digest[5:], r.record_type,
         int(r.refers_to[10:-1]) if r.refers_to else None) for r in found
    ) == ordered(brute.warc(rows))
    texts = {r.record_id: bytes(r.payload) for r in found if r.record_type == "response"}
    assert all(texts[f"<urn:page:{i}>"] == (h or "").encode() for i, h in rows if f"<urn:page:{i}>" in texts)
    revisits = warc.read_records(spark, str(tmp_path)).filter("record_type = 'revisit'")
    assert revisits.count() == sum(r.record_type == "revisit" for r in found)


def test_damaged_archives_are_errors(spark, monkeypatch):
    def damaged(pages, folder, write=warc.write_pages):
        write(pages, folder)
        path = sorted(Path(folder.removeprefix("file:")).glob("*.warc"))[0]
        data = path.read_bytes()
        path.write_bytes(data.replace(b"<html", b"<hTml", 1))

    monkeypatch.setattr(warc, "write_pages", damaged)
    with pytest.raises(Exception, match="not that of its headers"):
        queries.op10_warc(spark, SMALL).collect()
    whole = warc.record([("WARC-Type", "response")], b"payload")
    assert [n for _, n, _ in warc.records(io.BytesIO(whole * 2), payload=False)] == [7, 7]
    for wanted in (None, lambda headers: False):
        with pytest.raises(ValueError, match="cut short"):
            list(warc.records(io.BytesIO(whole + whole[:-6]), wanted, payload=False))


# all


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert curriculum.assign(docs).count() == 0 and sharding.shard(docs).count() == 0
    assert line_quality.quality_rules(docs).count() == 0
    manifest = bitplanes.write_ids(docs, str(tmp_path / "a"), BPE, 2)
    assert bitplanes.read_ids(manifest, str(tmp_path / "a")).count() == 0
    assert pieces.encode(docs, PIECES).count() == 0
    assert shingle_join.jaccard_components(docs).count() == 0
    assert style_tree.extract(pages).count() == 0
    warc.write_pages(pages, str(tmp_path / "b"))
    assert warc.read_records(spark, str(tmp_path / "b")).count() == 0
