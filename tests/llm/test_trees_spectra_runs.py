"""Encoding by joins, whitening and periodic runs against the library, numpy and plain loops."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import merge_tree, queries, runs, whitening
from tests.llm import brute
from tests.llm.test_operators import SMALL, docs, ordered, prose, result, table  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# 11


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_tree.read_ranks(RANKS), special_tokens={}
    )


@pytest.fixture(scope="module")
def tree():
    return merge_tree.MergeTree(merge_tree.read_ranks(RANKS))


def ids_of(tree, text):
    return np.frombuffer(merge_tree.Texts(tree, public_tokenizers.PATTERN)([text])[0], np.int32).tolist()


def encoded(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()


def test_encoding_equals_the_library_and_decodes(spark, docs, library):  # noqa: F811
    found = result(queries.op11_merge_tree(spark, SMALL))
    assert found == ordered(encoded(library, r[0], r[1]) for r in table(spark, "documents"))
    ids = merge_tree.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = merge_tree.decode(ids, RANKS).collect()
    texts = ordered((r.doc_id, r.text) for r in docs.collect())
    assert ordered((r.doc_id, r.n_tokens, r.ids_sha256) for r in back) == ordered(
        encoded(library, *r)[:3] for r in texts
    )
    assert ordered((r.doc_id, bytes(r.decoded)) for r in back) == ordered(
        (d, (t or "").encode()) for d, t in texts
    )


def test_no_documents_no_ids(docs):  # noqa: F811
    none = merge_tree.encode(docs.filter("false"), RANKS, public_tokenizers.PATTERN)
    assert none.collect() == [] and merge_tree.decode(none, RANKS).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abé中文字ɛ=-1 \n'", max_size=300))
def test_any_text_equals_the_library(library, tree, text):
    assert ids_of(tree, text) == library.encode_ordinary(text)


def test_blocks_are_put_together(tree):
    strings = [b"", b"a", b"bc", b"def"]
    draw = random.Random(1)
    for block in (1, 2, 5, 1 << 16):
        for counts in ([], [0], [0, 0, 3], [3, 0, 4, 0], [draw.randint(0, 9) for _ in range(30)]):
            ids = [draw.randrange(4) for _ in range(sum(counts))]
            rest, want = list(ids), []
            for n in counts:
                want.append(b"".join(strings[i] for i in rest[:n]))
                rest = rest[n:]
            old, merge_tree.BLOCK = merge_tree.BLOCK, block
            got = merge_tree.put_together(strings, np.array(ids, np.int32), np.cumsum(np.array(counts, int)))
            merge_tree.BLOCK = old
            assert got == want


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=120))
def test_joins_equal_merging_the_whole(tree, a, b):
    assert tree.join(tree.merge(a), tree.merge(b)) == tree.merge(a + b) == tree._merge_by_heap(a + b)


def test_long_matches(library, tree):
    draw = random.Random(3)
    long = ["a" * 100_000, "中" * 50_000, "=-" * 40_000, "".join(draw.choice("中文字学生活大小ɛɔ") for _ in range(50_000))]
    for text in long:
        assert ids_of(tree, text) == library.encode_ordinary(text)


def test_workers_keep_a_bounded_table_of_words(tree, monkeypatch):
    monkeypatch.setattr(merge_tree, "CACHED", 40)
    encode = merge_tree.Texts(tree, public_tokenizers.PATTERN)
    texts = [prose(k, 30) for k in range(20)]
    assert [encode([t])[0] for t in texts] == [merge_tree.Texts(tree, public_tokenizers.PATTERN)([t])[0] for t in texts]
    assert len(encode.after) + len(encode.older) < 40 + 2 * 60 and len(encode.bare) <= 20


# 12


def whitened(vectors, k):
    """By numpy: rows of (vec_id, component, n, deviation, |whitened|, explained)."""
    usable = [
        (i, [int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v]) for i, v in vectors
        if v and all(c is not None and np.isfinite(c) for c in v)
    ]
    fit = np.array(sorted({tuple(x) for _, x in usable}))
    n, sums = len(fit), [int(x) for x in fit.sum(0)]
    e, u = np.linalg.eigh(np.cov((fit - fit.mean(0)).T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = np.abs((np.array(x) - fit.mean(0)) @ u[:, :k] / np.sqrt(e[:k]))
        out += [(i, c + 1, n, deviation, w[c], e[c] / e.sum()) for c in range(k)]
    return sorted(out, key=str)


def test_whitening_equals_numpy(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in vectors.collect()]
    found = queries.op12_chebyshev_whitening(spark, SMALL).collect()
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-12
    want = whitened(rows, 16)
    assert len(found) == len(want)
    found = sorted(
        ((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found), key=str
    )
    key = lambda r: r[:4]
    for a, b in zip(sorted(found, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-7)


def test_whitening_of_awkward_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=6) * range(1, 7)], "x") for i in range(60)]
    rows += [(7, None, "x"), (8, [1.0, None, 2.0, 3.0, 4.0, 5.0], "x"), (9, [float("nan")] * 6, "x"), (10, [], "x"),
             (11, [float("inf")] + [0.0] * 5, "x"), (12, [1.0, 2.0], "x"), (13, [1e300] * 6, "x")]
    rows += [(None, [0.5] * 6, "x")] + [(99, [0.5] * 6, "x")] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    found = whitening.whiten(df, k=3).collect()
    want = whitened([r[:2] for r in rows if r[1] is not None and len(r[1]) == 6 and r[1][0] != 1e300], 3)
    assert len(found) == len(want) == 3 * 101 and {r.n for r in found} == {61}
    got = sorted((str(r.vec_id), r.component, r.deviation, abs(r.whitened), r.explained) for r in found)
    for a, b in zip(got, sorted((str(b[0]), b[1], *b[3:]) for b in want)):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-7)
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == [] and whitening.whiten(same.filter("false")).collect() == []
    # Fewer directions than components: those that vary.
    flat = spark.createDataFrame(
        [(i, [float(i), 2.0 * i, 1.0, 0.0]) for i in range(9)], "vec_id long, embedding array<double>"
    )
    assert sorted({r.component for r in whitening.whiten(flat).collect()}) == [1]


def test_the_filter_finds_what_a_narrow_block_misses_at_first(spark):
    """Close eigenvalues, a narrow block: rounds, and a wider block where they do not help."""
    draw = np.random.default_rng(2)
    scale = np.concatenate([[30, 20, 10], np.full(37, 3.0)])
    x = np.round(draw.normal(size=(400, 40)) * scale * 20).astype(int)
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").distinct()
    found = whitening.components(fit, k=6, width=8)
    e, u = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    assert found.values == pytest.approx(e[::-1][:6], rel=1e-12) and found.residual <= whitening.CERTIFIED
    assert np.abs((u[:, ::-1][:, :6] * found.vectors).sum(0)) == pytest.approx(np.ones(6), abs=1e-9)
    assert found.passes > 10


# 13


def test_runs_equal_plain_loops(spark, docs):  # noqa: F811
    found = result(runs.find_runs(docs, runs.planted))
    rows = [(r.doc_id, brute.planted(r.doc_id, brute.words(r.text))) for r in docs.collect()]
    assert found == ordered(brute.run_row(*r) for r in rows)
    rows = [(r[0], brute.planted(r[0], brute.words(r[1]))) for r in table(spark, "documents")]
    assert result(queries.op13_tiled_runs(spark, SMALL)) == ordered(brute.run_row(*r) for r in rows)
    assert runs.find_runs(docs.filter("false")).collect() == []


@pytest.mark.parametrize("span", [16, 64, 1 << 14])
def test_runs_of_any_shape_in_tiles_of_any_size(span, monkeypatch):
    monkeypatch.setattr(runs, "SPAN", span)
    draw = random.Random(span)
    for _ in range(150):
        n, k = draw.randint(0, 260), draw.choice([1, 2, 3, 50])
        w = [draw.randrange(k) for _ in range(n)]
        for _ in range(draw.randint(0, 4) if n > 30 else 0):
            a = draw.randrange(n)
            p = draw.randint(1, max(1, (n - a) // 2))
            for i in range(a + p, draw.randint(a, n)):
                w[i] = w[i - p]
        codes, found = np.array(w, np.int32), {}
        for octave, start, bounds, cut in runs.tiles(codes):
            for p, lo, hi in runs.fragments(octave, start, bounds, cut.tolist()):
                found.setdefault(p, []).append((lo, hi))
        stretches = {}
        for p, parts in found.items():
            places = sorted({i for lo, hi in parts for i in range(lo, hi)})
            for i in [i for i in places if i - 1 not in set(places)]:
                j = i
                while j in set(places):
                    j += 1
                if j - i >= runs.least_stretch(p):
                    stretches[i, j - i + p] = min(p, stretches.get((i, j - i + p), p))
        assert sorted((s, m, p) for (s, m), p in stretches.items()) == brute.runs(w)
        assert not brute.runs(w) or runs.repeating(codes, np.array([0, n]))[0]


def test_a_long_document_is_solved_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(runs, "SPAN", 256)
    text = " ".join(["a b c"] * 1500 + [prose(9, 400)] * 4 + ["z"] * 40)
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    parts = runs.explode(df)
    assert parts.filter("octave is not null").count() > 30
    assert result(runs.find_runs(df)) == ordered(
        brute.run_row(i, text.split()) for i in (1, 1, None)
    )
