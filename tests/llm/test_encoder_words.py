"""The short ways of the two encoders give what the long ones do."""

import itertools
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tandem.llm import bitplanes, pieces

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD_WORDS = [
    "a", "Word.", "été", "Straße,", "ÿÀ!?", "don't", "x1", "1st", "a.b", "a--", "…", "日本", "ǅ", "ɏ", "ɐ", "×", "a×",
    "ª", "é", "", ".", "'s", "a­", "a‍", "word.'s", "Ġa", "naïve;", "\x7f", "𝒳", "ﬁ",
]


def test_plain_words_skip_the_search_for_cuts(monkeypatch):
    with open(BPE, encoding="utf-8") as f:
        encoder = bitplanes.ChunkedEncoder(f.read())
    whole, asked = encoder._encode, []
    monkeypatch.setattr(encoder, "_encode", lambda texts: asked.extend(texts) or whole(texts))
    encoder(["plain words, of été; Straße.\nNext line!"])
    assert not [x for x in asked if x.strip()]


def test_words_have_the_ids_of_the_library():
    with open(BPE, encoding="utf-8") as f:
        encoder = bitplanes.ChunkedEncoder(f.read())
    library = Tokenizer.from_file(BPE)
    texts = [" ".join(x) for x in itertools.permutations(ODD_WORDS, 2)]
    texts += ["\n".join(x) for x in itertools.permutations(ODD_WORDS, 2)]
    texts += [chr(c) + " a" + chr(c) + ", b" for c in range(1, 0x300)]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert encoder(texts) == want and encoder(texts) == want


def test_a_word_is_encoded_once_whatever_follows(monkeypatch):
    with open(BPE, encoding="utf-8") as f:
        encoder = bitplanes.ChunkedEncoder(f.read())
    words, asked = encoder._encode_words, []
    monkeypatch.setattr(encoder, "_encode_words", lambda pieces: asked.extend(pieces) or words(pieces))
    encoder(["A word, word. word%%% word7 word's\n\n\tword  word!? word"])
    once = ["A", " word", "word", ",", ".", "%%%", "7", "'s", "\n\n", "\t", " ", "!?"]
    assert sorted(asked) == sorted(once)


def test_cuts_have_the_ids_of_the_library():
    signs = [*"  \n\n\t\r\x0b\x0c''abstreABST019.,!%<|", "é", "ß", "×", "÷", "Ȁ", "ȿ", "ɏ", "ɐ", "e\u0301", "ª", "²", "日", "𝒳"]
    rare = ["\xa0", "\x85", "\x1c", "\u3000", "\u200d", "\u180e", "\x00", "\x7f", "<|endoftext|>"]
    draw = random.Random(7)
    texts = ["".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(4000)]
    texts += ["".join(draw.choices(signs + rare, k=draw.randrange(40))) for _ in range(1000)]
    with open(BPE, encoding="utf-8") as f:
        rules = json.load(f)
    lower = json.dumps(rules | {"normalizer": {"type": "Lowercase"}})
    for vocabulary, plain in ((json.dumps(rules), True), (lower, False)):
        encoder, library = bitplanes.ChunkedEncoder(vocabulary), Tokenizer.from_str(vocabulary)
        assert encoder.plain == plain
        want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        got = []
        for k in range(0, len(texts), 250):
            got += encoder(texts[k : k + 250])
        assert got == want


def test_few_kept_words(monkeypatch):
    with open(BPE, encoding="utf-8") as f:
        encoder = bitplanes.ChunkedEncoder(f.read())
    monkeypatch.setattr(bitplanes, "CACHED", 6)
    texts = [f"w{k % 7} and x{k % 3}" for k in range(40)] + ["long" * 30] * 2
    want = [encoder._encode([x])[0] for x in texts]
    assert [encoder([x])[0] for x in texts] == want and len(encoder.known) + len(encoder.older) < 20


def test_blocks_of_texts(monkeypatch):
    monkeypatch.setattr(bitplanes, "BLOCK_BYTES", 10)
    texts = ["a" * n if n is not None else None for n in (3, 3, None, 3, 3, 50, 0, 1)]
    found = list(bitplanes.blocks(pa.array(texts, pa.string())))
    assert [k for a, b in found for k in range(a, b)] == list(range(8)) and len(found) == 3
    assert list(bitplanes.blocks(pa.array([], pa.string()))) == [(0, 0)]


def test_probe_finds_keys_that_share_slots():
    rng = np.random.default_rng(3)
    inverse = np.uint64(pow(int(pieces.BASE), -1, 1 << 64))
    close = (np.arange(200, dtype=np.uint64) + np.uint64((1 << 64) - 100)) * inverse  # one slot, at both ends
    keys = np.unique(np.concatenate([close, rng.integers(0, 1 << 63, 5000, dtype=np.uint64)]))
    probe = pieces.Probe(keys)
    asked = np.concatenate([keys[::-1], keys + np.uint64(1), keys])
    which, at = probe(asked)
    place = {int(k): i for i, k in enumerate(keys)}
    want = [(i, place[int(k)]) for i, k in enumerate(asked) if int(k) in place]
    assert list(zip(which.tolist(), at.tolist())) == want
    which, at = pieces.Probe(keys[:0])(asked)
    assert len(which) == len(at) == 0


def test_kept_answers_are_those_worked_out(monkeypatch):
    monkeypatch.setattr(pieces, "MET_BITS", 6)  # few slots, so that pairs drive each other out
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = pieces.Pieces(f.read())
    rng = np.random.default_rng(5)
    usable = np.flatnonzero(model.kind == pieces.NORMAL)
    a, b = (rng.choice(usable[:300], 4000).astype(np.int32) for _ in range(2))
    want = model._seams(a.astype(np.int64), b.astype(np.int64))
    assert 0 < want.sum() < len(want)
    for _ in range(2):
        assert (model.stay_apart(a, b) == want).all()
    a[::3] = pieces.NO_PIECE
    assert model.stay_apart(a, b)[::3].all() and (model.stay_apart(a, b)[1::3] == want[1::3]).all()
