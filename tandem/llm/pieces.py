"""SentencePiece encoding and decoding by a Viterbi search over batches of words.

Words of equal length advance together, a character at a time. All substrings that end at the
character are hashed and probed among the sorted hashes of the pieces; a vectorised maximum over them
picks the last piece and stores a pointer back. One search serves both kinds of model:

* unigram: a path weighs the sum of its pieces' scores;
* BPE: a path weighs nothing, but two neighbours are only allowed if the merges of their joint text
  would leave them as they are. The encoding by merges is the one path whose neighbours all are
  allowed, so the search returns the ids of the merges although it never merges a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import sent

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Numbers that stand for no piece: a character without one, and the start of a word.
NO_PIECE, START = -1, -2
#: Encoded words that a worker keeps, the longest of them, and the cells of a batch of the search.
CACHED, CACHED_CHARS, CELLS = 1_000_000, 48, 1 << 18
#: Slots, as a power of two, for pairs of pieces of which it is known whether merges leave them apart.
MET_BITS = 21


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Probe:
    """A table of 64-bit keys to look up in: each lies in the first free slot from its hash on."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.bits = max(self.BITS, int(4 * len(keys)).bit_length())
        self.place, self.taken = np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits, bool)
        self.keys, left = keys, np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            again = self.place[slot] != left
            left, slot = left[again], (slot[again] + 1) & ((1 << self.bits) - 1)
        self.taken[self.place >= 0] = True  # a small table that spares most keys that are not there the rest

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * BASE) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The indices of those of ``keys`` that are there, in order, and their places among all keys."""
        slot = self._slot(keys)
        live = np.flatnonzero(self.taken[slot])
        which, places = [], []
        slot, some = slot[live], keys[live]
        at = self.place[slot]
        while len(live):
            hit = self.keys[at] == some
            which.append(live[hit])
            places.append(at[hit])
            live, slot, some = live[~hit], (slot[~hit] + 1) & ((1 << self.bits) - 1), some[~hit]
            at = self.place[slot]
            live, slot, some, at = live[at >= 0], slot[at >= 0], some[at >= 0], at[at >= 0]
        if len(which) < 2:
            return (which[0], places[0]) if which else (live, at)
        found = np.concatenate(which)
        order = np.argsort(found, kind="stable")
        return found[order], np.concatenate(places)[order]


class Pieces:
    """A model's pieces as arrays. Models that normalise texts are refused."""

    def __init__(self, model: bytes):
        self.text: list[str] = []
        score, kind = [], []
        self.model_type, byte_fallback, prefix, squeeze = UNIGRAM, False, True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                score.append(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
                kind.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.model_type = trainer.get(3, UNIGRAM)
                byte_fallback = bool(trainer.get(35, 0))
                if trainer.get(24, 0):
                    raise ValueError("models with white space as suffix are not supported")
            elif number == 3:
                rules = dict(_fields(value))
                prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                if rules.get(2) or not rules.get(5, 1):
                    raise ValueError("models that normalise texts are not supported")
        if self.model_type not in (UNIGRAM, BPE) or not prefix or squeeze:
            raise ValueError("only unigram and BPE models with a blank in front, and all others kept")
        if USER in kind:
            raise ValueError("models with user-defined symbols are not supported")
        self.score, self.kind = np.array(score, np.float64), np.array(kind)
        self.unknown = kind.index(UNKNOWN)
        self.bytes = [self.text.index(f"<0x{b:02X}>") for b in range(256)] if byte_fallback else None
        usable = [i for i, k in enumerate(kind) if k == NORMAL]
        self.number = {self.text[i]: i for i in usable}
        if any(SPACE in x.lstrip(SPACE) for x in self.number):
            raise ValueError("a piece reaches over a blank")
        self.unknown_score = min((score[i] for i in usable), default=0.0) - 10.0
        self.runs: dict[int, int] = {}
        if self.model_type == BPE:
            usable = self._merges(usable)
        self.longest = max((len(self.text[i]) for i in usable), default=1)
        self.power = BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        keys = np.array([self._key(self.text[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.probe, self.ids = Probe(keys[order]), np.array(usable, np.int32)[order]
        # The characters of each piece end at the last column.
        self.chars = np.zeros((len(usable), self.longest), np.uint32)
        self.lengths = np.array([len(self.text[i]) for i in self.ids], np.int64)
        for row, i in enumerate(self.ids):
            self.chars[row, self.longest - self.lengths[row] :] = [ord(c) for c in self.text[i]]
        self.outside = np.arange(self.longest) < self.longest - self.lengths[:, None]

    def _key(self, text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = h * BASE + np.uint64(ord(c)) + np.uint64(1)
        return h[0]

    def _merges(self, usable: list[int]) -> list[int]:
        """Ranks of merges, each piece's last merge, and all pairs that make a piece.

        Runs of blanks may share one score below all others; they are merged apart, see ``blanks``.
        Returns the pieces that their own merges reach.
        """
        runs = [i for i in usable if set(self.text[i]) == {SPACE}]
        joined = [i for i in usable if len(self.text[i]) > 1 and i not in set(runs)]
        long_runs = [i for i in runs if len(self.text[i]) > 1]
        tied = len({self.score[i] for i in long_runs}) < len(long_runs)
        low = min((self.score[i] for i in joined), default=0.0)
        if tied and (len({self.score[i] for i in long_runs}) > 1 or self.score[long_runs[0]] >= low):
            raise ValueError("runs of blanks need scores of their own, or all one below the others")
        if tied or not long_runs:
            self.runs = {len(self.text[i]): i for i in runs}
        else:
            joined += long_runs
        joined.sort(key=lambda i: -self.score[i])
        if len({self.score[i] for i in joined}) < len(joined):
            raise ValueError("two merges have one score")
        n = len(self.text)
        self.rank = np.full(n, -1, np.int64)
        self.rank[joined] = np.arange(len(joined))
        rank = {self.text[i]: r for r, i in enumerate(joined)}
        if self.runs:  # a merge of blanks only would not be the search's
            usable = [i for i in usable if i not in set(long_runs)]
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        reached = set(usable) - set(joined)
        pairs = {}
        for i in joined:
            text = self.text[i]
            for k in range(1, len(text)):
                a, b = self.number.get(text[:k]), self.number.get(text[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.rank[i]
            parts = list(text)
            while len(parts) > 2:
                best = min(
                    range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], n)
                )
                if parts[best] + parts[best + 1] not in rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2 and all(p in self.number for p in parts):
                self.left[i], self.right[i] = self.number[parts[0]], self.number[parts[1]]
                reached.add(i)
        keys = np.array(sorted(pairs), np.int64)
        self.met = None
        self.pairs, self.pair_ranks = Probe(keys), np.array([pairs[k] for k in keys.tolist()], np.int64)
        return [i for i in usable if i in reached]

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of the joint text of pieces a and b end in a and b.

        Answers for the pairs met last are kept, each in the one slot of its hash.
        """
        if self.met is None:  # made where it is used: it does not travel
            self.met = np.full(1 << MET_BITS, -1, np.int64)
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[live].astype(np.int64) * len(self.text) + b[live]
        slot = ((key.view(np.uint64) * BASE) >> np.uint64(64 - MET_BITS)).view(np.int64)
        kept = self.met[slot]
        answer = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            found = self._seams(*np.divmod(pairs, len(self.text)))
            answer[new] = found[back]
            self.met[slot[new]] = key[new] << 1 | answer[new]
        ok[live] = answer
        return ok

    def _seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stay_apart`` worked out for pieces that are numbered.

        The merges are undone from the last one, at the seam only. If the two pieces that meet there
        make a piece by an earlier merge than the one just undone, that merge would have come first.
        At one rank the merge further left comes first.
        """
        ok, live, x, y = np.ones(len(a), bool), np.arange(len(a)), a, b
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            which, at = self.pairs(x * len(self.text) + y)
            merged = np.zeros(len(live), bool)
            merged[which] = 2 * self.pair_ranks[at] < limit[which]
            ok[live[merged]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            on = ~merged & (np.maximum(rank_x, rank_y) >= 0)
            live, x, y, rank_x, rank_y = live[on], x[on], y[on], rank_x[on], rank_y[on]
            undo_x = rank_x > rank_y
            limit = np.where(undo_x, 2 * rank_x, 2 * rank_y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def find(self, keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The substrings that are pieces: their rows and columns in ``keys``, row by row, and the pieces.

        ``keys`` are the hashes of the substrings of each word that end at one place, a row a width,
        the widest first; ``seen`` are the last characters of each word up to there. Substrings whose
        hash is that of a piece are compared with it character by character.
        """
        which, at = self.probe(keys.ravel())
        k, word = np.divmod(which, keys.shape[1])
        same = (seen[word] == self.chars[at]) | self.outside[at]
        hit = (self.lengths[at] == len(keys) - k) & same.all(axis=1)
        return k[hit], word[hit], self.ids[at[hit]]

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of equally long words, all in one row, and the number of pieces of each word."""
        n, length = codes.shape
        padded = np.zeros((n, self.longest + length), np.uint32)
        padded[:, self.longest :] = codes
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        last = np.full((length + 1, n), START, np.int32)
        back = np.zeros((n, length + 1), np.int16)
        rows = np.arange(n)
        for j in range(1, length + 1):
            widest = min(self.longest, j)
            keys = prefix[j] - prefix[j - widest : j] * self.power[widest:0:-1, None]
            k, row, piece = self.find(keys, padded[:, j : j + self.longest])
            if self.model_type == UNIGRAM:
                weight = np.full((widest, n), -np.inf)
                pieces = np.full((widest, n), NO_PIECE, np.int32)
                weight[-1], weight[k, row], pieces[k, row] = self.unknown_score, self.score[piece], piece
                weight += best[j - widest : j]
                pick = weight.argmax(axis=0)
                best[j], last[j] = weight[pick, rows], pieces[pick, rows]
                back[:, j] = widest - pick
                continue
            # The last character can always stand alone, as a piece or as none.
            alone = np.full(n, NO_PIECE, np.int32)
            single = np.searchsorted(k, widest - 1)
            alone[row[single:]] = piece[single:]
            k = np.concatenate([k[:single], np.full(n, widest - 1)])
            row, piece = np.concatenate([row[:single], rows]), np.concatenate([piece[:single], alone])
            open_ = np.flatnonzero(best[j - widest + k, row] == 0.0)
            k, row, piece = k[open_], row[open_], piece[open_]
            apart = self.stay_apart(last[j - widest + k, row], piece)[::-1]
            k, row, piece = k[::-1][apart], row[::-1][apart], piece[::-1][apart]  # the widest comes last
            best[j, row], last[j, row], back[row, j] = 0.0, piece, widest - k
        kept = np.zeros((n, length + 1), bool)
        at, live = np.full(n, length), rows
        while len(live):
            kept[live, at[live]] = True
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        return last.T[kept], kept.sum(axis=1)

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words as 32-bit little-endian integers, in groups of equal length."""
        groups: dict[int, list[str]] = {}
        for word in words:
            groups.setdefault(len(word), []).append(word)
        got: dict[str, bytes] = {}
        for length, group in groups.items():
            step = max(1, CELLS // (length * self.longest))
            for k in range(0, len(group), step):
                some = group[k : k + step]
                codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
                ids, counts = self.viterbi(codes.reshape(len(some), length))
                ends = np.cumsum(counts)
                gaps = np.flatnonzero(np.minimum.reduceat(ids, ends - counts) < 0)
                data, start = ids.astype("<u4").tobytes(), 0
                for word, end in zip(some, (4 * ends).tolist()):
                    got[word] = data[start:end]
                    start = end
                for i in gaps.tolist():
                    got[some[i]] = self._fill(some[i], ids[ends[i] - counts[i] : ends[i]].tolist())
        return got

    def _fill(self, word: str, pieces: list[int]) -> bytes:
        """Bytes, or one unknown id for a row of them, in place of characters without a piece."""
        out, at = [], 0
        for piece in pieces:
            if piece >= 0:
                out.append(piece)
                at += len(self.text[piece])
                continue
            if self.bytes:
                out += [self.bytes[b] for b in word[at].encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += 1
        return np.array(out, "<u4").tobytes()

    def blanks(self, n: int) -> list[int]:
        """Ids of n blanks in a row when all their merges have one score: the leftmost comes first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.runs[k] for k in stack]

    def encode(self, texts: list[str], kept: dict[str, dict[str, bytes]]) -> list[bytes]:
        """Ids of each text as 32-bit little-endian integers; ``kept`` keeps those of words."""
        if len(kept.setdefault("new", {})) > CACHED // 2:
            # Words that are met again come back from the older half; the others go.
            kept["old"], kept["new"] = kept["new"], {}
        known, older = kept["new"], kept.get("old", {})
        cut = [x.replace(SPACE, " ").split(" ") if x else [] for x in texts]
        found, gaps = [], []
        for parts in cut:
            ids = list(map(known.get, parts))
            found.append(ids)
            if None in ids:
                gaps.append((parts, ids, [k for k, x in enumerate(ids) if x is None]))
        new = {parts[k] for parts, _, missing in gaps for k in missing if parts[k]}
        known.update((x, older[x]) for x in new & older.keys())
        new = new.difference(known)
        ids_of = self.word_ids([SPACE + x for x in new])
        known.update((x, ids_of[SPACE + x]) for x in new)
        for parts, ids, missing in gaps:
            for k in missing:
                ids[k] = known.get(parts[k])
        out = [
            self._with_runs(parts, ids) if None in ids else b"".join(ids)
            for parts, ids in zip(cut, found)
        ]
        for x in new:
            if len(x) > CACHED_CHARS:
                del known[x]
        return out

    def _with_runs(self, parts: list[str], word_ids: list[bytes | None]) -> bytes:
        """Ids of a text with rows of blanks. The last blank of a row goes to the word after it if
        that word's first piece takes it; the others are encoded by themselves."""
        out, run = [], 0
        alone = np.array([self.number.get(SPACE, self.unknown)], "<u4").tobytes()
        if not self.runs:  # the model has no rule of its own for rows of blanks: search with them
            words, at = [], 0
            for x in parts:
                run += 1
                if x:
                    words.append(SPACE * run + x)
                    run = 0
            words += [SPACE * run] if run else []
            found = self.word_ids(list(dict.fromkeys(words)))
            return b"".join(found[w] for w in words)
        for x, ids in zip(parts, word_ids):
            run += 1
            if x:
                if run > 1 and ids[:4] == alone:
                    ids = ids[4:]
                    out.append(np.array(self.blanks(run), "<u4").tobytes())
                elif run > 1:
                    out.append(np.array(self.blanks(run - 1), "<u4").tobytes())
                out.append(ids)
                run = 0
        if run:
            out.append(np.array(self.blanks(run), "<u4").tobytes())
        return b"".join(out)

    def decoder(self) -> list[bytes]:
        """The bytes of each id."""
        out = [x.replace(SPACE, " ").encode() for x in self.text]
        for i, k in enumerate(self.kind):
            if k == CONTROL:
                out[i] = b""
            elif k == UNKNOWN:
                out[i] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes or []):
            out[i] = bytes([b])
        return out


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> str:
    """The text of ids: pieces joined, bytes put together, the blank in front taken off."""
    text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _batches(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _model(docs: DataFrame, model_file: str):
    """The model's arrays, built once on the driver, and a table for encoded words that each worker
    fills: a few megabytes to send, bounded by the vocabulary."""
    with open(model_file, "rb") as f:
        return sent(docs.sparkSession, (Pieces(f.read()), {}))


def encode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, n_tokens, ids_crc32, round_trip) for each row of ``docs``.

    ``ids`` are those that the model gives the whole text, without begin or end ids. Null texts count
    as empty and have none. ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.
    ``round_trip``: whether the ids decode to the text, its U+2581 characters as blanks, which is what
    such models make of them. Other columns are not read; repeated rows are kept.
    """
    model = _model(docs, model_file)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = model()
        table = pieces.decoder()
        for batch in _batches(parts):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = [np.frombuffer(x, "<u4") for x in pieces.encode(texts, known)]
            counts = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            same = [
                decode_bytes(i, table) == x.replace(SPACE, " ") for i, x in zip(ids, texts)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(counts), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array(same, pa.bool_()),
                ],
                names=[key, "ids", "n_tokens", "ids_crc32", "round_trip"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean"
    )


def decode(encoded: DataFrame, model_file: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids): the texts that the ids stand for; null ids give null."""
    model = _model(encoded, model_file)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model()[0].decoder()
        for batch in _batches(parts):
            texts = [
                None if x is None else decode_bytes(np.array(x, np.int64), table)
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=[key, "text"]
            )

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
