"""Byte-level BPE by a tree of joins.

The encodings of all byte strings form a monoid: that of ``a + b`` follows from those of ``a`` and
``b``. A match of the pattern is halved down to short leaves, leaves are merged by rank, and halves
are joined upwards. A join looks at the boundary only. Tokens of an encoding stay what they are if
each two neighbours, encoded alone, give themselves: merges go by rank and then from left to right, so
the first merge that crosses the border of two tokens depends on these two alone. So the tokens round
the boundary are encoded anew, in a window that grows on the side whose outer neighbour does not hold,
until both hold; what lies outside cannot change then. Decoding
puts the bytes of tokens together, blocks first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import sent

#: Bytes of a leaf, of the longest string merged by a plain scan (longer ones take a heap), and of the
#: shortest match in which equal halves are looked for.
LEAF, SCAN, REPEATS = 6, 512, 256
#: Words whose ids a worker keeps, characters of the longest of them; leaves, and pairs of tokens.
CACHED, CACHED_CHARS, KNOWN = 400_000, 64, 1 << 18
#: Documents that are encoded together, and tokens of a block when bytes are put together.
TOGETHER, BLOCK = 256, 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class MergeTree:
    """Ids of byte strings, by ranks. The ranks hold all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.leaves: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of the least rank, the first of equal ones, until none is left."""
        if len(piece) > SCAN:
            return self._merge_by_heap(piece)
        ranks, none = self.ranks, 1 << 62
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[x] for x in parts]

    def _merge_by_heap(self, piece: bytes) -> list[int]:
        """The same for a long string: pairs wait in a heap; of one that has changed, the entry is stale."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = ranks.get(piece[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def crossed(self, a: int, b: int) -> list[int] | None:
        """The encoding of two tokens put together, None if they stay themselves."""
        known = self.pairs.get((a, b), False)
        if known is False:
            if len(self.pairs) >= KNOWN:
                self.pairs.clear()
            known = self.merge(self.token[a] + self.token[b])
            if len(known) == 2 and known[0] == a:
                known = None
            self.pairs[a, b] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a string from those of its two halves."""
        if not left or not right:
            return left + right
        window, i, j = self.crossed(left[-1], right[0]), 1, 1
        if window is None:
            return left + right
        while True:
            left_holds = i == len(left) or self.crossed(left[-i - 1], window[0]) is None
            right_holds = j == len(right) or self.crossed(window[-1], right[j]) is None
            if left_holds and right_holds:
                return left[: len(left) - i] + window + right[j:]
            if not left_holds:
                i = min(2 * i, len(left))
            if not right_holds:
                j = min(2 * j, len(right))
            window = self.merge(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one match; a match that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._tree(piece, {} if len(piece) > REPEATS else None)

    def _tree(self, piece: bytes, known: dict[bytes, list[int]] | None) -> list[int]:
        if len(piece) <= LEAF:
            found = self.leaves.get(piece)
            if found is None:
                if len(self.leaves) >= KNOWN:
                    self.leaves.clear()
                found = self.leaves[piece] = self.merge(piece)
            return found
        if known is None or piece not in known:
            # Halves of whole leaves: a repeated string has equal halves, and each is encoded once.
            half = LEAF << ((len(piece) - 1) // LEAF).bit_length() - 1
            found = self.join(self._tree(piece[:half], known), self._tree(piece[half:], known))
            if known is None:
                return found
            known[piece] = found
        return known[piece]

    def strings(self, of: Callable[[int, bytes], bytes]) -> list[bytes]:
        """A string for every id, empty where no token has it."""
        out = [b""] * (max(self.token) + 1)
        for rank, token in self.token.items():
            out[rank] = of(rank, token)
        return out


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def put_together(strings: list[bytes], ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each stretch of ids that ends at ``ends``, the strings of its ids one after the other.

    Blocks of ids are gathered at once, and the blocks put together, so decoding takes no step per id.
    """
    table, out, held, at = pa.array(strings, pa.large_binary()), [], [], 0
    ends = iter([*ends.tolist(), -1])
    end = next(ends)
    for k in range(0, max(len(ids), 1), BLOCK):
        block = ids[k : k + BLOCK]
        taken = table.take(pa.array(block))
        places = np.frombuffer(taken.buffers()[1], np.int64)[: len(block) + 1]
        data = taken.buffers()[2].to_pybytes() if len(block) else b""
        while 0 <= end <= k + len(block):
            out.append(b"".join([*held, data[at : places[end - k]]]))
            held, at, end = [], int(places[end - k]), next(ends)
        held.append(data[at:])
        at = 0
    return out


class Texts:
    """Ids of whole texts, as bytes of 32-bit numbers; those of short words are kept from text to text.

    No match reaches over a blank between two characters that are not white space, but as its first
    character. So a text whose blanks all are such is cut at them, and a piece is looked up as what
    follows a blank. Other texts are matched as a whole.
    """

    def __init__(self, tree: MergeTree, pattern: str):
        self.tree, self.pattern, self.find = tree, pattern, None
        self.bare: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}  # with a blank before; empty if white space is next to it
        self.older: dict[str, bytes] = {}  # of ``after``

    def _match(self, match: str) -> bytes:
        """The ids of one match."""
        if match[0] == " " and len(match) > 1:
            return self._after(match[1:])
        ids = self.bare.get(match)
        if ids is None:
            ids = packed(self.tree.encode(match.encode()))
            if len(match) <= CACHED_CHARS:
                if len(self.bare) >= CACHED // 2:
                    self.bare.clear()
                self.bare[match] = ids
        return ids

    def _after(self, match: str) -> bytes:
        """The ids of a blank and what follows it, both together one match."""
        ids = self.after.get(match) or self.older.get(match)
        if not ids:
            ids = packed(self.tree.encode(b" " + match.encode()))
        if len(match) <= CACHED_CHARS:
            self.after[match] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """The ids of a blank and the piece of text that follows it."""
        if piece.isalpha():
            return self._after(piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return b""
        ids = self.older.get(piece) or b"".join(map(self._match, self.find(" " + piece)))
        if len(piece) <= CACHED_CHARS and "\n" not in piece:
            self.after[piece] = ids
        return ids

    def _text(self, text: str) -> bytes:
        first, *later = text.split(" ")
        if later and first and not first[-1].isspace():
            ids = list(map(self.after.get, later))
            if None in ids:
                ids = [self._piece(x) if known is None else known for x, known in zip(later, ids)]
            if b"" not in ids:
                return b"".join([*map(self._match, self.find(first)), *ids])
        return b"".join(map(self._match, self.find(text)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.find is None:  # made where it is used: it does not travel
            import regex

            self.find = regex.compile(self.pattern).findall
        if len(self.after) > CACHED // 2:
            # Pieces that are met again come back from the older half; the others go.
            self.older, self.after = self.after, {}
        return [self._text(x) for x in texts]


def encode(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256) of each row, the texts encoded whole.

    Ids are those of the public library for these ranks and this pattern, no string being special.
    ``ids_sha256`` is the digest of the decimal ids joined by commas. Null and empty texts have no ids.
    A text of any length, and a match of any length in it, is encoded as a whole in its task; memory
    goes with the longest text. Equal rows give equal rows, doc_id may be null or repeated, other
    columns (of any name) are not read, and an empty table gives an empty one.
    """
    encoder = sent(docs.sparkSession, Texts(MergeTree(read_ranks(ranks_file)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_to_ids = encoder()
        decimal = texts_to_ids.tree.strings(lambda rank, _: b"%d," % rank)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                ids = texts_to_ids([x or "" for x in some.column(1).to_pylist()])
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                ends, ids = np.cumsum(lengths), np.frombuffer(b"".join(ids), np.int32)
                listed = put_together(decimal, ids, ends)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), pa.array(lengths), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                        pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in listed], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256"],
                )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, ids_sha256 string")


def decode(rows: DataFrame, ranks_file: str) -> DataFrame:
    """All columns of ``rows`` but ``ids``, and ``decoded``: the bytes of the ids, null for null ids."""
    tree = sent(rows.sparkSession, MergeTree(read_ranks(ranks_file)))
    others = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        tokens = tree().strings(lambda _, token: token)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                ids = some.column(len(others))
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(tokens)):
                    raise ValueError("an id that no token has")
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                decoded = [
                    x if known else None
                    for x, known in zip(put_together(tokens, flat, np.cumsum(counts)), ids.is_valid().to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(others)], pa.array(decoded, pa.binary())], names=[*others, "decoded"]
                )

    shape = rows.select(*others).withColumn("decoded", F.lit(None).cast("binary")).schema
    return rows.select(*others, "ids").mapInArrow(run, shape)
