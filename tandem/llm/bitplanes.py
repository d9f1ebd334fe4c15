"""Token ids in files of bit or byte planes.

A file is a row of chunks. A chunk has a fixed number of ids (the last one fewer), transposed into
planes, byte k or bit k of every id together, and each plane compressed with zstandard. The footer
holds the documents' ids and lengths and the chunk index: where each plane of each chunk lies. Any
chunk can be read alone.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm.common import BLANKS, file_system, sent
from tandem.sources.workspace import fresh_path, stage

MAGIC = b"TANDEMBP"
CHUNK = 1 << 16
#: Ids after which a task begins its next file.
FILE_IDS = 1 << 25
#: Encoded pieces of text that a worker keeps, and the longest of them.
CACHED, CACHED_BYTES = 700_000, 48
#: Bytes of text after which a block of documents, encoded at once, ends.
BLOCK_BYTES = 1 << 20
IDS = np.dtype("<u4")


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of 32-bit ids; the last byte of a bit plane is filled up."""
    rows = ids.astype(IDS).view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(data: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        rows = np.stack([np.frombuffer(x, np.uint8) for x in data], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:n] for x in data]
        rows = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(IDS).reshape(-1)


class PlaneWriter:
    """Writes one file: add documents, then close. At most a chunk and a document are in memory."""

    def __init__(self, out, planes: str = "byte", chunk: int = CHUNK, level: int = 3):
        import zstandard

        self.out, self.planes, self.chunk = out, planes, chunk
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.n_ids, self.index = 0, 0, []
        self.left: list[np.ndarray] = []
        self.n_left = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _put_chunk(self, ids: np.ndarray) -> None:
        start = self.at
        sizes = [self._put(self.zip.compress(x)) for x in to_planes(ids, self.planes)]
        self.index.append([start, len(ids), sizes])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= self.chunk:
            ids = np.concatenate(self.left)
            full = len(ids) - len(ids) % self.chunk
            for k in range(0, full, self.chunk):
                self._put_chunk(ids[k : k + self.chunk])
            self.left, self.n_left = [ids[full:]], len(ids) - full

    def close(self) -> None:
        if self.n_left:
            self._put_chunk(np.concatenate(self.left))
        documents = self.zip.compress(json.dumps([self.doc_ids, self.lengths]).encode())
        start = self.at
        self._put(documents)
        head = {
            "planes": self.planes, "chunk": self.chunk, "n_ids": self.n_ids, "chunks": self.index,
            "documents": [start, len(documents)],
        }
        footer = self.zip.compress(json.dumps(head).encode())
        self._put(footer)
        self._put(len(footer).to_bytes(8, "little") + MAGIC)


class PlaneReader:
    """Reads a file that can seek, whole or chunk by chunk."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        end = file.tell()
        size, magic = self._get(end - 16, 8), self._get(end - 8, 8)
        if magic != MAGIC:
            raise ValueError("not a file of planes, or cut short")
        n = int.from_bytes(size, "little")
        self.head = json.loads(self.unzip.decompress(self._get(end - 16 - n, n)))

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def documents(self) -> tuple[list[int | None], list[int]]:
        return json.loads(self.unzip.decompress(self._get(*self.head["documents"])))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.head["chunks"][k]
        data, planes = self._get(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unzip.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, n, self.head["planes"])

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of each document, decoding one chunk at a time."""
        have, next_chunk = np.empty(0, IDS), 0
        for doc_id, n in zip(*self.documents()):
            parts, missing = [], n
            while missing > len(have):
                parts.append(have)
                missing -= len(have)
                have, next_chunk = self.chunk(next_chunk), next_chunk + 1
            parts.append(have[:missing])
            have = have[missing:]
            yield doc_id, parts[0] if len(parts) == 1 else np.concatenate(parts)


class ChunkedEncoder:
    """Ids of whole texts, with the ids of their words kept from text to text.

    Texts are cut where no pre-token of the vocabulary reaches across; of equal cuts in a call one is looked
    up, and those not yet met are encoded by the library. Cuts lie at single blanks and line feeds between other
    characters; texts with other white space, and those that hold the string of a special token, are encoded
    whole. Ids are those of the library on the whole text either way.

    Where the vocabulary cuts as GPT-2's does, the last of several blanks, tabs and line ends goes with what
    follows and the others are one pre-token, and a letter always ends one if no letter follows; texts are cut
    there too. Common letters, digits or marks alone are one pre-token: they go to the library's model at once,
    which spares its search for cuts.
    """

    #: One pre-token: letters below U+0250, digits, or ASCII marks without the apostrophe.
    PLAIN = re.compile(" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+)")
    #: The characters that byte-level models write for bytes, by the byte.
    SIGNS = {b: 256 + k for k, b in enumerate((*range(33), *range(127, 161), 173))}
    #: Kinds of bytes: white space, other ASCII but letters, letters, and what begins letters of two bytes.
    WHITE, MARK, LETTER, LEAD = 1, 2, 3, 4
    KINDS = np.repeat(np.array([MARK, 0, LEAD, 0], np.uint8), [0x80, 0x43, 0x06, 0x37])
    KINDS[[ord(c) for c in BLANKS]] = WHITE
    KINDS[ord("A") : ord("Z") + 1] = KINDS[ord("a") : ord("z") + 1] = LETTER

    #: All white space, by any definition.
    SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace())

    def __init__(self, tokenizer_json: str):
        self.vocabulary, self.tokenizer = tokenizer_json, None
        rules = json.loads(tokenizer_json)
        cuts, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
        self.plain = (
            cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space", True)
            and model.get("type") == "BPE" and not model.get("dropout")
            and not any(rules.get(x) for x in ("normalizer", "truncation", "padding"))
        )
        single = ("  ", "\n\n", " \n", "\n ")
        #: What keeps a text from being cut.
        self.odd = (
            *(() if self.plain else single),
            *(x["content"] for x in rules.get("added_tokens", ())),
            *(c for c in self.SPACES if c not in (BLANKS if self.plain else " \n")),
        )
        #: Ids by piece: those met lately, and the half before.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _library(self):
        if self.tokenizer is None:  # made where it is used: it does not travel
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.vocabulary)
        return self.tokenizer

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._library().encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x)}I", *x.ids) for x in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """``_encode`` of pieces that a text was cut into."""
        if not self.plain or not words:
            return self._encode(words)
        found: list[bytes | None] = []
        plain, tokenize = self.PLAIN.fullmatch, self._library().model.tokenize
        for word in words:
            if not plain(word):
                found.append(None)
                continue
            if word.isascii():
                word = word.replace(" ", "\u0120")
            else:
                word = word.encode().decode("latin-1").translate(self.SIGNS)
            ids = [x.id for x in tokenize(word)]
            found.append(struct.pack(f"<{len(ids)}I", *ids))
        rest = iter(self._encode([x for x, ids in zip(words, found) if ids is None]))
        return [next(rest) if ids is None else ids for ids in found]

    def _odd(self, text: str) -> bool:
        return any(x in text for x in self.odd)

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the pieces of texts that lie one after another begin, and the end of the last."""
        kind = self.KINDS[raw]
        cut = np.zeros(len(raw) + 1, bool)
        white = kind == self.WHITE
        if len(raw):
            more = np.append(white[1:], True)  # white space or the text's end comes next
            more[starts - 1] = True
            last = white & ~more
            cut[:-1] = last
            cut[1:-1] |= white[1:] & ~white[:-1]
            cut[1:] |= last & (raw != 0x20)
        if self.plain:
            letter = kind == self.LETTER
            # Of the letters of two bytes, the signs of times and division are none.
            letter[1:] |= (kind[:-1] == self.LEAD) & ~((raw[:-1] == 0xC3) & ((raw[1:] | 0x20) == 0xB7))
            cut[1:-1] |= letter[:-1] & (kind[1:] == self.MARK)
        cut[starts] = cut[-1] = True
        return np.flatnonzero(cut)

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of different pieces; of those met in earlier calls, the kept ones."""
        if len(self.known) > CACHED // 2:
            # Words that are met again come back from the older half; the others go.
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = iter(self._encode_words([words[k].decode() for k in missing if words[k] not in older]))
        for k in missing:
            word = words[k]
            found[k] = ids = older[word] if word in older else next(new)
            if len(word) <= CACHED_BYTES:
                known[word] = ids
        return found

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        """``_encode`` of texts that may be cut."""
        raw = [x.encode() for x in texts]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        starts = np.append(0, ends)[:-1]
        raw = np.frombuffer(b"".join(raw), np.uint8)
        cuts = self._cuts(raw, starts)
        if len(cuts) < 2:
            return [b""] * len(texts)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]
        ).dictionary_encode()
        ids = pa.array(self._ids_of(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        _, places, data = ids.buffers()
        places, data = np.frombuffer(places, np.int64), memoryview(data or b"")
        spans = zip(places[np.searchsorted(cuts, starts)], places[np.searchsorted(cuts, ends)])
        return [bytes(data[a:b]) for a, b in spans]

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [self._odd(x) for x in texts]
        whole = iter(self._encode([x for x, is_odd in zip(texts, odd) if is_odd]))
        cut = iter(self._encode_cut([x for x, is_odd in zip(texts, odd) if not is_odd]))
        return [next(whole if is_odd else cut) for is_odd in odd]


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begins and ends of blocks of texts: each ends where the bytes go over a multiple of ``BLOCK_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes, dtype=np.int64) // BLOCK_BYTES
    ends = [*(np.flatnonzero(np.diff(number)) + 1).tolist(), len(texts)]
    return zip([0, *ends], ends)


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int,
    planes: str = "byte",
    chunk: int = CHUNK,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encodes the texts, appends ``end_id`` to each, writes them in ascending order of doc_id.

    Returns the manifest (part, file, path, n_docs, n_ids), itself a written table. Documents are
    dealt by range of doc_id; a task writes its files under other names and then renames them, so one
    that runs again leaves the same files. Null texts count as empty, null doc_ids come first, equal
    doc_ids lie next to each other. The string of a special token in a text
    is that token, as in the library's plain call.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        encoder = sent(docs.sparkSession, ChunkedEncoder(f.read()))
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    end = np.array([end_id], IDS).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder()
        system, path = file_system(folder)
        part, made = TaskContext.get().partitionId(), []
        writer = out = temporary = None

        def finish() -> None:
            nonlocal writer
            writer.close()
            out.close()
            name = f"{path}/part-{part:06d}-{len(made):04d}.planes"
            system.move(temporary, name)
            made.append((part, len(made), name.rpartition("/")[2], len(writer.lengths), writer.n_ids))
            writer = None

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b in blocks(batch.column(1)):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                for doc_id, ids in zip(doc_ids[a:b], encode(texts)):
                    if writer is None:
                        temporary = f"{path}/_{uuid.uuid4().hex}"
                        out = system.open_output_stream(temporary)
                        writer = PlaneWriter(out, planes, chunk)
                    writer.add(doc_id, np.frombuffer(ids + end, IDS))
                    if writer.n_ids >= file_ids:
                        finish()
        if writer is not None:
            finish()
        columns = list(zip(*made)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            names=["part", "file", "path", "n_docs", "n_ids"],
        )

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        F.col("doc_id")
    ).sortWithinPartitions("doc_id")
    return stage(
        ordered.mapInArrow(write, "part int, file int, path string, n_docs long, n_ids long"), "manifest"
    )


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ``start`` counts all ids before the document.

    The manifest has a row a file, and only it passes through one task, to add up.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/{row['path']}") as file:
                    start, found, held = row["start"], [], 0
                    for doc_id, ids in PlaneReader(file):
                        found.append((doc_id, start, len(ids), ids.tobytes()))
                        start, held = start + len(ids), held + len(ids)
                        if held >= 1 << 22:
                            yield rows_of(found)
                            found, held = [], 0
                    yield rows_of(found)

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "ids"]
        )

    spread = files.select("path", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def ids_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "ids")

