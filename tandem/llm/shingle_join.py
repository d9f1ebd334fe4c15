"""N-gram Jaccard self-join by universe partition and the pigeonhole principle, exact.

A document is the set of its distinct word shingles. Two sets that link differ in at most H shingles,
which their sizes bound. The universe of shingles is dealt by hash into segments, their number fixed
by a band of sizes; H differences spoil at most H segments, so all but H are equal in both sets.

A segment's part of a set is indexed by its hash. Not all need be: if both sets put their parts into
one common order and index the first H + 1, they share an indexed one. The order is by cost, larger
parts first, as they are the rarest and empty ones the most common; only the part itself decides, so
two sets agree. Where parts would be small, a plan with half the segments is cheaper: two sets that
differ in one shingle there still meet in a part with one shingle deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import worker_state
from tandem.llm.components import components
from tandem.sources.workspace import stage

SHINGLE, PERCENT = 4, 85
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEPS = tuple(np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: A word's hash is kept by the worker; so many at most.
WORDS = 200_000
#: Sets that a task has indexed and need not index again.
SEEN = 200_000
#: Members of a segment's list of which all pairs are tried at once.
SMALL = 6


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """The hash of a word, computed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; A-Z count as lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        size = len(h)
    total = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        total = mix(total * STEPS[k % len(STEPS)] + h[k : len(h) - size + 1 + k])
    return np.unique(total)


def identity(shingle_set: np.ndarray) -> int:
    """A signed 64-bit name of a set; its size tells apart the few that share one."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingle_set.tobytes())).astype(np.int64))


def most_different(sizes: int, percent: int) -> int:
    """The most shingles in which two linked sets differ that have ``sizes`` shingles together."""
    return (100 - percent) * sizes // (100 + percent)


def plan(band: int, percent: int) -> tuple[int, bool]:
    """Segments for sets of up to 2 ** (band + 1) - 1 shingles, and whether parts lose a shingle.

    The cost of a plan is the index rows of a set plus the rows that meet by chance: small parts are
    common. Whole parts need a segment more than there are differences; with deletions each segment
    stands two differences, so about half suffice, but a part gives a row for each of its shingles.
    """
    largest = 2 ** (band + 1) - 1
    differ = most_different(2 * largest, percent)
    whole = differ + 1
    halved = differ // 2 + 1

    def cost(segments: int, rows: float) -> float:
        held = largest / segments
        return rows * (1 + 64 * 4.0 ** -held)

    with_deletion = cost(2 * halved if halved > 1 else 1, largest + halved)
    return (halved, True) if with_deletion < cost(whole, whole) else (whole, False)


def contexts(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, H) of the pairs a set of n shingles can be in: those whose larger set lies in its own
    band, and in the next one if linked sets reach it."""
    own = n.bit_length() - 1
    reach = 100 * n // percent
    found = [(own, most_different(n + min(reach, 2 ** (own + 1) - 1), percent))]
    if reach >= 2 ** (own + 1):
        found.append((own + 1, most_different(n + reach, percent)))
    return found


def signatures(shingle_set: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(band, index keys) of a set for each band it takes part in; the keys are signed 64-bit."""
    n = len(shingle_set)
    for band, differ in contexts(n, percent) if n else ():
        segments, deletion = plan(band, percent)
        salt = mix(np.uint64([band + 1]) * STEPS[0])[0]
        token = mix(shingle_set ^ salt)
        segment = (token % np.uint64(segments)).astype(np.int64)
        count = np.bincount(segment, minlength=segments)
        order = np.argsort(segment, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(token[order])])
        ends = np.cumsum(count)
        part = total[ends] - total[ends - count]
        name = mix(np.arange(segments, dtype=np.uint64) * STEPS[1] + salt)
        key = mix(part + name)
        if deletion:
            # A part and each part with one shingle less; both sets give all of them.
            less = mix((part + name)[segment] - token)
            yield band, np.unique(np.concatenate([key, less])).view(np.int64)
        else:
            yield band, key[np.lexsort((key, -count))[: differ + 1]].view(np.int64)


def sketch(shingle_set: np.ndarray) -> bytes:
    """Whether each of a power of two of fine segments, 256 at least, holds an odd number of shingles, a
    bit each. Two sets differ in no fewer shingles than bits, so bits can rule out a link but never hide
    one. The sketch of half as many segments is the exclusive or of both halves."""
    size = max(256, 4 << max(0, len(shingle_set).bit_length() - 1))
    segment = (mix(shingle_set ^ STEPS[2]) % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(segment, minlength=size) & 1).astype(np.uint8)).tobytes()


def alike_length(sketches: list[bytes], to: int) -> np.ndarray:
    """A row for each sketch, brought to ``to`` bytes."""
    out = np.empty((len(sketches), to), np.uint8)
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for length in np.unique(lengths):
        here = np.flatnonzero(lengths == length)
        of = np.frombuffer(b"".join(sketches[i] for i in here), np.uint8).reshape(len(here), length)
        while of.shape[1] > to:
            half = of.shape[1] // 2
            of = of[:, :half] ^ of[:, half:]
        out[here] = of
    return out


def differences(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many bits rows differ."""
    return np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole lists of equal first column, from batches sorted by it, as many as there are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield _columns(held)
            held = []
        cut = int(np.searchsorted(keys != keys[-1], False)) if keys[0] == keys[-1] else int(
            np.flatnonzero(keys != keys[-1])[-1] + 1
        )
        if cut:
            yield _columns([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    whole = pa.Table.from_batches(batches)
    return [whole.column(i).to_numpy() for i in range(whole.num_columns)]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sig, node) sorted by both: pairs (a, b), and the members of long lists.

    Short lists give all their pairs. Long ones give pairs with their first three members and with
    the member before, so as many rows as members; what that leaves out is for ``_across``.
    """
    for sig, node in _buckets(batches):
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.concatenate([start, [len(sig)]]))
        first, of = np.repeat(start, size), np.repeat(size, size)
        place = np.arange(len(sig)) - first
        a, b = [], []
        for back in range(1, SMALL):
            here = np.flatnonzero((place >= back) & ((of <= SMALL) | (back == 1)))
            a.append(node[here - back])
            b.append(node[here])
        for pivot in range(3):
            here = np.flatnonzero((of > SMALL) & (place > pivot + 1))
            a.append(node[first[here] + pivot])
            b.append(node[here])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        long = np.flatnonzero(of > SMALL)
        n, m = len(pairs), len(long)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([False, True], [n, m])),
                pa.array(np.concatenate([np.zeros(n, np.int64), sig[long]])),
                pa.array(np.concatenate([pairs[:, 0], node[long]])),
                pa.array(np.concatenate([pairs[:, 1], node[long]])),
            ],
            names=["member", "sig", "a", "b"],
        )


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (sig, node, root, n, sketch) sorted by sig: the pairs of a list that are in different
        components and that sizes and sketches do not rule out."""
        for sig, node, root, n, sketches in _buckets(batches):
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            for lo, hi in zip(start, [*start[1:], len(sig)]):
                some = sketches[lo:hi].tolist()
                of = alike_length(some, min(map(len, some)))
                size, root_of, node_of = n[lo:hi], root[lo:hi], node[lo:hi]
                step = max(1, (1 << 18) // (hi - lo))
                for k in range(0, hi - lo, step):
                    i = slice(k, k + step)
                    small = np.minimum(size[i, None], size[None])
                    large = np.maximum(size[i, None], size[None])
                    may = (100 * small >= percent * large) & (root_of[i, None] != root_of[None])
                    x, y = np.nonzero(may)
                    x += k
                    x, y = x[x < y], y[x < y]
                    near = []
                    many = max(1, (1 << 24) // of.shape[1])
                    for at in range(0, len(x), many):
                        p, q = x[at : at + many], y[at : at + many]
                        near.append(differences(of[p], of[q]) <= most_different(size[p] + size[q], percent))
                    keep = np.concatenate(near) if near else np.zeros(0, bool)
                    a, b = node_of[x[keep]], node_of[y[keep]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
                    )

    return run


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b, shared) that sizes and sketches (node, n, sketch) do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy() for k in (3, 5))
            one, two = (batch.column(k).to_pylist() for k in (4, 6))
            may = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            shorter = np.array([min(len(x), len(y)) for x, y in zip(one, two)], np.int64)
            for length in np.unique(shorter[may]):
                here = np.flatnonzero(may & (shorter == length))
                left, right = (alike_length([side[i] for i in here], int(length)) for side in (one, two))
                may[here] = differences(left, right) <= most_different(n_a[here] + n_b[here], percent)
            yield batch.select(["a", "b", "shared"]).filter(pa.array(may))

    both = pairs
    for side in "ab":
        both = both.join(
            sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")),
            side,
        )
    return both.select("a", "b", "shared", "n_a", "s_a", "n_b", "s_b").mapInArrow(
        run, "a long, b long, shared long"
    )


def _sets(docs: DataFrame, size: int, schema: str, rows) -> DataFrame:
    """``rows(key, set)`` of each row (key, text), in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("shingle_words", WordHashes)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                sets = [shingles(x, hashes, size) for x in some.column(1).to_pylist()]
                yield rows(some.column(0), sets)

    return docs.mapInArrow(run, schema)


def members(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, node, sketch): each row's number of shingles, and the name and the sketch of its set,
    null if empty."""

    def rows(key, sets):
        names = [identity(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                key, pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()),
                pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "n", "node", "sketch"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _sets(docs.select("doc_id", "text"), size, f"doc_id {kind}, n long, node long, sketch binary", rows)


def index(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(sig, node): the index keys of each distinct set; a task gives a set once, or seldom more."""
    seen: set[int] = set()

    def rows(key, sets):
        sig, node = [], []
        for s in sets:
            name = identity(s)
            if not len(s) or name in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
            for _, keys in signatures(s, percent):
                sig.append(keys)
                node.append(np.full(len(keys), name, np.int64))
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([none, *sig])),
                pa.array(np.concatenate([none, *node])),
            ],
            names=["sig", "node"],
        )

    return _sets(docs.select("doc_id", "text"), size, "sig long, node long", rows)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by their whole intersection."""
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("set_b"))
    both = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
        .filter(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common")))
        .select("a", "b")
    )


def settled(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all that the candidate pairs (a, b, shared) can join, and their components.

    Each set is first held against one partner, that with which it shares most index keys, so whole
    sets are moved once a set and not once a pair. Of the other pairs only those between the components
    that this leaves are verified.
    """
    likeliest = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select("best.a", "b")
    near = stage(verified(likeliest, sets, percent), "near")
    known = components(near)
    left, right = (
        known.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")) for side in "ab"
    )
    others = pairs.join(likeliest, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left")
    between = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    others = stage(others.filter(between).select("a", "b"), "others")
    if others.isEmpty():
        return near, known
    more = stage(verified(others, sets, percent), "near")
    if more.isEmpty():
        return near, known
    near = near.unionByName(more)
    return near, components(near)


def links(docs: DataFrame, of: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of all sets that link with another; ``of`` is what ``members`` returns.

    Links inside a component that is already known are not looked for; none between components is
    missed.
    """
    keys = index(docs, size, percent).repartition("sig").sortWithinPartitions("sig", "node")
    found = stage(keys.mapInArrow(_candidates, "member boolean, sig long, a long, b long"), "candidates")
    candidates = stage(
        found.filter("not member").groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs"
    )
    distinct = of.filter("node is not null")
    first = distinct.groupBy("node").agg(F.min("doc_id").alias("of_doc"))

    def sketches(nodes: DataFrame) -> DataFrame:
        shown = distinct.select("node", "n", "sketch").join(nodes, "node", "left_semi")
        return shown.dropDuplicates(["node"])

    def sets(pairs: DataFrame) -> DataFrame:
        """(node, items) of the sets in the pairs, from a document of each."""
        nodes = stage(_ends(pairs), "ends")
        wanted = stage(first.join(nodes, "node", "left_semi").select("of_doc").distinct(), "wanted")
        texts = docs.select("doc_id", "text").join(
            wanted, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left_semi"
        )
        # A doc_id may be on several rows; one set each is kept.
        made = _sets(texts, size, "node long, items array<long>", _items)
        return stage(made.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")

    seen = stage(sketches(_ends(candidates)), "sketches")
    pairs = stage(possible(candidates, seen, percent), "possible")
    near, known = settled(pairs, sets(pairs), percent)

    long = found.filter("member").select("sig", F.col("a").alias("node"))
    long = stage(
        long.join(known, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root")),
        "lists",
    )
    mixed = long.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_lists = long.join(mixed.filter("lo <> hi").select("sig"), "sig", "left_semi")
    shown = open_lists.join(seen, "node").select("sig", "node", "root", "n", "sketch")
    rest = shown.repartition("sig").sortWithinPartitions("sig").mapInArrow(
        _across(percent), "a long, b long"
    )
    rest = stage(rest.distinct().join(candidates, ["a", "b"], "left_anti"), "rest")
    if rest.isEmpty():
        return known
    late = stage(verified(rest, sets(rest), percent), "late")
    return components(near.unionByName(late))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _items(key: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    items = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([identity(s) for s in sets], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(items)),
        ],
        names=["node", "items"],
    )


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Texts are cut into words at ASCII white space, A-Z lower-cased; the set is that of the hashes of
    ``size`` words in a row, or of the whole text if it has fewer. Two rows link when their sets have
    at least ``percent`` per cent of their union in common. ``component_id`` is the smallest doc_id that
    links reach; a row without words, or with null text, reaches itself only. Equal sets are one node
    from the start, so copies cost nothing in the join. Null doc_ids are never the smallest; a component
    of them alone has null. Rows with equal doc_ids are rows of their own. Other columns are not read.
    Shingles and sets are compared by 64-bit hashes.
    """
    of = stage(members(docs, size), "members")
    roots = links(docs, of, size, percent)
    nodes = stage(
        of.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        .join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")),
        "nodes",
    )
    least = stage(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stage(nodes.join(least, "root").select("node", "component_id"), "named")
    return of.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
