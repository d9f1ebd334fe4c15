"""Periodic runs of words, tile by tile.

A run of period p, cut down to the places i whose word equals that p places on, is a stretch of at
least 2p equalities. Periods are dealt to octaves (2**(j-1), 2**j], the first being 1 to 8; a stretch of
octave j holds a multiple of 2**j, a boundary. Two Z-functions at a boundary, of what follows it and of
what lies before it reversed, give how far the stretch of every period of the octave reaches on either
side, up to twice the octave. A document is exploded into tiles, each with some boundaries of one octave
and the words round them; tiles overlap, are dealt out and solved on their own. A tile's fragments of
stretches are shuffled by (document, period) and stitched where they overlap or touch.

A boundary is only put into a tile if some period of the octave has the same eight words on both ends
of it, which every stretch of 16 places has at its boundaries. So texts without repeated words cost one
pass, and only tiles that may hold a run are shuffled, never the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.sources.workspace import stage

#: A run has at least so many words, and at least so many periods.
SHORTEST, TIMES = 24, 3
#: The first octave (periods to 2**3), words that both ends must share, words of a tile's boundaries.
FIRST, GRAM, SPAN = 3, 8, 1 << 14
#: Documents whose words are looked at together, and cells of a table of boundaries and periods.
TOGETHER, CELLS = 1024, 1 << 20

#: Replaces a document's words: (doc_id, number of words) -> the numbers of the words to read, or None.
Edit = Callable[[int | None, int], np.ndarray | None]

PARTS = (
    "doc_id {kind}, key long, done string, words binary, "
    "octave int, start long, bounds array<int>, codes array<int>"
)
FRAGMENTS = "key long, period long, lo long, hi long"
RESULT = (
    "doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def periods(octave: int) -> tuple[int, int]:
    """The least and the greatest period of an octave."""
    return (1 if octave == FIRST else (1 << octave - 1) + 1), 1 << octave


def least_stretch(period):
    """Equalities that a run of this period has at least: of a number or a column."""
    greatest = max if isinstance(period, int) else F.greatest
    one, other = SHORTEST - period, (TIMES - 1) * period
    return greatest(one, other)


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM words from each place on; unequal hashes mean unequal words."""
    g = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    for step, factor in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93)):
        g = g[:-step] * np.uint64(factor) + (g[step:] ^ (g[step:] >> np.uint64(29)))
    return g


def repeating(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the documents (codes one after the other, ``starts`` and the end) repeat a gram."""
    out = np.zeros(len(starts) - 1, bool)
    if len(codes) < GRAM:
        return out
    g = grams(codes)
    owner = np.repeat(np.arange(len(out)), np.diff(starts))[: len(g)]
    inside = np.arange(len(g)) + GRAM <= starts[owner + 1]
    g, owner = g[inside], owner[inside]
    g ^= owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.sort(g)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        out[owner[np.isin(g, twice)]] = True
    return out


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, list[int], np.ndarray]]:
    """(octave, start, boundaries counted from start, codes) of a document's tiles."""
    n = len(codes)
    if n < SHORTEST:
        return
    # Padded with numbers that agree with nothing, so that no place is out of range.
    g = grams(codes)
    octave = FIRST
    while TIMES * periods(octave)[0] <= n:
        low, high = periods(octave)
        high = min(high, n // TIMES)
        step, found = 1 << octave, []
        spans = np.arange(low, high + 1)
        rows = max(1, CELLS // len(spans))
        for first in range(0, n + 1, rows * step):
            at = np.arange(first, min(first + rows * step, n + 1), step)
            # After the boundary: grams at b and b + p. Before it: those that end there.
            hit = np.zeros(len(at), bool)
            for base in (at, at - GRAM):
                there = base[:, None] + spans
                fits = (base[:, None] >= 0) & (there < len(g))
                if fits.any():
                    here = g[np.clip(base, 0, len(g) - 1)][:, None]
                    hit |= (fits & (g[np.minimum(np.maximum(there, 0), len(g) - 1)] == here)).any(1)
            found.append(at[hit])
        found = np.concatenate(found)
        reach = 2 * step
        # Boundaries that lie close together share a tile, SPAN words of them or one at least.
        most = max(1, SPAN // step)
        breaks = np.flatnonzero(np.diff(found) > 2 * reach) + 1
        for group in np.split(found, breaks):
            for k in range(0, len(group), most):
                some = group[k : k + most]
                start = max(0, int(some[0]) - reach)
                yield octave, start, (some - start).tolist(), codes[start : int(some[-1]) + reach + step]
        octave += 1


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place below ``upto``, how many places from there on equal the beginning."""
    n, z = len(s), [0] * min(upto, len(s))
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def fragments(octave: int, start: int, bounds: list[int], codes: list[int]) -> list[tuple[int, int, int]]:
    """(period, lo, hi): the stretches through a tile's boundaries, merged within the tile."""
    low, high = periods(octave)
    reach = 2 << octave
    held: dict[int, list[int]] = {}
    out = []
    for b in bounds:
        after = codes[b : b + reach + high]
        p_most = min(high, len(after))
        if p_most < low:
            continue
        right = z_function(after, p_most + 1) + [0]
        before = codes[max(0, b - reach) : b][::-1]
        # Reversed from the place p_most after the boundary down; a stretch of period p begins p_most - p on.
        back = codes[max(0, b - reach) : b + p_most][::-1]
        m = len(before) + 1
        left = z_function([*before, -1, *back], m + p_most - low + 1)
        for p in range(low, p_most + 1):
            r, x = min(right[p], reach), left[m + p_most - p]
            if r + x < min(least_stretch(p), 2 * GRAM if octave == FIRST else 2 * p):
                continue
            lo, hi = start + b - x, start + b + r
            known = held.get(p)
            if known is not None and lo <= known[1]:
                known[1] = max(known[1], hi)
            else:
                if known is not None:
                    out.append((p, *known))
                held[p] = [lo, hi]
    return out + [(p, *x) for p, x in held.items()]


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """What the result says of a document with these words and (start, length, period) of its runs."""
    runs = sorted((s, n, p) for s, n, p in runs)
    runs.sort(key=lambda r: (r[0], r[2]))
    best, gone = None, np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        if best is None or (n * best[2], -s, -p) > (best[1] * p, -best[0], -best[2]):
            best = (s, n, p)
        gone[s + p] += 1
        gone[s + n] -= 1
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    if runs:
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return (
        len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(),
    )


def explode(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """One row for each document and one for each of its tiles, told apart by ``octave`` being null.

    A document without tiles is ``done``: its row holds the digest of its words. Of the others the words
    are kept. ``key`` numbers the rows of ``docs``; it holds for the written table only.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                texts = pc.fill_null(some.column(1), "")
                words = [x.encode().split() for x in texts.to_pylist()]
                counts = np.array([len(x) for x in words], np.int64)
                parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts)).filter(pa.array(counts > 0))
                codes = parts.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(counts)])
                ids = some.column(0).to_pylist()
                if edit is not None:
                    codes = codes.copy()
                    for d, doc_id in enumerate(ids):
                        order = edit(doc_id, len(words[d]))
                        if order is not None:
                            codes[starts[d] : starts[d + 1]] = codes[starts[d] + order]
                            words[d] = [words[d][i] for i in order]
                maybe = repeating(codes, starts)
                out = []
                for d, doc_id in enumerate(ids):
                    key += 1
                    found = list(tiles(codes[starts[d] : starts[d + 1]])) if maybe[d] else []
                    joined = b" ".join(words[d])
                    done = None if found else hashlib.sha256(joined).hexdigest()
                    out.append((doc_id, key, done, joined if found else None, None, None, None, None))
                    out += [
                        (None, key, None, None, octave, start, bounds, cut.tolist())
                        for octave, start, bounds, cut in found
                    ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column, kind)
                        for column, kind in zip(zip(*out), (
                            some.column(0).type, pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64(),
                            pa.list_(pa.int32()), pa.list_(pa.int32()),
                        ))
                    ],
                    names=["doc_id", "key", "done", "words", "octave", "start", "bounds", "codes"],
                )

    return stage(rows.mapInArrow(run, PARTS.format(kind=kind)), "tiles")


def solve(parts: DataFrame) -> DataFrame:
    """(key, period, lo, hi) of the stretches in each tile, every tile on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = fragments(row["octave"], row["start"], row["bounds"], row["codes"])
                if found:
                    columns = zip(*((row["key"], *x) for x in found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], names=["key", "period", "lo", "hi"]
                    )

    cut = parts.filter("octave is not null").select("key", "octave", "start", "bounds", "codes")
    return cut.repartition("key", "octave", "start").mapInArrow(run, FRAGMENTS)


def stitch(found: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs, from fragments of stretches.

    A stretch of a multiple of a run's period gives the same words; the smallest period stays.
    """
    order = Window.partitionBy("key", "period").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = found.withColumn("begins", F.when(before >= F.col("lo"), 0).otherwise(1))
    islands = begun.withColumn(
        "island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    stretches = islands.groupBy("key", "period", "island").agg(
        F.min("lo").alias("start"), F.max("hi").alias("hi")
    )
    long = stretches.filter(F.col("hi") - F.col("start") >= least_stretch(F.col("period")))
    return long.groupBy("key", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length")).agg(
        F.min("period").alias("period")
    )


def find_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): its runs, the strongest one, and what is left of it.

    A run is a stretch of words of smallest period p, SHORTEST words and TIMES periods long or longer, that
    no neighbour extends. ``collapsed_sha256`` is of the words that lie in no run after its first
    period. Words are what ASCII white space separates; null and empty texts have none, no runs, and the
    digests of nothing. Texts are searched whole, whatever their length: the tiles of a long one are
    spread over tasks, its fragments go by period, and the list of its runs comes together in one
    task again. Each of several rows with one doc_id, or without one, has a result of its own; an empty
    table gives an empty one; other columns are not read. ``edit`` may replace the words of a document
    by others of its words before the search; a query may need it to plant runs.
    """
    parts = explode(docs, edit)
    kind = parts.schema["doc_id"].dataType.simpleString()
    runs = stitch(solve(parts)).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    open_ = parts.filter("words is not null").select("key", "doc_id", "words").join(runs, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                rows = [
                    _summary(w.split(), [(r["start"], r["length"], r["period"]) for r in found or ()])
                    for w, found in zip(some.column(1).to_pylist(), some.column(2).to_pylist())
                ]
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                    names=[
                        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                        "collapsed_sha256",
                    ],
                )

    none = F.lit(None).cast("long")
    done = parts.filter("done is not null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"),
        none.alias("period"), none.alias("exponent_milli"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("done").alias("collapsed_sha256"),
    )
    return done.unionByName(open_.select("doc_id", "words", "runs").mapInArrow(run, RESULT.format(kind=kind)))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The edit of the query: every tenth document, by a hash, repeats a passage from some word on."""
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order
