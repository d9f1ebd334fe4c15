"""Corpus and example build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as V
from tandem.operators.examples import fill, triple, with_pair_id
from tandem.operators.groups import split_groups, with_group
from tandem.operators.pairs import dedup_pairs, min_chars, union_sources
from tandem.operators.sample import cap, shuffle_pos, split, split_at
from tandem.sources.workspace import stage


def build_corpus(
    sources: Sequence[tuple[str, DataFrame]], order: Sequence[str] = ("ord",)
) -> DataFrame:
    """Deduplicated pairs of all sources, the earlier source and then the earlier row winning.

    Each source is (name, clean pairs from ``to_pairs`` that carry the ``order`` columns); in one that
    ``read_splits`` read, keep its ``split_ord`` too: earlier splits then win over later ones. One
    exchange, on the pair.
    """
    if any("split_ord" in df.columns for _, df in sources) and "split_ord" not in order:
        order = ("split_ord", *order)
    return dedup_pairs(union_sources(sources), ("pri", *order))


def prepare_examples(
    corpus: DataFrame,
    seed: int = V.SEED,
    max_pairs: int | None = None,
    system: str = V.SYSTEM_PROMPT,
    split_pairs: bool = True,
    unique: bool = False,
    split_sides: bool = False,
) -> DataFrame:
    """Examples with their split: cap, minimum length, fan-out, split, in that order.

    Examples are shuffled: ``pos`` is their place in the seeded order of all, and of those of a split.
    Ids and bare pairs are ranked, and the prompts filled in after. By default the split is drawn on
    pairs, so that the three examples of a pair stay together; with ``split_pairs=False`` it is drawn
    on examples, which lets a pair appear in train and test alike. ``split_sides=True`` keeps all pairs
    together that share a source or a target, case aside (``split_groups``): where sources have several
    targets, only this keeps every prompt and every answer in one split. Its sizes count pairs.

    Repeated pairs are kept, count towards the cap, and share their split, whose sizes then count
    different pairs. ``unique`` states that there are none, as ``build_corpus`` leaves it, which spares
    a pass over the ids and a shuffle under a cap. A cap reads the corpus more than once, so pass one
    that was written. The kept pairs are staged with their ids: the passes
    that look for the cuts then read the ids and not the texts.
    """
    pairs = corpus.select("source", "target", "source_lang", "target_lang")
    if max_pairs is not None:
        pairs = cap(pairs, max_pairs, seed, ("source", "target"), unique=unique)
    pairs = stage(with_pair_id(min_chars(pairs)), "pairs")
    if split_sides:
        pairs = split_groups(stage(with_group(pairs), "grouped"), seed=seed).drop("group_id")
    elif split_pairs:
        pairs = split(pairs, seed=seed, by=("pair_id",), unique=unique)
    placed = shuffle_pos(triple(pairs), f"{seed}/examples", ("pair_id", "kind"), unique=unique)
    if not (split_sides or split_pairs):
        placed = split_at(placed)
    return fill(placed, seed, system=system).select(
        "pair_id", "kind", "pos", "prompt", "completion", "split"
    )
