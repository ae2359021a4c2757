"""Mixing sources to target weights: raking to several margins, then sampling by calibrated probabilities.

Token weights of the cells (one value per margin) are scaled to each margin's targets in turn until all hold. A document
of a cell stays with probability proportional to calibrated over present weight, at most one, scaled so that the
expected tokens are the asked share of all. The draw is a hash of the document's id, so that it repeats.

Only DataFrame functions run here. The table of cells is bounded by the targets: a value without a target counts as
``OTHER``, which has its own target or none (then it keeps its present share). Values without rows drop out and the
targets of the others are scaled up. Null values are values without a target; null text has no tokens and stays or goes
like its cell. A source with a third of all rows is one cell per other value, summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.llm.common import stored

OTHER = "(other)"
ROUNDS = 12
SEED = 42

Targets = dict[str, dict[str, float]]


def count_words(text: Column) -> Column:
    """Token weight of a text: its spaces and line feeds, plus one; zero for null and empty text."""
    gaps = cue_counts(text, (" ", "\n"))
    return F.when(F.length(text) > 0, gaps + 1).otherwise(0).cast("bigint")


def cue_counts(text: Column, cues: tuple[str, ...]) -> Column:
    """Occurrences of cue strings."""
    found = [((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / len(c)).cast("bigint") for c in cues]
    return sum(found[1:], found[0])


def topic(text: Column, topics: dict[str, tuple[str, ...]], default: str = "none") -> Column:
    """The topic whose cues occur most, the first of equals; ``default`` without any cue."""
    # One array, so that every text is searched once per cue however often the topic is named.
    ranked = [F.struct(F.coalesce(cue_counts(text, cues), F.lit(0)).cast("bigint").alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, cues) in enumerate(topics.items())]
    nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("order"), F.lit(default).alias("name"))
    return F.array_max(F.array(*ranked, nothing)).getField("name")


def _classes(df: DataFrame, margins: dict[str, Column], targets: Targets) -> DataFrame:
    """Adds one column ``__m0``, ``__m1``, ... per margin with the value or ``OTHER``."""
    for n, (name, value) in enumerate(margins.items()):
        known = F.create_map(*[F.lit(v) for v in targets[name] for _ in range(2)])
        df = df.withColumn(f"__m{n}", F.coalesce(F.try_element_at(known, value), F.lit(OTHER)))
    return df


def rake(cells: DataFrame, targets: Targets, rounds: int = ROUNDS) -> DataFrame:
    """``cells(__m0, ..., tokens)`` with ``weight``: shares of all tokens calibrated to every margin.

    The cells are bounded by the targets' sizes and fit one partition, in which no round needs a shuffle.
    """
    everything = Window.partitionBy()
    cells = cells.coalesce(1).withColumn("weight", F.col("tokens") / F.sum("tokens").over(everything))
    for n, wanted in enumerate(targets.values()):
        own = Window.partitionBy(f"__m{n}")
        target = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col(f"__m{n}")]
        fixed = [float(v) for v in wanted.values()]
        if OTHER not in wanted:
            # No target for the rest: it keeps its share, and the targets share what is left.
            present = F.sum(F.when(F.col(f"__m{n}") == OTHER, F.col("weight")).otherwise(0.0)).over(everything)
            target = F.when(F.col(f"__m{n}") == OTHER, present).otherwise(target / sum(fixed) * (1 - present))
        cells = cells.withColumn("__target", target).withColumn("__size", F.count(F.lit(1)).over(own))
        cells = cells.withColumn(f"__t{n}", F.col("__target") / F.sum(F.col("__target") / F.col("__size")).over(everything))
    for _ in range(rounds):
        for n in range(len(targets)):
            total = F.sum("weight").over(Window.partitionBy(f"__m{n}"))
            cells = cells.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"__t{n}") / total).otherwise(0.0))
    return cells


def probabilities(cells: DataFrame, keep: float) -> DataFrame:
    """``probability`` of every raked cell: ``min(1, s * weight / tokens)`` with expected tokens ``keep`` of all.

    Expected tokens are, at any ``s``, the least of the lines "the k cells with the largest ratio whole, the others in
    proportion"; hence the right ``s`` is the largest of those that the lines give.
    """
    everything = Window.partitionBy()
    margins = [c for c in cells.columns if c.startswith("__m")]
    upto = Window.orderBy(F.desc("ratio"), *margins).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    whole = F.coalesce(F.sum("tokens").over(upto), F.lit(0))
    rest = 1 - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    budget = F.lit(keep) * F.sum("tokens").over(everything)
    scale = F.when(rest > 1e-12, (budget - whole) / rest)
    cells = cells.withColumn("scale", scale).withColumn("scale", F.max("scale").over(everything))
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("scale") * F.col("ratio"))).otherwise(F.lit(keep)))


def draw(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to below 1 from a hash of the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample(
    df: DataFrame, margins: dict[str, Column], targets: Targets, tokens: Column, keep: float = 0.5, key: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """The sampled rows as struct ``__row``, with their margin values ``__m0``, ... and their ``probability``."""
    places = [f"__m{n}" for n in range(len(margins))]
    cells = stored(_classes(df, margins, targets).groupBy(*places).agg(F.sum(tokens).alias("tokens")), "cells")
    chances = probabilities(rake(cells, targets), keep).select(*places, "probability")
    packed = df.select(F.struct(*df.columns).alias("__row"), *[m.alias(f"__v{n}") for n, m in enumerate(margins.values())], F.col(key).alias("__key"))
    marked = _classes(packed, {name: F.col(f"__v{n}") for n, name in enumerate(margins)}, targets)
    # Broadcast: the cells are at most the product of the targets' sizes.
    drawn = marked.join(F.broadcast(stored(chances, "chances")), places).where(draw(F.col("__key"), seed) < F.col("probability"))
    return drawn.select("__row", *places, "probability")
