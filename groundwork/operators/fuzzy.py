"""Fuzzy self-join of a name column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.similarity import BOOST_ABOVE, PREFIX_LENGTH, PREFIX_SCALE, jaro_winkler_pinned
from groundwork.sources.scratch import checkpointed

# Common letters first. Only the speed depends on the order: rare characters make
# selective join keys.
COMMON_FIRST = " etaoinshrdlcumwfgypbvkjxqz"

# Ratio between the lengths of neighbouring size classes.
SIZE_STEP = 1.15


def least_jaro(min_score: float) -> float:
    """Smallest Jaro score that can still reach ``min_score`` after the longest boost."""
    boost = PREFIX_SCALE * PREFIX_LENGTH
    return min_score if min_score <= BOOST_ABOVE else max(BOOST_ABOVE, (min_score - boost) / (1 - boost))


def _mask(tokens: Column) -> Column:
    """One bit per token, 64 in all; tokens falling on a taken bit are the set's spare ones."""
    one = F.lit(1).cast("bigint")

    def with_bit(mask: Column, token: Column) -> Column:
        return mask.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.hash(token), F.lit(64))))

    return F.aggregate(tokens, F.lit(0).cast("bigint"), with_bit)


def _size_class(length: Column) -> Column:
    """Lengths in steps of ``SIZE_STEP``: few classes to meet, even for long names."""
    return F.floor(F.log(length) / math.log(SIZE_STEP)).cast("int")


def _tokens(text: Column) -> Column:
    """Characters as a set: the second "a" is another token than the first; rare ones first."""
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    numbered = F.transform(
        chars,
        lambda ch, i: F.struct(
            F.when(F.instr(F.lit(COMMON_FIRST), ch) == 0, 0)
            .otherwise(len(COMMON_FIRST) + 1 - F.instr(F.lit(COMMON_FIRST), ch))
            .alias("commonness"),
            ch.alias("ch"),
            F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda other: other == ch)).alias("nth"),
        ),
    )
    return F.transform(F.array_sort(numbered), lambda t: F.concat(t["ch"], t["nth"].cast("string")))


def fuzzy_pairs(df: DataFrame, column: str, block: int = 0, min_score: float = 0.9) -> DataFrame:
    """(name_a, name_b, rows_a, rows_b, score): distinct names whose Jaro-Winkler score is at least
    ``min_score``; name_a < name_b. With ``block``, only names that share their first ``block``
    characters are compared, and shorter names are left out.

    Not every pair is formed. Two strings of lengths m and n with Jaro score j
    share at least (3j - 1) * m * n / (m + n) characters, so sorted by rarity they must share
    one of the first few. Names join on block, both size classes and such a character, which
    spreads one large block over many keys; a bit mask of all characters drops most pairs
    where they meet, before anything about them is shuffled or scored. Both bounds are exact:
    no qualifying pair is missed. The higher ``min_score``, the fewer pairs meet.
    """
    spread = 3 * least_jaro(min_score) - 1
    if spread <= 1:
        raise ValueError("min_score is too low to bound the lengths of matching names")
    names = (
        df.where(F.length(column) >= max(block, 1))
        .groupBy(F.col(column).alias("name"))
        .agg(F.count("*").alias("rows"))
        .select("name", "rows", F.length("name").alias("len"), F.substring("name", 1, block).alias("block"))
        .withColumn("tokens", _tokens(F.substring("name", block + 1, 1 << 30)))
        .withColumn("mask", _mask(F.col("tokens")))
        .withColumn("spare", F.size("tokens") - F.bit_count("mask"))
    )
    # Both sides of the join start from the distinct names, prepared once.
    names = checkpointed(names)
    own = F.col("len").cast("double")
    # Lengths a partner may have: its overlap cannot exceed the shorter name.
    shortest = F.greatest(F.floor(own * (spread - 1)), F.lit(max(block, 1))).cast("double")
    longest = F.ceil(own / (spread - 1)).cast("double")
    # The least overlap with any partner of the other size class; the block is shared by all.
    least = F.greatest(F.floor(F.pow(F.lit(SIZE_STEP), "other")) - 1, shortest)
    needed = F.ceil(spread * own * least / (own + least) - 1e-9).cast("int") - block
    keyed = (
        names.withColumn("size", _size_class(own))
        .withColumn("other", F.explode(F.sequence(_size_class(shortest), _size_class(longest))))
        .withColumn("needed", needed)
        .withColumn(
            "keys",
            F.when(F.col("needed") <= 0, F.array_append("tokens", F.lit(""))).otherwise(
                F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - F.col("needed") + 1, F.lit(0)))
            ),
        )
        .select("name", "rows", "len", "block", "size", "other", "mask", "spare", F.explode("keys").alias("key"))
    )
    a = keyed.where(F.col("size") <= F.col("other")).alias("a")
    b = keyed.where(F.col("size") >= F.col("other")).alias("b")
    together = F.col("a.len") + F.col("b.len")
    enough = spread * F.col("a.len") * F.col("b.len") / together - 1e-9 - block
    candidates = (
        a.join(
            b,
            (F.col("a.block") == F.col("b.block"))
            & (F.col("a.size") == F.col("b.other"))
            & (F.col("a.other") == F.col("b.size"))
            & (F.col("a.key") == F.col("b.key"))
            & ((F.col("a.size") < F.col("b.size")) | (F.col("a.name") < F.col("b.name")))
            # An upper bound of the overlap, by one bit operation per pair.
            & (F.bit_count(F.col("a.mask").bitwiseAND(F.col("b.mask"))) + F.least("a.spare", "b.spare") >= enough),
        )
        .select(
            F.least("a.name", "b.name").alias("name_a"),
            F.greatest("a.name", "b.name").alias("name_b"),
            F.when(F.col("a.name") < F.col("b.name"), F.col("a.rows")).otherwise(F.col("b.rows")).alias("rows_a"),
            F.when(F.col("a.name") < F.col("b.name"), F.col("b.rows")).otherwise(F.col("a.rows")).alias("rows_b"),
        )
        # Scoring costs far more than its bytes suggest, so these partitions are not coalesced.
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name_a", "name_b")
        .distinct()
    )
    scored = candidates.withColumn("score", jaro_winkler_pinned(F.col("name_a"), F.col("name_b")))
    return scored.where(F.col("score") >= min_score).withColumn("score", F.round("score", 6))
