"""Preference formatting: the common turns of two conversations once, as prompt, and the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written.
TURN_HEAD, TURN_MIDDLE, TURN_END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations_as_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """(pair_id, chosen, rejected): the turns of both sides of each pair, in order.

    ``pair`` names the pair of a turn and ``chosen`` says which side it belongs
    to.  Turns are ordered by turn, role and text; repeated rows count once,
    and null roles or texts are empty.  A side without turns is an empty list;
    turns without pair or side are left out.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("_chosen"), turn.alias("_turn")).filter("pair_id IS NOT NULL AND _chosen IS NOT NULL")
    side = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("_turn"))))
    return rows.groupBy("pair_id").agg(side(F.col("_chosen")).alias("chosen"), side(~F.col("_chosen")).alias("rejected"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN_HEAD), t["role"], F.lit(TURN_MIDDLE), t["text"], F.lit(TURN_END))), "")


def mask(turns: Column) -> Column:
    """One character per turn: 1 where the loss counts, 0 where it is masked."""
    return F.array_join(F.transform(turns, lambda t: F.when(t["role"] == TRAINED_ROLE, "1").otherwise("0")), "")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns with the same role and text."""
    same = F.zip_with(chosen, rejected, lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    shorter = F.least(F.size(chosen), F.size(rejected))
    differs = F.array_position(same, F.lit(False)).cast("int")
    return F.when(differs == 0, shorter).otherwise(F.least(differs - 1, shorter))


def with_completions(pairs: DataFrame) -> DataFrame:
    """Append ``n_common``, ``prompt``, and for each side the completion with its mask.

    The prompt has the longest common turn prefix and is masked as a whole; a
    completion is what follows it, and only its assistant turns are trained
    on.  ``usable`` is false where a side has nothing to train on, as with
    identical conversations or a missing side; such pairs stay in the result.
    """
    counted = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.size(side))
    out = counted.withColumn("prompt", rendered(F.slice("chosen", F.lit(1), F.col("n_common"))))
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_completion", rendered(rest(F.col(side)))).withColumn(f"{side}_mask", mask(rest(F.col(side))))
    trained = lambda side: F.contains(F.col(f"{side}_mask"), F.lit("1"))
    return out.withColumn("usable", trained("chosen") & trained("rejected"))
