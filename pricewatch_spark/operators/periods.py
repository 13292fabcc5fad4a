"""State periods kept up to date by batches, without reading the history again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewatch_spark.operators.delta import state_periods
from pricewatch_spark.sources.tables import reliable


@dataclass(frozen=True)
class Step:
    """What a batch does to the periods.

    closed: periods that have ended, to be added to the closed ones.
    open: the open period of every key, the next version of that table.
    late: keys with a row at or before their last point; nothing of theirs is in closed, and open has their old period.
    """

    closed: DataFrame
    open: DataFrame
    late: DataFrame


def _equal(left: DataFrame, right: DataFrame, key: list[str], prefix: str = ""):
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in key))


def no_periods(history: DataFrame, key: list[str], state: list[str], at: str, *tie: str) -> DataFrame:
    """The open periods before the first batch."""
    return state_periods(history.limit(0), key, state, at, *tie, ends=True).select(*key, "period", *state, "valid_from", "valid_to", "points", "last")


def advance(open_periods: DataFrame, batch: DataFrame, key: list[str], state: list[str], at: str, *tie: str) -> Step:
    """One batch of points put onto the open periods.

    A batch's own runs are found among its rows alone; the first run of a key goes on with the open period if the states
    are equal and ends it otherwise.  Each key's open period is one row, so no history is read; a batch costs its own rows
    and one join to the open periods of its keys.  Null keys, states and values of tie are values like others; a
    row without a time is late, as one that comes after a later one.  An empty batch changes nothing.
    """
    columns = [*key, "period", *state, "valid_from", "valid_to", "points", "last"]
    one_key = Window.partitionBy(*key)
    runs = state_periods(batch, key, state, at, *tie, ends=True).withColumns({"begins": F.min("first").over(one_key), "began_as": F.min_by(F.struct(*state), "period").over(one_key)})
    known = open_periods.select(*(F.col(c).alias(f"o_{c}") for c in key), F.struct(*columns).alias("o"))
    joined = runs.join(known, _equal(runs, known, key, "o_"), "left")
    there = F.col("o").isNotNull()
    goes_on = there & F.col("began_as").eqNullSafe(F.struct(*(F.col(f"o.{c}").alias(c) for c in state)))
    first = F.col("period") == 1
    late = there & F.coalesce((F.col("begins") <= F.col("o.last")) | F.col(f"begins.{at}").isNull(), F.lit(True))
    now = F.struct(
        *key,
        (F.col("period") + F.when(~there, 0).when(goes_on, F.col("o.period") - 1).otherwise(F.col("o.period"))).alias("period"),
        *state,
        F.when(first & goes_on, F.col("o.valid_from")).otherwise(F.col("valid_from")).alias("valid_from"),
        "valid_to",
        (F.col("points") + F.when(first & goes_on, F.col("o.points")).otherwise(0)).alias("points"),
        "last",
    )
    ended = F.struct(*(F.col("valid_from").alias(c) if c == "valid_to" else F.col(f"o.{c}").alias(c) for c in columns))
    out = F.array_compact(F.array(now, F.when(first & there & ~goes_on, ended)))
    # closed, open and late periods are all read from it
    touched = reliable(joined.select(late.alias("late"), F.explode(out).alias("r")).select("late", "r.*"))
    settled = touched.where(~F.col("late"))
    fresh = settled.where("valid_to is null").select(*columns)
    untouched = open_periods.join(fresh.select(*(F.col(c).alias(f"f_{c}") for c in key)), reduce(lambda a, b: a & b, (open_periods[c].eqNullSafe(F.col(f"f_{c}")) for c in key)), "left_anti")
    return Step(settled.where("valid_to is not null").select(*columns), untouched.select(*columns).unionByName(fresh), touched.where("late").select(*key).distinct())


def catch_up(closed: DataFrame, step: Step, history: DataFrame, key: list[str], state: list[str], at: str, *tie: str) -> tuple[DataFrame, DataFrame]:
    """(closed, open) after a step: late keys are told anew from their own history (all points, the batch's included)."""
    late = step.late.select(*(F.col(c).alias(f"l_{c}") for c in key))
    on = lambda df: reduce(lambda a, b: a & b, (df[c].eqNullSafe(F.col(f"l_{c}")) for c in key))
    anew = state_periods(history.join(late, on(history), "left_semi"), key, state, at, *tie, ends=True).select(*closed.columns)
    kept = closed.join(late, on(closed), "left_anti").unionByName(step.closed).unionByName(anew.where("valid_to is not null"))
    still = step.open.join(late, on(step.open), "left_anti").unionByName(anew.where("valid_to is null"))
    return kept, still
