"""Questions to the price history, tiers and bulk prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HEADER = ["title", "current_price", "current_stock", "current_availability"]


def listing_history(listings: DataFrame, history: DataFrame, key: list[str], at: list[str], n: int = 100) -> DataFrame:
    """latest_history below each listing's header (title and current state); a listing without points keeps one row.

    listings: key, title, current_price, current_stock, availability.  A current price of 0 is shown as null.
    """
    header = listings.withColumns({"current_price": F.when(F.col("current_price") != 0, F.col("current_price")), "current_availability": F.col("availability")})
    return header.select(*key, *HEADER).join(latest_history(history, key, at, n), key, "left")


def latest_history(history: DataFrame, key: list[str], at: list[str], n: int = 100) -> DataFrame:
    """The last n (at most 1000) points of each listing, numbered from the oldest kept."""
    newest = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in at))
    kept = history.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= min(n, 1000))
    return kept.withColumn("point", F.row_number().over(Window.partitionBy(*key).orderBy(*at))).drop("_back")


def price_series(history: DataFrame, key: list[str], at: list[str], price: str = "price") -> DataFrame:
    """Previous price, change, change in per cent (null after a price of 0), lowest and highest so far, days until the next point."""
    order = Window.partitionBy(*key).orderBy(*at)
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumns(
        {
            "prev_price": F.lag(price).over(order),
            "change_abs": F.col(price) - F.lag(price).over(order),
            "change_pct": F.try_divide(100 * (F.col(price) - F.lag(price).over(order)).cast("double"), F.lag(price).over(order).cast("double")),
            "low_so_far": F.min(price).over(sofar),
            "high_so_far": F.max(price).over(sofar),
            "days_at_price": F.date_diff(F.lead(at[0]).over(order), F.col(at[0])),
        }
    )


def state_as_of(history: DataFrame, key: list[str], at: list[str], moment: Column, values: list[str]) -> DataFrame:
    """The last known values at a moment, one row a listing that was known then."""
    known = history.where(F.col(at[0]) <= moment)
    return known.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*at)).alias("v")).select(*key, *(F.col(f"v.{c}").alias(c) for c in values))


def states_as_of(history: DataFrame, points: DataFrame, key: list[str], at: str, tie: str, value: str) -> DataFrame:
    """points (key, at) with the value in force at each: one union and one window, no range join."""
    order = Window.partitionBy(*key).orderBy(at, "_kind", tie).rowsBetween(Window.unboundedPreceding, 0)
    facts = history.select(*key, at, tie, value, F.lit(0).alias("_kind"))
    asked = points.select(*key, at, F.lit(None).cast(dict(history.dtypes)[tie]).alias(tie), F.lit(None).cast(dict(history.dtypes)[value]).alias(value), F.lit(1).alias("_kind"))
    both = facts.unionByName(asked)
    return both.withColumn("as_of_value", F.last(value, ignorenulls=True).over(order)).where("_kind = 1").select(*key, at, "as_of_value")


def _micros(column: str, zoned: bool) -> Column:
    """A time as a number that keeps the order of times; no zone is applied to times that have none."""
    if zoned:
        return F.unix_micros(F.col(column).cast("timestamp"))
    at = F.col(column).cast("timestamp_ntz")
    seconds = F.hour(at) * 3600 + F.minute(at) * 60
    days = F.date_diff(at, F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def tiers_as_of(tiers: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """points with the tiers in force: valid_from <= at < valid_to (open if null).

    A join on (key, level, bin): a tier's level is the power of two (microseconds) that its length does not exceed,
    so it lies in one bin of that width or in two, and a point looks into one bin of each level in use.  A point
    meets tiers about as long as the bin around it alone, so a key with very many tiers costs what it gives, and is
    spread over its bins.  Tiers may overlap; open ones end behind the last point.  Read ahead: the first and the
    last point, and the levels in use (64 at most).
    """
    zoned = "timestamp" in (dict(points.dtypes)["at"], dict(tiers.dtypes)["valid_from"], dict(tiers.dtypes)["valid_to"])
    reach = points.agg(F.min(_micros("at", zoned)), F.max(_micros("at", zoned))).first()
    if reach[0] is None:
        reach = (0, 0)
    since = _micros("valid_from", zoned)
    until = F.least(F.coalesce(_micros("valid_to", zoned), F.lit(reach[1] + 1)), F.lit(reach[1] + 1))
    seen = tiers.select(F.col(key).alias("t_key"), "tier_name", "price", "valid_from", "valid_to", F.greatest(since, F.lit(reach[0])).alias("since"), until.alias("until"))
    # a power of two that the length doesn't exceed: as many bits as length - 1 has
    leveled = seen.where("since < until").withColumn("level", F.when(F.expr("until - since = 1"), 0).otherwise(F.length(F.bin(F.expr("until - since - 1")))))
    levels = sorted(r[0] for r in leveled.select("level").distinct().collect())
    both = F.array_distinct(F.array(F.expr("shiftright(since, level)"), F.expr("shiftright(until - 1, level)")))
    placed = leveled.withColumn("slot", F.explode(both)).drop("since", "until")
    looks = F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright(_micros("at", zoned), n).alias("slot")) for n in levels)).cast("array<struct<level int, slot bigint>>")
    asked = points.select("*", F.explode(looks).alias("look")).alias("p")
    placed = placed.alias("t")
    inside = (F.col("t.valid_from") <= F.col("p.at")) & (F.col("t.valid_to").isNull() | (F.col("p.at") < F.col("t.valid_to")))
    met = (F.col(f"p.{key}") == F.col("t.t_key")) & (F.col("p.look.level") == F.col("t.level")) & (F.col("p.look.slot") == F.col("t.slot"))
    return asked.join(placed, met & inside).select(*(F.col(f"p.{c}") for c in points.columns), "t.tier_name", "t.price", "t.valid_from")


#: Units of time, in microseconds, that points may have in common.
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def tiers_summary(tiers: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """points with what tiers_as_of would join to each, summed up without joining it: how many tiers are in
    force, their lowest price and their newest valid_from.  Points without a tier are left out.

    Time is counted in the largest unit that all points have in common.  A tier covers a run of these places, cut
    into at most two aligned pieces of each power of two; pieces that are equal are summed up once, and a point
    sums up the pieces around its place, one a power.  Tiers and points cost a number of rows that grows with the
    logarithm of the time spanned, however many tiers are in force at a point.  Read ahead: first point, last point, unit.
    """
    zoned = "timestamp" in (dict(points.dtypes)["at"], dict(tiers.dtypes)["valid_from"], dict(tiers.dtypes)["valid_to"])
    at = _micros("at", zoned)
    rests = [F.pmod(at, F.lit(u)) for u in UNITS]
    reach = points.agg(F.min(at), F.max(at), *(F.min(r) == F.max(r) for r in rests)).first()
    first, last = (reach[0], reach[1]) if reach[0] is not None else (0, 0)
    unit = next(u for u, common in zip(UNITS, reach[2:], strict=True) if common or u == 1)
    places = (last - first) // unit + 1
    # the first place at or after a moment
    reached = lambda c: F.expr(f"({c} - {first} + pmod({first} - {c}, {unit})) div {unit}")
    run = tiers.select(F.col(key).alias("t_key"), "price", "valid_from", _micros("valid_from", zoned).alias("since"), F.coalesce(_micros("valid_to", zoned), F.lit(last + 1)).alias("until"))
    run = run.select("t_key", "price", "valid_from", F.greatest(reached("since"), F.lit(0)).alias("low"), F.least(reached("until"), F.lit(places)).alias("high"))
    # least and greatest pass over nulls; a tier without a start is never in force
    facts = lambda n: (n.alias("tiers"), F.min("cheapest").alias("cheapest"), F.max("newest").alias("newest"))
    runs = run.where("valid_from is not null and low < high").groupBy("t_key", "low", "high").agg(F.count(F.lit(1)).alias("tiers"), F.min("price").alias("cheapest"), F.max("valid_from").alias("newest"))
    powers = places.bit_length()
    low, high = "shiftright(low + shiftleft(1L, n) - 1, n)", "shiftright(high, n)"
    piece = lambda end, place: f"IF({low} < {high} AND {end} % 2 = 1, named_struct('power', n, 'piece', {place}), NULL)"
    cut = f"filter(flatten(transform(sequence(0, {powers}), n -> array({piece(low, low)}, {piece(high, high + ' - 1')}))), x -> x IS NOT NULL)"
    pieces = runs.withColumn("x", F.explode(F.expr(cut))).groupBy("t_key", "x.power", "x.piece").agg(*facts(F.sum("tiers")))
    placed = points.withColumn("_at", at).withColumn("_place", F.expr(f"(_at - {first}) div {unit}")).drop("_at")
    asked = placed.where(F.col(key).isNotNull() & F.col("_place").isNotNull()).select(F.col(key).alias("t_key"), "_place").distinct()
    looks = asked.withColumn("power", F.explode(F.expr(f"sequence(0, {powers})"))).withColumn("piece", F.expr("shiftright(_place, power)"))
    found = looks.join(pieces, ["t_key", "power", "piece"]).groupBy("t_key", "_place").agg(*facts(F.sum("tiers")))
    return placed.join(found.withColumnRenamed("t_key", key), [key, "_place"]).select(*points.columns, "tiers", "cheapest", "newest")


def bulk_price(listings: DataFrame, qty: int) -> DataFrame:
    """unit_price for a quantity: the tier of the largest qty that is reached; null below the MOQ."""
    reached = F.filter("bulk_tiers", lambda t: t["qty"] <= qty)
    best = F.array_max(F.transform(reached, lambda t: F.struct(t["qty"].alias("qty"), t["price"].alias("price"))))
    allowed = F.coalesce(F.col("moq"), F.lit(1)) <= qty
    return listings.withColumn("unit_price", F.when(allowed, F.coalesce(best["price"], F.col("current_price"))))
