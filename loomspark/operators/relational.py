"""Joins with cardinality guards, set operations, recursive append, and disclosure of small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def fails(bad: Column, code: str) -> Column:
    """A filter condition that raises ``code`` where ``bad`` holds. It stands in a filter, as an unused column that
    raises would be pruned."""
    return F.when(bad, F.raise_error(F.lit(code)).cast("boolean")).otherwise(F.lit(True))


def guarded_join(left: DataFrame, right: DataFrame, on: Column, kind: str = "inner", cardinality: str = "many", unmatched: str = "nulls", duplicate: str = "many", order: list[str] | None = None, label: str = "JOIN") -> DataFrame:
    """A join with the guards of the query language.

    ``cardinality`` one: a left row may have one match; more raise, or with ``duplicate`` first the first in ``order``
    stays. ``unmatched`` reject: a left row without a match raises."""
    if kind in ("semi", "anti"):
        if kind == "semi" and unmatched == "reject":
            # rows without a match raise when they are read; all others stay as often as they are
            missing = F.when(F.col("_hit").isNull(), F.raise_error(F.lit(f"E_{label}_UNMATCHED_ROW")).cast("boolean")).otherwise(F.lit(False))
            lost = left.join(right.withColumn("_hit", F.lit(True)), on, "left").where(missing).select(*[left[c] for c in left.columns])
            return left.join(right, on, "left_semi").unionByName(lost)
        return left.join(right, on, KINDS[kind])
    plain = cardinality != "one" and unmatched != "reject"
    if plain:
        return left.join(right, on, KINDS[kind])
    numbered = left.withColumn("_left_row", F.monotonically_increasing_id())
    how = "left" if unmatched == "reject" and kind == "inner" else KINDS[kind]
    joined = numbered.join(right.withColumn("_hit", F.lit(True)), on, how)
    if unmatched == "reject":
        joined = joined.where(fails(F.col("_left_row").isNotNull() & F.col("_hit").isNull(), f"E_{label}_UNMATCHED_ROW"))
    if cardinality == "one":
        if duplicate == "first":
            keys = [F.col(f"`{c}`") for c in (order or right.columns)]
            turn = Window.partitionBy("_left_row").orderBy(*keys)
            joined = joined.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1 or _left_row is null").drop("_turn")
        else:
            many = Window.partitionBy("_left_row")
            joined = joined.withColumn("_many", F.count("_hit").over(many)).where(fails(F.col("_left_row").isNotNull() & (F.col("_many") > 1), f"E_{label}_DUPLICATE_MATCH")).drop("_many")
    return joined.drop("_left_row", "_hit")


def set_operation(left: DataFrame, right: DataFrame, kind: str, every: bool = True) -> DataFrame:
    """Rows compare by column name; duplicates count unless ``every`` is false."""
    if set(left.columns) != set(right.columns):
        raise QueryError("E_UNKNOWN_PATH", f"columns differ: {left.columns} and {right.columns}")
    right = right.select(*[F.col(f"`{c}`") for c in left.columns])
    if kind == "union":
        out = left.unionByName(right)
        return out if every else out.distinct()
    if kind == "intersect":
        return left.intersectAll(right) if every else left.intersect(right)
    return left.exceptAll(right) if every else left.subtract(right)


def recursive_append(seed: DataFrame, step: DataFrame, key: str, most: int) -> DataFrame:
    """The seed, and the rows of the static step table whose key is new: one pass is the fixpoint."""
    if most < 1:
        return seed
    once = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in step.columns])
    new = step.join(seed.select(key).distinct(), key, "left_anti").withColumn("_turn", F.row_number().over(once)).where("_turn = 1").drop("_turn")
    return seed.unionByName(new.select(*seed.columns))


def top_rows(df: DataFrame, order: list[Column], take: int | None, skip: int = 0) -> DataFrame:
    out = df.orderBy(*order) if order else df
    if skip:
        out = out.offset(skip)
    return out if take is None else out.limit(take)


def sort_key(x: Column, direction: str = "asc", nulls: str | None = None) -> Column:
    """Ascending puts nulls last and descending first, unless told otherwise."""
    nulls = nulls or ("nulls_last" if direction == "asc" else "nulls_first")
    return getattr(x, f"{direction}_{nulls}")()


#: What a sum of 64-bit integers does beyond their range.
OVERFLOW = ("checked", "saturating", "wrapping", "widened")


def summed(column: str, policy: str = "checked") -> Column:
    """A sum of longs. checked raises beyond their range, saturating stays at its end, wrapping goes on at the other end,
    and widened is a decimal of 38 digits. All are plain sums, combined before the shuffle."""
    if policy not in OVERFLOW:
        raise QueryError("E_UNKNOWN_BINDING", f"overflow {policy}")
    wide = F.sum(F.col(column).cast("decimal(19,0)")).cast("decimal(38,0)")
    low, high = (F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1))
    if policy == "widened":
        return wide
    if policy == "saturating":
        return F.least(F.greatest(wide, low), high).cast("long")
    if policy == "wrapping":
        whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
        return (F.pmod(wide - low, whole) + low).cast("long")
    return F.when((wide < low) | (wide > high), F.raise_error(F.lit("E_EXPRESSION: overflow")).cast("long")).otherwise(wide.cast("long"))


def thresholded(value: Column, least: int) -> tuple[Column, Column]:
    """A group's value and whether it is suppressed, for groups of fewer than ``least`` rows."""
    small = F.count(F.lit(1)) < least
    return F.when(~small, value), small


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return top_rows(df, order, size, number * size)
