"""Running numbers, sums and last values along ordered groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.store import stored


def in_runs(rows: DataFrame, key: list[str], order: list[str], count: str | None = None, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """rows with running values along each group of `key` in `order` (which has no ties within a group).

    count: the name of the row's number in its group, from 1; sums: name -> what the rows before it add up to; last: name -> the last
    value that isn't null up to the row itself. Null keys are a group. Rows are dealt by ranges of (key, order), so a large group lies in
    many tasks; what groups that cross ranges bring from the ranges before is a row for each such group and range, sent to all.
    """
    sums, last = sums or {}, last or {}
    names = {**{n: f"sum__{i}" for i, n in enumerate(sums)}, **{n: f"last__{i}" for i, n in enumerate(last)}}
    given = rows.select("*", *[v.alias(names[n]) for n, v in {**sums, **last}.items()])
    spread = stored(given.repartitionByRange(*key, *order).withColumn("range__", F.spark_partition_id()))  # read twice
    keys = [F.col(k).alias(f"key__{i}") for i, k in enumerate(key)]
    of = [f"key__{i}" for i in range(len(key))]
    end = F.max_by
    at = F.struct(*order)
    tops = [F.count("*").alias("count__")] + [F.sum(names[n]).alias(names[n]) for n in sums] + [end(names[n], F.when(F.col(names[n]).isNotNull(), at)).alias(names[n]) for n in last]
    totals = spread.groupBy("range__", *keys).agg(*tops)
    crossing = Window.partitionBy(*of).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    many = totals.groupBy(*of).agg(F.count("*").alias("ranges__")).where("ranges__ > 1").drop("ranges__")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"m.{k}")) for k in of]
    few = totals.alias("t").join(many.alias("m"), _all(same), "left_semi")
    carry = [F.sum("count__").over(crossing).alias("count_before__")] + [F.sum(names[n]).over(crossing).alias(f"{names[n]}_before") for n in sums] + [F.last(names[n], ignorenulls=True).over(crossing).alias(f"{names[n]}_before") for n in last]
    before = few.select(F.col("range__").alias("before__"), *of, *carry)
    met = _all([F.col(f"s.{k}").eqNullSafe(F.col(f"b.key__{i}")) for i, k in enumerate(key)]) & (F.col("s.range__") == F.col("b.before__"))
    joined = spread.alias("s").join(F.broadcast(before).alias("b"), met, "left")  # two rows at most for each range
    by = Window.partitionBy("range__", *key).orderBy(*order)
    ahead, up_to = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    out = [F.col(f"s.{c}") for c in rows.columns]
    if count:
        out.append((F.row_number().over(by) + F.coalesce("count_before__", F.lit(0))).cast("long").alias(count))
    out += [(F.coalesce(F.sum(f"s.{names[n]}").over(ahead), F.lit(0)) + F.coalesce(f"{names[n]}_before", F.lit(0))).alias(n) for n in sums]
    out += [F.coalesce(F.last(f"s.{names[n]}", ignorenulls=True).over(up_to), F.col(f"{names[n]}_before")).alias(n) for n in last]
    return joined.select(*out)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
