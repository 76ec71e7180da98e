"""Running counts and last values over ordered rows of a key, without one task for a key.

Rows of a key are cut into blocks along their order. Windows run within a block; what earlier blocks carry
into it comes from one row for each block, which partial aggregation makes before the shuffle. A key with a
third of all rows is then as many tasks as it has blocks, and the rows are shuffled once, by key and block."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Order numbers of a block, where the order is by one number.
BLOCK = 65_536


def by_number(column: str, size: int = BLOCK) -> Column:
    """The block of a row by its order number."""
    return F.floor(F.col(column) / size)


def by_hour(column: str) -> Column:
    """The block of a row by the hour of its time."""
    return F.date_diff(F.to_date(column), F.lit("1970-01-01")) * 24 + F.hour(column)


def running(rows: DataFrame, key: Sequence[str], order: Sequence[str], block: Column, counts: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds to `rows`, by key and in order:

    counts: for each name and condition, how many earlier rows meet it, and as `<name>_total` how many of all;
    sums: the same of whole numbers, nulls being zeros;
    lasts: for each name and value, the last one that is not null, up to the row itself;
    before: the same, up to the row before.

    The block must not fall as the order rises. Rows with a null key or order are dropped: they are nowhere in
    the order. Rows that agree in all order columns come in any order."""
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    counts = {n: one(c) for n, c in (counts or {}).items()} | {n: F.coalesce(c, F.lit(0)).cast("long") for n, c in (sums or {}).items()}
    lasts, before = dict(lasts or {}), dict(before or {})
    for c in (*key, *order):
        rows = rows.where(F.col(c).isNotNull())
    cut = rows.withColumn("_block", block)
    own = Window.partitionBy(*key, "_block").orderBy(*order)
    past, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    sums = cut.groupBy(*key, "_block").agg(
        F.lit(True).alias("_any"),
        *[F.sum(c).alias(f"_n_{n}") for n, c in counts.items()],
        *[F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_v_{n}") for n, v in (lasts | before).items()],
    )
    along = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    carried = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in key],
        F.col("_block").alias("_b"),
        *[F.coalesce(F.sum(f"_n_{n}").over(along), F.lit(0)).alias(f"_n_{n}") for n in counts],
        *[F.sum(f"_n_{n}").over(whole).alias(f"{n}_total") for n in counts],
        *[F.last(f"_v_{n}", ignorenulls=True).over(along).alias(f"_v_{n}") for n in lasts | before],
    )
    local = cut.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(c).over(past), F.lit(0)) for n, c in counts.items()}
        | {f"_l_{n}": F.last(v, ignorenulls=True).over(upto) for n, v in lasts.items()}
        | {f"_l_{n}": F.last(v, ignorenulls=True).over(past) for n, v in before.items()}
    )
    on = F.col("_block") == F.col("_b")
    for k in key:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    both = local.join(carried, on)
    return both.select(
        *rows.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_n_{n}")).cast("long").alias(n) for n in counts],
        *[F.col(f"{n}_total").cast("long").alias(f"{n}_total") for n in counts],
        *[F.coalesce(f"_l_{n}", f"_v_{n}").alias(n) for n in lasts | before],
    )


def as_of(rows: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str], value: str, block: Column) -> DataFrame:
    """Adds to `rows` the value of the last of `changes` (key, order, value) of the same key, at or before the row; null
    where there is none. Of a change and a row at the same place the change comes first."""
    marked = rows.withColumns({"_rest": F.struct(*rows.columns), "_kind": F.lit(1), "_value": F.lit(None).cast(changes.schema[value].dataType)})
    set_ = changes.select(*key, *order, F.lit(None).cast(marked.schema["_rest"].dataType).alias("_rest"), F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    both = marked.select(*key, *order, "_rest", "_kind", "_value").unionByName(set_)
    got = running(both, key, [*order, "_kind"], block, lasts={"_now": F.col("_value")})
    return got.where("_kind = 1").select("_rest.*", F.col("_now").alias(value))
