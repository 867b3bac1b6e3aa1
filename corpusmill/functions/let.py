"""Values that a lambda uses many times. Spark evaluates an outer expression again for each element; `let` does so once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """Sum of the values before each one, as longs. Blocks are summed by themselves and then their totals, so a long array costs
    little more than its length."""

    def before(items: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(items, start, lambda a, x: F.struct(F.concat(a["at"], F.array(a["n"])).alias("at"), (a["n"] + value(x).cast("bigint")).alias("n")))

    def of(v: Column) -> Column:
        count = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count), lambda b: before(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), lambda x: x))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, before(bs, lambda b: b["n"])["at"], lambda b, o: F.transform(b["at"], lambda x: x + o))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))
