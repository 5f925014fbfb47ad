"""Row numbers and running sums in one total order, without a task that holds a whole group.

Slim keys are sorted by ranges of (group, order); each range is numbered by itself, and the ranges'
totals, a row each, give every range its start. A row's number in its group is its number among all
rows less the group's first, which is an aggregate combined before the shuffle. So neither a group
of most rows nor many small ones make a large task, and what else a row has is joined back by its key.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.session import ensure_checkpoint_dir

KEY = "_row"


def ranked(rows: DataFrame, within: list[str], order: list[str | Column], name: str = "n", sums: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """rows with `name`, their number (from 1) in the groups of `within` by `order` (ascending, nulls first), and running sums up to and with each row.

    sums: name to a column of whole numbers of 0 or more; nulls count as 0. Rows equal in `order` come in any order, but one
    that holds for the number and all sums; null groups are groups. ranges: of the sort, the session's shuffle partitions unless given.
    An empty table gives none. The rows are written once, in the shared folder of checkpoints.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = sums or {}
    keyed = rows.withColumn(KEY, F.monotonically_increasing_id()).checkpoint()
    added = [F.coalesce(c.cast("long"), F.lit(0)).alias(f"_sum{k}") for k, c in enumerate(sums.values())]
    slim = keyed.select(KEY, *within, *added, *((F.col(c) if isinstance(c, str) else c).alias(f"_by{k}") for k, c in enumerate(order)))
    by = [*(F.col(c).asc_nulls_first() for c in (*within, *(f"_by{k}" for k in range(len(order))))), F.col(KEY)]
    sorted_ = slim.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    # The id of a row in sorted ranges: the range's number above 33 bits, the row's in its range below.
    placed = sorted_.select(KEY, *within, *(f"_sum{k}" for k in range(len(sums))), F.monotonically_increasing_id().alias("_at")).withColumn("_range", F.shiftright("_at", 33)).checkpoint()
    upto = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({f"_run{k}": F.sum(f"_sum{k}").over(upto) for k in range(len(sums))}) if sums else placed
    totals = placed.groupBy("_range").agg(F.count("*").alias("rows"), *(F.sum(f"_sum{k}").alias(f"s{k}") for k in range(len(sums)))).orderBy("_range").collect()  # a row a range
    starts = [[0, *list(accumulate(t[1 + k] for t in totals))[:-1]] for k in range(1 + len(sums))]
    schema = "_r long, _start long" + "".join(f", _start{k} long" for k in range(len(sums)))
    offsets = spark.createDataFrame([(t["_range"], *(s[i] for s in starts)) for i, t in enumerate(totals)], schema)
    whole = local.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    whole = whole.select(KEY, *within, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")).alias("_no"), *((F.col(f"_run{k}") + F.col(f"_start{k}")).alias(f"_run{k}") for k in range(len(sums))), *(f"_sum{k}" for k in range(len(sums))))
    if within:
        own = [F.col(c).alias(f"_g{k}") for k, c in enumerate(within)]
        firsts = whole.groupBy(*own).agg(F.min("_no").alias("_first"), *(F.min(F.col(f"_run{k}") - F.col(f"_sum{k}")).alias(f"_before{k}") for k in range(len(sums))))
        same = F.lit(True)
        for k, c in enumerate(within):
            same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
        whole = whole.join(firsts, same)
    else:
        whole = whole.withColumns({"_first": F.lit(0), **{f"_before{k}": F.lit(0) for k in range(len(sums))}})
    numbers = whole.select(F.col(KEY).alias("_key"), (F.col("_no") - F.col("_first") + 1).alias(name), *((F.col(f"_run{k}") - F.col(f"_before{k}")).alias(c) for k, c in enumerate(sums)))
    return keyed.join(numbers, F.col(KEY) == F.col("_key")).drop(KEY, "_key")

