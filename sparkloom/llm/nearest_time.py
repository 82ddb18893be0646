"""Pair every record with the nearest one in time of the same entity, within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.columns import names, require
from sparkloom.operators.skew import salted_join
from sparkloom.session import cut_lineage, shuffle_partitions

#: Different right times that a bucket may carry as one array; fuller buckets are searched in order instead.
DENSE = 256


def _in_order(asked: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """The last right record before and the first one after each asked row, within equal keys: adds ``_c``.

    All rows are range-partitioned by keys and time, so that a full bucket is spread over partitions; what a partition must know
    of those before and after it comes from one summary row per key and partition.
    """
    point = F.when(F.col("_id").isNotNull(), F.struct("_t", "_id"))
    rows = times.select(*keys, "_t", "_id").unionByName(asked.withColumn("_t", F.col("_lt")), allowMissingColumns=True)
    placed = rows.repartitionByRange(shuffle_partitions(asked.sparkSession), *keys, "_t").withColumn("_pid", F.spark_partition_id())
    here = Window.partitionBy(*keys, "_pid").orderBy("_t", F.asc_nulls_last("_id"))
    near = placed.withColumn("_before", F.last(point, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.first(point, ignorenulls=True).over(here.rowsBetween(0, Window.unboundedFollowing)))
    near = cut_lineage(near)
    order = Window.partitionBy(*keys).orderBy("_pid")
    ends = near.groupBy(*keys, "_pid").agg(F.min(point).alias("_f"), F.max(point).alias("_l"))
    ends = ends.withColumn("_earlier", F.last("_l", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_later", F.first("_f", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    j = near.where("_id is null").join(ends.drop("_f", "_l"), [*keys, "_pid"])
    return j.select(*asked.columns, F.array_compact(F.array(F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later"))).alias("_c"))


def nearest_within(left: DataFrame, right: DataFrame, entity: str | list[str], time: str, left_id: str, right_id: str, tolerance: float, *, dense: int = DENSE) -> DataFrame:
    """The nearest right record of each left record: ``left_id``, ``right_id``, ``distance``.

    Times are put into buckets as wide as the tolerance, so a partner lies in the same bucket or one next to it. Of
    equally near records the earlier is taken, at equal time the one with the lower id. From the next buckets
    only the last, or first, right record can be nearest, so each bucket carries its own records and those two,
    and no pairs of rows are made. Buckets with a large part of the left rows are salted. Buckets with more than
    ``dense`` different right times aren't carried as arrays: their rows are put in order over all partitions.

    Records with a null or NaN time, or a null entity, have no partner and no row. Repeated records count once; one id
    at several times keeps the nearest. Other columns are ignored. An empty table gives no rows. The width exceeds the
    tolerance by a millionth, so that rounding at a bucket's edge loses no pair; the distance is compared exactly.
    """
    if not tolerance >= 0:
        raise ValueError("tolerance is at least 0")
    entity = names(entity)
    require(left, *entity, time, left_id)
    require(right, *entity, time, right_id)
    e = [f"_e{i}" for i in range(len(entity))]
    width = tolerance * (1 + 2.0**-20) or 1.0

    def records(df: DataFrame, ident: str) -> DataFrame:
        rows = df.select(*[F.col(f"`{n}`").alias(c) for c, n in zip(e, entity)], F.col(f"`{time}`").cast("double").alias("_t"), F.col(f"`{ident}`").alias("_id"))
        rows = rows.dropna().where("_t > double('-Infinity') and _t < double('Infinity') and not isnan(_t)")
        return rows.withColumn("_b", F.floor(F.col("_t") / F.lit(width)))

    times = records(right, right_id).groupBy(*e, "_b", "_t").agg(F.min("_id").alias("_id"))
    point = F.struct("_t", "_id")
    ends = cut_lineage(times.groupBy(*e, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min(point).alias("_first"), F.max(point).alias("_last")))
    full = ends.where(F.col("_n") > dense).select(*e, "_b")
    own = times.join(full, [*e, "_b"], "left_anti").groupBy(*e, "_b").agg(F.collect_list(point).alias("_c"))
    edges = ends.select(*e, F.inline(F.array(F.struct((F.col("_b") + 1).alias("_b"), F.array("_last").alias("_c")), F.struct((F.col("_b") - 1).alias("_b"), F.array("_first").alias("_c")))))
    near = own.unionByName(edges).groupBy(*e, "_b").agg(F.flatten(F.collect_list("_c")).alias("_c"))
    asked = records(left, left_id).groupBy(*e, "_b", "_t", "_id").agg(F.count(F.lit(1)).alias("_n")).select(*e, "_b", F.col("_t").alias("_lt"), F.col("_id").alias("_lid"))
    found = salted_join(asked, near, [*e, "_b"]).select("_lt", "_lid", "_c")
    if not full.isEmpty():
        found = found.unionByName(_in_order(asked.join(full, [*e, "_b"], "left_semi"), times.join(full, [*e, "_b"], "left_semi"), [*e, "_b"]).select("_lt", "_lid", "_c"))
    d = F.transform("_c", lambda c: F.struct(F.abs(c["_t"] - F.col("_lt")).alias("d"), c["_t"].alias("t"), c["_id"].alias("id")))
    best = found.select(F.col("_lid"), F.array_min(F.filter(d, lambda x: x["d"] <= F.lit(float(tolerance)))).alias("_m")).where("_m is not null")
    return best.groupBy("_lid").agg(F.min("_m").alias("_m")).select(F.col("_lid").alias(left_id if left_id != right_id else f"left_{left_id}"), F.col("_m.id").alias(right_id if left_id != right_id else f"right_{right_id}"), F.col("_m.d").alias("distance"))
