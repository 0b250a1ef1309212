"""Exact interpolated quantiles per group without gathering a group in one task."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..session import small_table

WIDTH = 1e-3      # ranks around a wanted one, as a share of the group
ACCURACY = 10_000  # of the sketches: a tenth of WIDTH
GROUPS = 10_000   # groups whose brackets travel to the tasks; more of them are joined by Spark


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], width: float = WIDTH, groups: int = GROUPS) -> DataFrame:
    """Per group of ``by``: n, largest and the quantiles ``wanted`` (name -> share) of the non-null values, interpolated between neighbours.

    The first pass merges quantile sketches in the map tasks and brackets every wanted rank by two values of the group.  The second counts what lies below
    each bracket and, value by value, what lies inside, again combined in the map tasks; a window over the values inside finds the exact ranks.
    A task sees about ``2 * width`` of a group, or a whole one of fewer than ``10 / width`` rows.  A bracket that should miss its rank fails the job.
    Null groups are groups; a group without a value is left out, and so an empty table gives an empty result.
    """
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    n, edges = F.count(F.lit(1)), []
    for share in wanted.values():
        edges += [max(share - width, 0.0), min(share + width, 1.0)]
    known = v.groupBy(*by).agg(n.alias("n"), F.max("_v").alias("largest"), F.percentile_approx("_v", edges, ACCURACY).alias("_e"))
    few = known.limit(groups + 1).collect()
    if len(few) <= groups:
        known = small_table(df.sparkSession, [tuple(r) for r in few], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema))
    renamed = known.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], "n", "_e")
    joined = v.join(renamed, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)], F.lit(True)))

    small = F.col("n") < 10 / width
    places = []
    for k, share in enumerate(wanted.values()):
        under = ~small & (F.lit(share) > width) & (F.col("_v") < F.col("_e")[2 * k])
        over = ~small & (F.lit(share) < 1 - width) & (F.col("_v") > F.col("_e")[2 * k + 1])
        places.append(F.when(~over, F.struct(F.lit(k).alias("p"), F.when(~under, F.col("_v")).alias("v"))))
    counted = joined.select(*by, "n", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("x")).groupBy(*by, "n", "x.p", "x.v").agg(F.count(F.lit(1)).alias("m"))

    share = F.array(*[F.lit(float(s)) for s in wanted.values()])[F.col("p")]
    w = Window.partitionBy(*by, "p").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumns({"upto": F.sum("m").over(w), "at": share * (F.col("n") - 1)})
    reaches = lambda rank: F.min(F.when(F.col("upto") >= rank, F.struct("upto", "v"))).getField("v")
    ends = ranked.groupBy(*by, "p", "n", "at").agg(reaches(F.floor("at") + 1).alias("a"), reaches(F.ceil("at") + 1).alias("b"))
    met = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a bracket misses its rank")).cast("double")).when(F.col("a") == F.col("b"), F.col("a"))
    found = ends.withColumn("q", met.otherwise((F.floor("at") + 1 - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")))
    named = found.groupBy(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]).agg(*[F.max(F.when(F.col("p") == k, F.col("q"))).alias(name) for k, name in enumerate(wanted)])
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)], F.lit(True))
    return known.join(named, same).select(*by, "n", "largest", *wanted)
