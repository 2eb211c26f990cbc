"""Order statistics over whole classes without sorting a class in one task.

A class may hold most rows, so no window is ever opened over a whole class.  Random order is the md5
of the id and a seed; a histogram of its leading hex digits finds the bucket that contains a wanted
rank, and only that bucket (one part in 65536) is sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.sources.tables import settle

PREFIX = 4  # hex digits: 65536 buckets


def random_key(id_col: str | Column, seed: int | str) -> Column:
    """Portable pseudo-random order: the md5 of ``id|seed``."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", col.cast("string"), F.lit(str(seed))))


def unit_uniform(key: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of a key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(2**32)


def rank_cuts(
    df: DataFrame,
    id_col: str,
    seed: int | str,
    wanted: Mapping[str, Callable[[Column], Column]],
    strata: Sequence[str] = (),
) -> DataFrame:
    """Key at given ranks of each stratum's random order.

    ``wanted`` maps a name to a function from the stratum size to a rank.  The result has one row
    per stratum and name: ``cut_key``, ``cut_id`` and ``total``.
    """
    strata = list(strata)
    keyed = df.select(*strata, F.col(id_col).alias("cut_id"), random_key(id_col, seed).alias("cut_key"))
    keyed = keyed.withColumn("bucket", F.substring("cut_key", 1, PREFIX))
    histogram = keyed.groupBy(*strata, "bucket").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    totals = histogram.withColumn("upto", F.sum("n").over(within.orderBy("bucket"))).withColumn(
        "total", F.sum("n").over(within)
    )
    ranks = F.array(
        *[F.struct(F.lit(k).alias("name"), f(F.col("total")).cast("bigint").alias("rank")) for k, f in wanted.items()]
    )
    asked = totals.select("*", F.explode(ranks).alias("w")).select("*", "w.name", "w.rank")
    rank, first = F.col("rank"), F.col("upto") - F.col("n")
    target = settle(
        asked.filter(((rank <= F.col("upto")) & (rank > first)) | ((rank <= 0) & (first == 0))).select(
            *strata, "bucket", "name", "total", (rank - first).alias("k")
        )
    )
    # Rank 0 lies before every row: the empty key sorts first.
    before_all = target.filter("k <= 0").select(
        *strata, "name", F.lit("").alias("cut_key"), F.lit(None).cast(df.schema[id_col].dataType).alias("cut_id"), "total"
    )
    order = Window.partitionBy(*strata, "name", "bucket").orderBy("cut_key", "cut_id")
    found = (
        keyed.join(target.filter("k > 0"), [*strata, "bucket"])
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") == F.col("k"))
        .select(*strata, "name", "cut_key", "cut_id", "total")
    )
    return found.unionByName(before_all)


def rank_slices(
    df: DataFrame,
    id_col: str,
    seed: int | str,
    wanted: Mapping[str, Callable[[Column], Column]],
    strata: Sequence[str] = (),
    slice_col: str = "slice",
) -> DataFrame:
    """Number of wanted ranks that lie before each row in its stratum's random order.

    Row with rank r gets ``count(rank_i < r)``.  The cuts are a handful of rows, so the table itself
    is only filtered and projected, never shuffled.
    """
    strata = list(strata)
    cuts = rank_cuts(df, id_col, seed, wanted, strata).withColumn("one", F.lit(1))
    per_stratum = cuts.groupBy(*(strata or ["one"])).agg(
        F.collect_list(F.struct("cut_key", "cut_id")).alias("cuts")
    )
    keyed = df.withColumn("_key", random_key(id_col, seed))
    if strata:
        keyed = keyed.join(settle(per_stratum), strata, "left")
    else:
        rows = per_stratum.collect()
        cuts_lit = F.array(
            *[F.struct(F.lit(c["cut_key"]).alias("cut_key"), F.lit(c["cut_id"]).alias("cut_id"))
              for c in (rows[0]["cuts"] if rows else [])]
        )
        keyed = keyed.withColumn("cuts", cuts_lit if rows else F.lit(None))
        if not rows:
            return keyed.withColumn(slice_col, F.lit(0)).drop("_key", "cuts")
    after = F.filter(
        "cuts",
        lambda c: (F.col("_key") > c["cut_key"])
        | ((F.col("_key") == c["cut_key"]) & (F.col(id_col) > c["cut_id"])),
    )
    return keyed.withColumn(slice_col, F.coalesce(F.size(after), F.lit(0))).drop("_key", "cuts")


def running_totals(
    df: DataFrame, group: str, order: str, sums: Sequence[str], buckets: int = 64
) -> DataFrame:
    """Cumulative sums by descending ``order`` within ``group``, over range buckets.

    ``df`` has one row per group and order value.  Bucket limits are approximate quantiles; each
    bucket is scanned in its own task and starts from the totals of the buckets above it.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    limits = sorted(set(df.approxQuantile(order, probabilities, 0.5 / buckets)))
    splits = [-float("inf"), *(limits or [0.0]), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket").transform(df)
    bucket_sums = bucketed.groupBy(group, "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    above = Window.partitionBy(group).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = bucket_sums.select(
        group,
        "_bucket",
        *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}_above") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(F.desc(order))
    return (
        bucketed.join(settle(offsets), [group, "_bucket"])
        .select(
            *df.columns,
            *[(F.sum(c).over(inside) + F.col(f"_{c}_above")).alias(f"{c}_cum") for c in sums],
            *[f"{c}_total" for c in sums],
        )
    )
