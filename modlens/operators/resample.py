"""Class rebalancing of ``(id, x, y)`` tables with a binary ``y`` (1 is the minority).

Ids are kept; a synthetic row is named by its seed row and a copy number.  All randomness comes from
md5 keys, so a rerun after an executor loss gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.operators.knn import knn
from modlens.operators.ranking import random_key, rank_slices, unit_uniform
from modlens.sources.tables import materialise

NEIGHBOURS = 5
DANGER_NEIGHBOURS = 10


def class_sizes(df: DataFrame) -> tuple[int, int]:
    """(majority, minority) sizes."""
    row = df.agg(F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b")).first()
    return row["a"], row["b"]


def original(df: DataFrame, seed: int = 42) -> DataFrame:
    return df


def undersample(df: DataFrame, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Keep ``minority/ratio`` majority rows, chosen by random key, and every minority row."""
    _, minority = class_sizes(df)
    keep = int(minority / ratio)
    marked = rank_slices(
        df, "id", seed, {"cut": lambda n: F.least(n, F.lit(keep).cast("bigint"))}, ["y"], "_after"
    )
    return marked.filter((F.col("y") == 1) | (F.col("_after") == 0)).drop("_after").select(df.columns)


def minority_neighbours(df: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    minority = df.filter("y = 1")
    return knn(minority, minority, k)


def neighbour_classes(df: DataFrame, k: int) -> DataFrame:
    """Majority rows among the k nearest rows of each minority row: ``(id, majority, k)``."""
    near = knn(df.filter("y = 1"), df, k)
    labelled = near.join(df.select(F.col("id").alias("neighbour_id"), "y"), "neighbour_id")
    return labelled.groupBy(F.col("query_id").alias("id")).agg(
        F.count_if(F.col("y") == 0).alias("majority"), F.count("*").alias("k")
    )


def danger_rows(df: DataFrame, m: int = DANGER_NEIGHBOURS) -> DataFrame:
    """Minority rows with at least half, but not all, of their m neighbours in the majority."""
    c = neighbour_classes(df, m)
    return c.filter((F.col("majority") * 2 >= F.col("k")) & (F.col("majority") < F.col("k"))).select("id", "majority")


def adasyn_quota(df: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Synthetic rows per minority row, in proportion to its share of majority neighbours."""
    majority, minority = class_sizes(df)
    shares = neighbour_classes(df, k).withColumn("share", F.col("majority") / F.col("k"))
    total = shares.agg(F.sum("share")).first()[0] or 0.0
    quota = F.rint(F.col("share") / total * float(majority - minority)) if total else F.lit(0.0)
    return shares.select("id", "share", quota.cast("bigint").alias("quota"))


def even_quota(seeds: DataFrame, wanted: int, seed: int) -> DataFrame:
    """Spread ``wanted`` copies over the seed rows; the remainder goes to the first by random key."""
    n = seeds.count()
    if not n or wanted <= 0:
        return seeds.withColumn("quota", F.lit(0).cast("bigint"))
    base, extra = divmod(wanted, n)
    marked = rank_slices(seeds, "id", seed, {"cut": lambda _: F.lit(extra)}, (), "_after")
    return marked.withColumn("quota", (F.lit(base) + F.when(F.col("_after") == 0, 1).otherwise(0)).cast("bigint")).drop(
        "_after"
    )


def interpolate(quota: DataFrame, minority: DataFrame, neighbours: DataFrame, seed: int = 42) -> DataFrame:
    """``(seed_id, copy_no, neighbour_id, gap, x)``: points between a row and a random neighbour."""
    key = random_key(F.concat_ws("|", F.col("id").cast("string"), F.col("copy_no").cast("string")), seed)
    degree = neighbours.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("deg"))
    copies = (
        quota.filter("quota > 0")
        .select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("quota"))).alias("copy_no"))
        .join(degree, "id")
        .withColumn("key", key)
        .withColumn("rank", (F.floor(unit_uniform(F.substring("key", 9, 8)) * F.col("deg")) + 1).cast("int"))
    )
    picked = copies.join(neighbours.withColumnRenamed("query_id", "id"), ["id", "rank"])
    a = minority.select("id", F.col("x").alias("xa"))
    b = minority.select(F.col("id").alias("neighbour_id"), F.col("x").alias("xb"))
    gap = unit_uniform(F.col("key"))
    return (
        picked.join(a, "id")
        .join(b, "neighbour_id")
        .withColumn("gap", gap)
        .select(
            F.col("id").alias("seed_id"),
            "copy_no",
            "neighbour_id",
            "gap",
            F.zip_with("xa", "xb", lambda p, q: p + F.col("gap") * (q - p)).alias("x"),
        )
    )


def with_synthetic(df: DataFrame, points: DataFrame) -> DataFrame:
    """Original rows and synthetic minority rows; ids become strings."""
    named = F.concat_ws("+", F.col("seed_id").cast("string"), F.col("copy_no").cast("string"))
    return df.select(F.col("id").cast("string").alias("id"), "x", "y").unionByName(
        points.select(named.alias("id"), "x", F.lit(1).cast(df.schema["y"].dataType).alias("y"))
    )


def smote_points(df: DataFrame, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    majority, minority = class_sizes(df)
    seeds = df.filter("y = 1").select("id", "x")
    quota = even_quota(seeds.select("id"), majority - minority, seed)
    return interpolate(quota, seeds, minority_neighbours(df, k), seed)


def smote(df: DataFrame, seed: int = 42) -> DataFrame:
    return with_synthetic(df, smote_points(df, seed=seed))


def borderline_smote(df: DataFrame, seed: int = 42) -> DataFrame:
    """SMOTE seeded only by the rows in danger; their neighbours are any minority rows."""
    majority, minority = class_sizes(df)
    danger = materialise(danger_rows(df).select("id"), "danger")
    rows = df.filter("y = 1").select("id", "x")
    near = knn(rows.join(danger, "id", "left_semi"), rows, NEIGHBOURS)
    quota = even_quota(danger, majority - minority, seed)
    return with_synthetic(df, interpolate(quota, rows, near, seed))


def adasyn(df: DataFrame, seed: int = 42) -> DataFrame:
    rows = df.filter("y = 1").select("id", "x")
    return with_synthetic(df, interpolate(adasyn_quota(df), rows, minority_neighbours(df), seed))


def tomek_links(df: DataFrame) -> DataFrame:
    """Pairs of opposite class that are each other's nearest row.

    A link has one minority end, so only minority rows and their nearest majority rows are searched.
    """
    labels = df.select("id", "y")
    first = knn(df.filter("y = 1"), df, 1).select(
        F.col("query_id").alias("minority_id"), F.col("neighbour_id").alias("majority_id")
    )
    opposite = first.join(labels.filter("y = 0").select(F.col("id").alias("majority_id")), "majority_id")
    opposite = materialise(opposite, "tomek")
    ends = df.join(opposite.select(F.col("majority_id").alias("id")).distinct(), "id", "left_semi")
    back = knn(ends, df, 1).select(
        F.col("query_id").alias("majority_id"), F.col("neighbour_id").alias("minority_id")
    )
    return opposite.join(back, ["majority_id", "minority_id"]).select("minority_id", "majority_id")


def smote_tomek(df: DataFrame, seed: int = 42) -> DataFrame:
    """SMOTE, then remove both ends of every Tomek link."""
    grown = materialise(smote(df, seed), "smote")
    links = tomek_links(grown)
    ends = links.select(F.explode(F.array("minority_id", "majority_id")).alias("id")).distinct()
    return grown.join(ends, "id", "left_anti")


METHODS = {
    "original": original,
    "smote": smote,
    "borderline_smote": borderline_smote,
    "adasyn": adasyn,
    "smotetomek": smote_tomek,
    "undersample_1_1": lambda df, seed=42: undersample(df, 1.0, seed),
    "undersample_2_1": lambda df, seed=42: undersample(df, 0.5, seed),
}


def resample(df: DataFrame, method: str, seed: int = 42) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown resampling method {method!r}; known: {list(METHODS)}")
    return METHODS[method](df, seed=seed)
