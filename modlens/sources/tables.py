"""Reading, writing and settling tables."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
COMMENTS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("comment_text", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in LABELS]
)
# Rows a driver-side copy of an intermediate result may have.
SETTLE_ROWS = 100_000
# Spark's switch that deletes the shuffle files of a query when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hash-partition a plain scan by id when it has fewer splits than the cluster has slots (few row
    groups, heavy text work).  Large inputs have many splits and pass through untouched.  Give it scans
    only: asking a plan with shuffles for its partitions would run them."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, id_col) if df.rdd.getNumPartitions() < slots else df


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Labelled comments from CSV; quoted text may span lines and double its quotes."""
    return spark.read.schema(COMMENTS).csv(path, header=True, multiLine=True, quote='"', escape='"')


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory()


class CommentData:
    """The named comment files under one folder."""

    FILES = {"train": "train.csv", "test": "test.csv", "test_labels": "test_labels.csv"}

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def path(self, dataset: str) -> str:
        if dataset not in self.FILES:
            raise ValueError(f"unknown dataset {dataset!r}; known: {sorted(self.FILES)}")
        return f"{self.directory}/{self.FILES[dataset]}"

    def load(self, dataset: str = "train") -> DataFrame | None:
        path = self.path(dataset)
        if not path_exists(self.spark, path):
            return None
        if dataset == "test":
            schema = T.StructType(COMMENTS.fields[:2])
            return self.spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
        if dataset == "test_labels":
            schema = T.StructType([COMMENTS.fields[0], *COMMENTS.fields[2:]])
            return self.spark.read.schema(schema).csv(path, header=True)
        return read_comments(self.spark, path)


def with_target(features: DataFrame, targets: DataFrame, target: str, on: str = "doc_id") -> DataFrame:
    """Features next to one label column, aligned by id."""
    if target not in targets.columns:
        raise ValueError(f"target {target!r} is not a column; there are {targets.columns}")
    return features.join(targets.select(on, target), on)


def label_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if re.search("toxic|severe|obscene|threat|insult|identity", c)]


def local_table(spark: SparkSession, columns: Mapping[str, Sequence], schema: pa.Schema | None = None) -> DataFrame:
    """A driver-side table; Spark knows its exact size and picks the join from it."""
    return spark.createDataFrame(pa.table(dict(columns), schema=schema))


def settle(df: DataFrame, max_rows: int = SETTLE_ROWS) -> DataFrame:
    """Evaluate a small result once and keep it as a local relation of known size.

    The row count is checked: a result beyond ``max_rows`` stays a normal plan, so the join against
    it is planned by Spark from statistics and falls back to a shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return df if rows.num_rows > max_rows else df.sparkSession.createDataFrame(rows)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="modlens-")


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's checkpoint folder.  A local session without
    one gets a temporary folder; a cluster must name one, since its machines share no local disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialised table that is not needed any more."""
    root = scratch_folder(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"{root.removeprefix('file://')}/" in folder:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialise(df: DataFrame, name: str = "table", even: bool = False, row_group: int | None = None) -> DataFrame:
    """Write an intermediate result once and read it back: iterative jobs then rescan columns
    instead of recomputing text features, and lost executors cost a file read.

    ``even`` lets Spark rebalance the files to its advisory size first, which suits tables that are
    scanned many times. ``row_group`` bounds the bytes that a reader holds at once, for tables of long rows.
    """
    path = scratch_path(df.sparkSession, name)
    writer = (df.hint("rebalance") if even else df).write
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries run inside leave no shuffle files behind; the session's own setting comes back afterwards."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def numbered(df: DataFrame, output_col: str) -> DataFrame:
    """Rows with a number from zero without gaps, in the order of the partitions."""
    stored = materialise(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_at", 33)  # the id's high bits name the partition, the others count its rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    first = settle(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(first, part == F.col("_part")).select(*df.columns, (F.col("_first") + row).alias(output_col))


class FeatureStore:
    """Feature tables keyed by a fingerprint of configuration and inputs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, config: Mapping) -> str:
        key = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
        return f"{self.root}/{name}-{key}"

    def get_or_build(self, name: str, config: Mapping, build: Callable[[], DataFrame]) -> DataFrame:
        path = self.path(name, config)
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def head(df: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """First ``n`` rows by id (top-k per partition, then one merge)."""
    return df.orderBy(id_col).limit(n)


class ModelRegistry:
    """Fitted models and their metrics under one folder; an index table says what is a model."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, models: Mapping[str, object], metrics: DataFrame, ensembles: Mapping[str, object] | None = None,
             reports: Mapping[str, DataFrame] | None = None) -> None:
        """Fitted pipelines, ensembles over them (voting, stacking), metrics, and tables of reports."""
        names, kinds, parts = [], [], []
        for name, model in models.items():
            model.write().overwrite().save(f"{self.root}/models/{name}")
            names, kinds, parts = [*names, name], [*kinds, _kind(model)], [*parts, "model"]
        for name, ensemble in (ensembles or {}).items():
            ensemble.save(self.spark, f"{self.root}/ensembles/{name}")
            names, kinds, parts = [*names, name], [*kinds, _kind(ensemble)], [*parts, "ensemble"]
        local_table(self.spark, {"model": names, "kind": kinds, "part": parts}).write.mode("overwrite").parquet(
            f"{self.root}/index"
        )
        metrics.write.mode("overwrite").parquet(f"{self.root}/metrics")
        for name, report in (reports or {}).items():
            report.write.mode("overwrite").parquet(f"{self.root}/reports/{name}")

    def _index(self, part: str) -> dict[str, type]:
        if not path_exists(self.spark, f"{self.root}/index"):
            raise FileNotFoundError(f"no saved models under {self.root}")
        found = {}
        for row in self.spark.read.parquet(f"{self.root}/index").where(f"part = '{part}'").orderBy("model").collect():
            module, _, cls = row["kind"].rpartition(".")
            found[row["model"]] = getattr(__import__(module, fromlist=[cls]), cls)
        return found

    def load(self) -> tuple[dict[str, object], DataFrame]:
        models = {name: loader.load(f"{self.root}/models/{name}") for name, loader in self._index("model").items()}
        return models, self.spark.read.parquet(f"{self.root}/metrics")

    def load_ensembles(self, models: Mapping[str, object]) -> dict[str, object]:
        """Ensembles, over the given loaded models."""
        return {
            name: kind.load(self.spark, f"{self.root}/ensembles/{name}", models)
            for name, kind in self._index("ensemble").items()
        }

    def report(self, name: str) -> DataFrame:
        path = f"{self.root}/reports/{name}"
        if not path_exists(self.spark, path):
            raise FileNotFoundError(f"no report {name!r} under {self.root}")
        return self.spark.read.parquet(path)


def _kind(thing: object) -> str:
    return f"{type(thing).__module__}.{type(thing).__name__}"
