"""Tables by path suffix, and the Parquet stages of a preparation run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.csvfiles import read_csv

# Stages in the order they are produced, and the stage each sub-step reads.
STAGES = ["clean", "constructed", "integrated"]
UPSTREAM = {"3.2": None, "3.3": "clean", "3.4": "constructed", "3.5": "integrated"}


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    place, system = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that this package wrote."""
    for path in paths:
        place, system = _file_system(spark, path)
        system.delete(place, True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, anything else as tolerant CSV."""
    if not exists(spark, path):
        raise FileNotFoundError(f"table not found: {path}")
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path)


def keyed_rows(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose ``on`` is among ``keys``; a key that comes more than once gives no more rows."""
    return df.join(keys.select(on), on, "left_semi").select(df.columns)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order; files have no row order of their own."""
    return df.orderBy(*order).limit(n)


class StageStore:
    """Parquet tables ``<root>/<side>_<stage>.parquet`` of one preparation run."""

    def __init__(self, spark: SparkSession, root: str, raw_train: str, raw_test: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.raw = (raw_train, raw_test)

    def path(self, side: str, stage: str) -> str:
        return f"{self.root}/{side}_{stage}.parquet"

    def write(self, stage: str, train: DataFrame, test: DataFrame | None = None) -> None:
        train.write.mode("overwrite").parquet(self.path("train", stage))
        if test is not None:
            test.write.mode("overwrite").parquet(self.path("test", stage))

    def inputs(self, substep: str) -> tuple[str, str | None]:
        """Train and test path a sub-step reads: its own upstream stage, else an earlier one, else raw."""
        upstream = UPSTREAM.get(substep, STAGES[-1])
        if upstream is None:
            return self.raw
        for stage in reversed(STAGES[: STAGES.index(upstream) + 1]):
            train, test = self.path("train", stage), self.path("test", stage)
            has_test = exists(self.spark, test)
            if exists(self.spark, train) and (has_test or not self.raw[1]):
                return train, (test if has_test else None)
        return self.raw

    def read(self, substep: str) -> tuple[DataFrame, DataFrame | None]:
        train, test = self.inputs(substep)
        return read_table(self.spark, train), (read_table(self.spark, test) if test else None)
