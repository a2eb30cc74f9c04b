"""One-hot features with a dictionary table: any number of categories, none of them on the driver.

Fitting writes one table (slot, value, index) for all categorical columns, most frequent value first.
Transforming joins it to the rows, once for each column: Spark broadcasts the small dictionaries and shuffles for the
large ones, where it also splits hot values. Numbers and hot indices become one sparse vector.
"""

from __future__ import annotations

import json

from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.scan import HOT_ROWS, ordered_scan, row_number
from millrace.session import shared_folder

_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def fit_dictionary(train: DataFrame, columns: list[str], hot_rows: int = HOT_ROWS) -> tuple[str, list[int]]:
    """Folder of the table ``slot, value, index`` and the number of values of each column."""
    spark = train.sparkSession
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])
    counts = train.select(F.explode(cells).alias("c")).select("c.*").where("value IS NOT NULL").groupBy("slot", "value").agg((-F.count(F.lit(1))).alias("less"))
    ranked = ordered_scan(counts, ["slot"], ["less", "value"], {"place": row_number()}, hot_rows)
    path = shared_folder(spark, "categories")
    ranked.select("slot", "value", (F.col("place") - 1).cast("int").alias("index")).write.partitionBy("slot").parquet(path)
    found = {r["slot"]: r["n"] for r in _dictionary(spark, path).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
    return path, [found.get(i, 0) for i in range(len(columns))]


def _dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, index int, slot int").parquet(path)


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse ML vector from ascending indices and their values, inside the JVM and without names for its cells."""
    cells = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(cells.alias("v"))), _VECTOR)["v"]


class SparseFeatures(Transformer, MLWritable, MLReadable):
    """Numbers as they are, then one hot cell for each categorical column; an unknown category is all zeros."""

    def __init__(self, path: str = "", numbers: tuple = (), categories: tuple = (), sizes: tuple = (), out: str = "features"):
        super().__init__()
        self.path, self.numbers, self.categories, self.sizes, self.out = path, list(numbers), list(categories), list(sizes), out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, names = dataset.sparkSession, dataset.columns
        offset, cells = len(self.numbers), []
        for i, c in enumerate(self.numbers):
            cells.append(F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("x")))
        indexed = dataset
        for slot, (c, size) in enumerate(zip(self.categories, self.sizes)):
            known = _dictionary(spark, self.path).where(F.col("slot") == slot).select(F.col("value").alias(f"__v{slot}"), F.col("index").alias(f"__i{slot}"))
            indexed = indexed.join(known, indexed[f"`{c}`"].cast("string") == known[f"__v{slot}"], "left").drop(f"__v{slot}")
            place = F.col(f"__i{slot}") + offset
            cells.append(F.when(place.isNotNull(), F.struct(place.alias("i"), F.lit(1.0).alias("x"))))
            offset += size
        full = F.filter(F.array(*cells), lambda c: c.isNotNull())
        vector = sparse_vector(offset, F.transform(full, lambda c: c["i"]), F.transform(full, lambda c: c["x"]))
        return indexed.select(*[F.col(f"`{n}`") for n in names], vector.alias(self.out))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: SparseFeatures):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark, s = self.sparkSession, self.stage
        DefaultParamsWriter.saveMetadata(s, path, spark)
        facts = json.dumps([s.numbers, s.categories, s.sizes, s.out])
        spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.parquet(f"{path}/facts")
        if s.path:
            _dictionary(spark, s.path).write.partitionBy("slot").parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def load(self, path: str) -> SparseFeatures:
        spark = self.sparkSession
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        stage = SparseFeatures(f"{path}/dictionary", *facts)
        DefaultParamsReader.getAndSetParams(stage, DefaultParamsReader.loadMetadata(path, spark))
        return stage
