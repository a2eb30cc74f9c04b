"""Small fixed dimensions and look-ups with a default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sub-step, name, owner.
SUBSTEPS = [
    ("1.1", "Determine Business Objectives", "domain"),
    ("1.2", "Assess Situation", "domain"),
    ("1.3", "Determine Data Mining Goals", "domain"),
    ("1.4", "Produce Project Plan", "pm"),
    ("2.1", "Collect Initial Data", "data_engineer"),
    ("2.2", "Describe Data", "data_engineer"),
    ("2.3", "Explore Data", "data_scientist"),
    ("2.4", "Verify Data Quality", "data_engineer"),
    ("3.1", "Select Data", "data_engineer"),
    ("3.2", "Clean Data", "data_engineer"),
    ("3.3", "Construct Data", "data_engineer"),
    ("3.4", "Integrate Data", "data_engineer"),
    ("3.5", "Format Data", "data_engineer"),
    ("4.1", "Select Modeling Technique", "data_scientist"),
    ("4.2", "Generate Test Design", "data_scientist"),
    ("4.3", "Build Model", "data_scientist"),
    ("4.4", "Assess Model", "data_scientist"),
    ("5.1", "Evaluate Results", "data_scientist"),
    ("5.2", "Review Process", "pm"),
    ("5.3", "Determine Next Steps", "pm"),
    ("6.1", "Build Submission", "developer"),
    ("6.2", "Generate Report Evidence", "storyteller"),
    ("6.3", "Produce Final Report", "storyteller"),
    ("6.4", "Review Project", "developer"),
]


def substep_dimension(spark) -> DataFrame:
    """``(substep, name, owner, phase, position)``."""
    rows = [(s, n, o, int(s.split(".")[0]), i) for i, (s, n, o) in enumerate(SUBSTEPS)]
    return spark.createDataFrame(rows, "substep string, name string, owner string, phase int, position int")


def lookup(df: DataFrame, key: str, dimension: DataFrame, dimension_key: str, label: str, out: str) -> DataFrame:
    """Add ``out``: the label of the key, or the key itself where the dimension lacks it.

    No join hint: Spark broadcasts the dimension while its size allows and shuffles otherwise.
    """
    dim = dimension.select(F.col(dimension_key).alias("__key"), F.col(label).alias("__label"))
    joined = df.join(dim, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(out, F.coalesce("__label", F.col(key).cast("string"))).drop("__key", "__label")
