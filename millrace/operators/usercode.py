"""Run a user's transform under a contract, with retries and a fallback."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut_lineage


@dataclass(frozen=True)
class TableContract:
    """Columns the output must have (with type) and conditions every row must meet."""

    columns: dict[str, str] = field(default_factory=dict)
    row_rules: dict[str, Callable[[], Column]] = field(default_factory=dict)
    same_row_count: bool = False


@dataclass(frozen=True)
class Outcome:
    table: DataFrame
    attempts: int
    degraded: bool
    errors: tuple[str, ...]


def contract_breaks(table: DataFrame, contract: TableContract, expected_rows: int | None = None) -> list[str]:
    """Names of the broken rules; one aggregation covers all row rules."""
    have = {f.name: f.dataType.simpleString() for f in table.schema}
    found = [f"column:{c}" for c, kind in contract.columns.items() if have.get(c) != kind]
    if found:
        return found
    rules = {name: F.count_if(~F.coalesce(rule(), F.lit(False))) for name, rule in contract.row_rules.items()}
    row = table.agg(F.count(F.lit(1)).alias("__rows"), *[c.alias(n) for n, c in rules.items()]).first()
    found += [f"rows:{n}" for n in rules if row[n]]
    if contract.same_row_count and row["__rows"] != expected_rows:
        found.append("row_count")
    return found


def apply_with_contract(
    df: DataFrame, transforms: Sequence[Callable[[DataFrame], DataFrame]], contract: TableContract, fallback: DataFrame
) -> Outcome:
    """First transform whose output keeps the contract, else the fallback, marked as degraded.

    The output is materialised before it is checked, so what was checked is what is used.
    """
    expected = df.count() if contract.same_row_count else None
    errors: list[str] = []
    for number, transform in enumerate(transforms, start=1):
        try:
            table = cut_lineage(transform(df))
            broken = contract_breaks(table, contract, expected)
        except Exception as error:  # user code may fail in any way
            broken = [f"raised:{type(error).__name__}"]
        if not broken:
            return Outcome(table, number, False, tuple(errors))
        errors += [f"{number}:{b}" for b in broken]
    return Outcome(fallback, len(transforms), True, tuple(errors))


def pandas_transform(function, schema: str | T.StructType) -> Callable[[DataFrame], DataFrame]:
    """Wrap a function on pandas batches for :func:`apply_with_contract`."""

    def batches(frames):
        for frame in frames:
            yield function(frame)

    return lambda df: df.mapInPandas(batches, schema)
