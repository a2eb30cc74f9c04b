"""CSV files of unknown encoding, delimiter and types."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut_lineage
from millrace.sources.records import quoted_records, text_lines

# Texts that mean "missing" in data files.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
# The characters Windows-1252 has at 0x80..0x9F where Latin-1 has controls.
# The five unused positions (0x81, 0x8D, 0x8F, 0x90, 0x9D) are left out.
WINDOWS_CODES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
WINDOWS_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
UNUSED_CODES = "[\x81\x8d\x8f\x90\x9d]"
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES = 20
HEAD_BYTES = 1 << 16  # step of reading until SNIFF_LINES lines are there


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, encoding, header, quoted, old_breaks)``: utf-8, cp1252 or latin-1, decided over all bytes, the first
    line, whether any cell may be quoted, and whether lines end in carriage returns alone."""
    # The text source hands over the bytes of a line as they are.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        # Blocks of a file by offset, lines of a block by the order in which they are read.
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
    )
    utf8 = F.is_valid_utf8("value")
    unused = ~utf8 & F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(UNUSED_CODES)
    return lines.groupBy("file").agg(
        F.when(F.bool_and(utf8), "utf-8").when(F.bool_or(unused), "latin-1").otherwise("cp1252").alias("encoding"),
        F.min_by(F.regexp_replace("value", "\r$", ""), "at").alias("header"),
        F.bool_or(F.contains("value", F.lit('"'))).alias("quoted"),
        ((F.count(F.lit(1)) == 1) & F.bool_or(F.col("value").rlike("\r[^\r]"))).alias("old_breaks"),
    )


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    return file_facts(spark, path).select("file", "encoding")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header in any of utf-8, cp1252 or latin-1; types are inferred unless given.

    Files with different headers are read each under their own and put together by name. Quoted cells may
    hold line breaks, and a large file is split all the same. ``multi_line=False`` promises that no cell does.
    """
    facts = cut_lineage(file_facts(spark, path))
    text = _read_simple(spark, path, facts, sep, multi_line)
    if text is None:
        names = _layout(facts.where("not old_breaks"), sep)
        text = _read_by_name(spark, path, facts, names, sep, multi_line)
    text = text.select(*[missing_to_null(F.col(f"`{c}`")).alias(c) for c in text.columns])
    if schema is None:
        return cast_inferred(text)
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def _read_simple(spark, path, facts: DataFrame, sep: str, multi_line: bool, trim: bool = False) -> DataFrame | None:
    """Spark's own reader, where all files have one layout and no cell can hold a line break."""
    kinds = facts.groupBy("encoding", "header").agg(F.bool_or("quoted").alias("quoted"), F.bool_or("old_breaks").alias("old")).limit(2).collect()
    if not kinds:
        raise FileNotFoundError(f"no rows in {path}")
    if len(kinds) > 1 or kinds[0]["old"] or (multi_line and kinds[0]["quoted"]):
        return None
    return _read_text_columns(spark, [path], kinds[0]["encoding"], sep, False, trim)


def _decoded(value: Column, encoding: Column) -> Column:
    one_byte = F.decode(value, "ISO-8859-1")
    return F.when(encoding == "utf-8", value.cast("string")).when(encoding == "cp1252", F.translate(one_byte, WINDOWS_CODES, WINDOWS_CHARACTERS)).otherwise(one_byte)


def _cells(record: Column, width: int, sep: str, trim: bool) -> Column:
    """The first ``width`` cells of a record as an array."""
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    options |= {"ignoreLeadingWhiteSpace": str(trim).lower(), "ignoreTrailingWhiteSpace": str(trim).lower()}
    # One struct of cells, named by place; the additional cell takes what a header did not announce.
    fields = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(record, fields, options)
    return F.transform(F.array(parsed), lambda r: F.array(*[r[f"c{i}"] for i in range(width)]))[0]


def _header_names(header: Column, encoding: Column, width: int, sep: str) -> Column:
    """Column names of a header as Spark's reader gives them: a place for no name, and behind names that come twice."""
    cells = F.transform(_cells(_decoded(header.cast("binary"), encoding), width + 1, sep, True), lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\ufeff"), F.lit("")), F.lit("ï»¿"), F.lit(""))))
    announced = F.slice(cells, 1, F.greatest(F.lit(1), F.size(F.split(header, "\\Q" + sep + "\\E"))))

    def named(all_cells: Column) -> Column:
        def name(cell: Column, i: Column) -> Column:
            again = F.size(F.filter(all_cells, lambda o: F.lower(o) == F.lower(cell))) > 1
            return F.when(cell == "", F.concat(F.lit("_c"), i.cast("string"))).when(again, F.concat(cell, i.cast("string"))).otherwise(cell)

        return F.transform(all_cells, name)

    return F.transform(F.array(announced), named)[0]


def _width(facts: DataFrame, sep: str) -> int:
    return facts.agg(F.max(F.size(F.split("header", "\\Q" + sep + "\\E")))).first()[0] or 1


def _layout(facts: DataFrame, sep: str) -> list[str]:
    """All column names: those of the first file, then those that later files add (as many as the result has)."""
    listed = facts.select("file", F.posexplode(_header_names(F.col("header"), F.col("encoding"), _width(facts, sep), sep)).alias("place", "name"))
    return [r["name"] for r in listed.groupBy("name").agg(F.min(F.struct("file", "place")).alias("at")).orderBy("at").collect()]


def _records(spark, path, facts: DataFrame, sep: str, multi_line: bool, trim: bool) -> DataFrame:
    """``file, encoding, header, text`` of all records but each file's first; blank ones are left out."""
    lines = text_lines(spark, path)
    records = quoted_records(lines, sep, trim) if multi_line else lines
    first = F.struct("block", "line")
    heads = records.where("block = 0").groupBy("file").agg(F.min(first).alias("__first"))
    about = cut_lineage(facts.where("not old_breaks").select("file", "encoding", "header").join(heads, "file"))
    joined = records.join(about, "file").where(first != F.col("__first"))
    text = F.regexp_replace(_decoded(F.col("value"), F.col("encoding")), "\r$", "")
    return joined.select("file", "encoding", "header", text.alias("text")).where(F.col("text").rlike("[^\\x00-\\x20]"))


def _read_by_name(spark, path, facts: DataFrame, names: list[str], sep: str, multi_line: bool) -> DataFrame:
    width = _width(facts, sep)
    parts = []
    if names:
        rows = _records(spark, path, facts, sep, multi_line, False)
        rows = rows.select(_header_names(F.col("header"), F.col("encoding"), width, sep).alias("h"), _cells(F.col("text"), width, sep, False).alias("c"))
        parts.append(rows.select(*[F.get("c", F.array_position("h", F.lit(n)).cast("int") - 1).alias(n) for n in names]))
    # Files of one line for Hadoop: whole records need Spark's reader of whole files.
    for r in facts.where("old_breaks").select("file", "encoding").collect():
        parts.append(_read_text_columns(spark, [r["file"]], r["encoding"], sep, True))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_text_columns(spark, files: list[str], encoding: str, sep: str, multi_line: bool, trim: bool = False) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
        .option("encoding", "UTF-8" if encoding == "utf-8" else "ISO-8859-1")
    )
    df = reader.csv(files)
    # In one-byte encodings the mark at the start of a file shows as three characters.
    df = df.toDF(*[c.strip().removeprefix("\ufeff").removeprefix("ï»¿") for c in df.columns])
    if encoding == "cp1252":
        df = df.select(*[F.translate(F.col(f"`{c}`"), WINDOWS_CODES, WINDOWS_CHARACTERS).alias(c) for c in df.columns])
    return df


def missing_to_null(column: Column) -> Column:
    return F.when(~column.isin(MISSING_TOKENS), column)


def cast_inferred(text: DataFrame) -> DataFrame:
    """Give every all-text column the narrowest of long, double, boolean and string that fits all rows."""
    kinds = ["bigint", "double", "boolean"]
    checks = []
    for i, c in enumerate(text.columns):
        value = F.col(f"`{c}`")
        for kind in kinds:
            readable = value.try_cast(kind).isNotNull()
            if kind == "bigint":
                readable = value.rlike(r"^\s*[+-]?[0-9]+\s*$") & readable
            if kind == "boolean":
                readable = F.lower(value).isin("true", "false")
            checks.append((F.count_if(value.isNotNull() & ~F.coalesce(readable, F.lit(False))) == 0).alias(f"{i}_{kind}"))
        checks.append((F.count(value) == 0).alias(f"{i}_empty"))
    fits = text.agg(*checks).first()
    columns = []
    for i, c in enumerate(text.columns):
        kind = "double" if fits[f"{i}_empty"] else next((k for k in kinds if fits[f"{i}_{k}"]), "string")
        columns.append(F.col(f"`{c}`").cast(kind).alias(c))
    return text.select(*columns)


def read_strings(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = True) -> DataFrame:
    """Every cell as trimmed text; short rows are padded, surplus cells dropped.

    The header is the first line of the first file in name order; without ``sep`` the delimiter is sniffed
    from it. All files are read under that header.
    """
    facts = cut_lineage(file_facts(spark, path))
    first = facts.orderBy("file").select("header", "encoding", sniff_delimiter(F.col("header")).alias("sep")).limit(1)
    row = first.first()
    if row is None:
        raise FileNotFoundError(f"no rows in {path}")
    sep = sep or row["sep"]
    simple = _read_simple(spark, path, facts, sep, multi_line, trim=True)
    if simple is not None:
        return simple
    names = first.select(_header_names(F.col("header"), F.col("encoding"), _width(first, sep), sep).alias("h")).first()["h"]
    cells = _records(spark, path, facts, sep, multi_line, True).select(_cells(F.col("text"), len(names), sep, True).alias("c"))
    parts = [cells.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])]
    for r in facts.where("old_breaks").select("file", "encoding").collect():
        parts.append(_read_text_columns(spark, [r["file"]], r["encoding"], sep, True, trim=True))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _arrow_uri(path: str) -> str:
    """Hadoop's spelling of a location in Arrow's."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return path.replace("file:/", "file:///", 1)
    return path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path


def file_heads(listing: DataFrame, lines: int = SNIFF_LINES) -> DataFrame:
    """``(path, head)``: the first whole lines of every listed file as text, read inside the tasks."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch["path"]:
                system, place = fs.FileSystem.from_uri(_arrow_uri(path))
                with system.open_input_stream(place) as stream:
                    head = b""
                    while head.count(b"\n") < lines and (more := stream.read(HEAD_BYTES)):
                        head += more
                found.append(b"\n".join(head.split(b"\n")[:lines]).decode("utf-8", errors="replace"))
            yield pd.DataFrame({"path": batch["path"], "head": found})

    return listing.select("path").mapInPandas(heads, "path string, head string")


def sniff_delimiter(head: Column) -> Column:
    """Delimiter that splits the first lines into the same number of cells, most cells first."""
    lines = F.filter(F.slice(F.split(head, r"\R"), 1, SNIFF_LINES), lambda l: F.trim(l) != "")

    def score(delimiter: str) -> Column:
        counts = F.transform(lines, lambda l: F.length(l) - F.length(F.replace(l, F.lit(delimiter), F.lit(""))))
        steady = F.array_min(counts) == F.array_max(counts)
        return F.when(steady & (F.array_min(counts) > 0), F.array_min(counts))

    scored = F.filter(
        F.array(*[F.struct(score(d).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("sep")) for i, d in enumerate(DELIMITERS)]),
        lambda s: s["n"].isNotNull(),
    )
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    guess = F.when(F.contains(first, F.lit("\t")), "\t").when(F.contains(first, F.lit(";")), ";").otherwise(",")
    return F.coalesce(F.array_max(scored)["sep"], guess)


def write_csv(df: DataFrame, path: str) -> None:
    """Predictions as CSV parts with a header; parts are not merged into one task."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
