"""Text reports at the edge: agreement as lines, lines scanned back, wide score tables as CSV, and number and title formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import score

MUTUAL, HEAD, TAIL = "Mutual Termination Level: ", "--- Agreement Analysis Results ---", "----------------------------------"
_RULE = ("corpus", "idx_a", "idx_b")


def titled(name: str) -> str:
    """A column's name as a heading."""
    return name.replace("_", " ").title()


def number(value: Column, places: int = 2) -> Column:
    """A number with thousands separators."""
    return F.format_number(value, places)


def agreement_lines(agreed: DataFrame) -> DataFrame:
    """(corpus, idx_a, idx_b, line_no, line): a report of each pair, its rows between a heading and a rule."""
    row = F.format_string("%d %d %d %.2f", "level_a", "total", "matching", "pct")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("level_a", row.alias("line")))), lambda x: x["line"])
    per = agreed.groupBy(*_RULE).agg(F.first("mutual_tl").alias("mutual_tl"), rows.alias("rows"))
    fixed = F.array(F.concat(F.lit(MUTUAL), F.col("mutual_tl").cast("string")), F.lit(HEAD), F.lit("Termination_Level Total Matching Percentage"))
    return per.select(*_RULE, F.posexplode(F.concat(fixed, "rows", F.array(F.lit(TAIL)))).alias("line_no", "line"))


def scan_agreement(lines: DataFrame, by: tuple[str, ...] = _RULE) -> DataFrame:
    """(by, mutual_tl, level_a, total, matching) of report lines (by, line_no, line): the mutual level is the last one read, rows count
    between heading and rule, and lines that are no rows are skipped."""
    order = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mutual = F.when(F.col("line").contains(MUTUAL.strip()), F.regexp_extract("line", r"(-?[0-9]+)", 1).cast("int"))
    inside = F.when(F.col("line").contains(HEAD), True).when(F.col("line").contains(TAIL), False)
    carried = lines.withColumn("mutual_tl", F.last(mutual, True).over(order)).withColumn("inside", F.last(inside, True).over(order))
    parts = F.split(F.trim("line"), r"\s+")
    rows = carried.where(F.col("inside") & F.col("mutual_tl").isNotNull() & F.trim("line").rlike(r"^-?[0-9]+\s+[0-9]+\s+[0-9]+(\s|$)"))
    return rows.select(*by, "mutual_tl", parts[0].cast("int").alias("level_a"), parts[1].cast("long").alias("total"), parts[2].cast("long").alias("matching"))


def eod_columns(wide: DataFrame, names: list[str]) -> DataFrame:
    """The wide table's columns in the order of its file: a score and a level for each combination."""
    cells = [F.col(f"`{n}_{part}`").alias(f"eod_{part}_{n}") for n in names for part in ("score", "tl")]
    return wide.select("master_idx", "word", *cells)


def write_eod(table: DataFrame, names: list[str], path: str) -> None:
    """The wide table as CSV with a header."""
    eod_columns(score.eod_wide(table, names), names).write.mode("overwrite").csv(path, header=True)
