"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import file_label
from newsloom.operators.ranking import prefix_sums
from newsloom.session import pin

# Fixed columns of the merged run log, in order.
RUN_LOG_COLUMNS = ["duration", "emissions", "emissions_rate", "energy_consumed"]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    """Write with a header; ``one_file`` is for reports whose row count is bounded."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("header", True).csv(path)


# Cells are quoted with ", doubled inside; nothing else escapes.
CELL_OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
LINE_ORDER = ["block", "line"]


def _quotes(value: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def text_lines(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, file, block, line, value): the lines of all files, read in splits; (block, line) is their order in a file."""
    return (
        spark.read.option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", pattern)
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
    )


def csv_records(lines: DataFrame) -> DataFrame:
    """The same columns with a row for each record: lines that a quoted line feed parts are put together.

    A line ends its record if the quotes up to it are even. In files where each line has an even number, a
    line is a record. In others two running sums per file, made across tasks, number the records, so a
    file may have any size. A quote that is never closed takes the rest of its file, as for any reader.
    """
    open_lines = lines.where(_quotes("value") % 2 == 1)
    if open_lines.isEmpty():
        return lines.where("trim(value) <> ''")
    broken = pin(open_lines.select("path").distinct())
    order = [F.col(c).asc() for c in LINE_ORDER]
    counted = lines.join(broken, "path", "left_semi").withColumn("quotes", _quotes("value"))
    seen = prefix_sums(counted, order, "quotes", "seen", "path")
    starts = seen.withColumn("starts", ((F.col("seen") - F.col("quotes")) % 2 == 0).cast("int"))
    numbered = prefix_sums(starts, order, "starts", "record", "path")
    parts = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "value")))
    whole = numbered.groupBy("path", "file", "record").agg(parts.alias("parts"))
    whole = whole.select(
        "path",
        "file",
        *[F.get("parts", F.lit(0))[c].alias(c) for c in LINE_ORDER],
        F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"),
    )
    return lines.join(broken, "path", "left_anti").unionByName(whole).where("trim(value) <> ''")


def _cells(record: str, width: int) -> Column:
    """The cells of a record as an array of ``width``, null where it has fewer."""
    names = [f"c{i}" for i in range(width)]
    cells = F.from_csv(record, F.lit(", ".join(f"{c} string" for c in names)), CELL_OPTIONS)
    return F.array(*[cells[c] for c in names])


def merge_run_logs(
    spark: SparkSession, folder: str, columns: list[str] | None = None, pattern: str = "*.csv"
) -> DataFrame | None:
    """Stack CSV run logs, with model and method taken from each file's name.

    Files are read in splits; the first record of each is its header, which meets the file's other records by a join on
    the path, whatever headers there are. Nothing about single files reaches the driver or has to fit a
    task. A column that a file lacks is null; a file that cannot be read is skipped. Returns None when the
    folder holds no such line.
    """
    wanted = columns or RUN_LOG_COLUMNS
    records = csv_records(text_lines(spark, folder, pattern))
    at = F.struct(*LINE_ORDER)
    headers = pin(records.groupBy("path").agg(F.min_by("value", at).alias("header"), F.min(at).alias("first")))
    # A header has one comma more than cells at most, so this is wide enough for all.
    width = headers.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(","), F.lit(""))))).first()[0]
    if width is None:
        return None
    named = headers.select("path", "first", _cells("header", width + 1).alias("names"))
    rows = records.join(named, "path").where(at > F.col("first")).withColumn("cells", _cells("value", width + 1))
    model, method = file_label(F.col("file"))
    cell = lambda c: F.get("cells", (F.array_position("names", c) - 1).cast("int"))
    kept = [cell(c).try_cast("double").alias(c) for c in wanted]
    return rows.select(model.alias("model"), method.alias("method"), *kept)
