"""File sinks: partition replacement, CSV reports and exports, usage append."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.scores import usage_units
from rankloom.operators.ranking import numbered
from rankloom.session import stage

CSV_OPTIONS = {"header": "true", "nullValue": "", "emptyValue": "", "escape": '"'}


def replace_runs(rows: DataFrame, path: str, partition: str = "crawl_run_id") -> None:
    """Overwrite only the partitions present in ``rows`` — an idempotent re-run (K6)."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to an append-only table such as observations or usage."""
    rows.write.mode("append").parquet(path)


def write_split(rows: DataFrame, reason: str, path: str) -> None:
    """Rows without a reject reason, and the rest with it, as two tables of one pass."""
    state = F.when(F.col(reason).isNull(), "accepted").otherwise("quarantined")
    rows.withColumn("state", state).write.mode("overwrite").partitionBy("state").parquet(path)


def read_split(spark: SparkSession, path: str, state: str) -> DataFrame:
    """``accepted`` or ``quarantined`` rows; only their folder is read."""
    return spark.read.parquet(path).where(F.col("state") == state).drop("state")


#: A project's report is cut into files of so many lines; one after the other they are the report.
LINES_PER_FILE = 100_000


@dataclass
class Section:
    """A titled table of a report: its rows by ``project_id``, their order, the line that stands for none, and
    the projects that have the section, where not all do."""

    rows: DataFrame
    order: list[Column]
    empty: list[str] | None = None
    owners: DataFrame | None = None

    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "project_id"]


def csv_line(values: list[Column]) -> Column:
    """Values as one CSV line: nulls are empty, what holds a comma, quote or line break is quoted."""
    fields = []
    for v in values:
        text = F.coalesce(v.cast("string"), F.lit(""))
        fields.append(F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *fields)


def csv_values(values: list[str]) -> str:
    """Fixed values as one CSV line."""
    return ",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v for v in values)


def report_lines(sections: dict[str, Section], projects: DataFrame) -> DataFrame:
    """project_id, line_no (from 0) and line of every project's report: ``# title``, header, rows, blank line.

    A section is computed once and stored; its rows are numbered within it.  Where it begins follows from the
    sizes of the sections before, a row for each project and section.
    """
    all_owners, stored, sizes = projects.select("project_id").distinct(), [], []
    for place, section in enumerate(sections.values()):
        owners = all_owners if section.owners is None else all_owners.join(section.owners, "project_id", "left_semi")
        stored.append(stage(section.rows.join(owners, "project_id", "left_semi")))
        counts = stored[-1].groupBy("project_id").agg(F.count("*").alias("rows"))
        sizes.append(owners.join(counts, "project_id", "left").select(
            "project_id", F.lit(place).alias("place"), F.coalesce("rows", F.lit(0)).alias("rows"),
            F.lit(csv_values(section.empty) if section.empty else None).cast("string").alias("none"), F.lit(csv_values(section.columns())).alias("header")))
    # Title, header and blank line, and the rows or the line that stands for none.
    size = F.lit(3) + F.when((F.col("rows") == 0) & F.col("none").isNotNull(), 1).otherwise(F.col("rows"))
    before = W.partitionBy("project_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    spans = stage(reduce(DataFrame.unionByName, sizes).withColumn("size", size)
                  .withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0))))
    out = []
    for place, (title, section) in enumerate(sections.items()):
        own = spans.where(F.col("place") == place)
        first = F.col("first")
        marks = [F.struct((first + at).alias("line_no"), line.alias("line")) for at, line in (
            (F.lit(0), F.lit(csv_values([f"# {title}"]))), (F.lit(1), F.col("header")), (F.lit(2), F.when(F.col("rows") == 0, F.col("none"))),
            (F.col("size") - 1, F.lit("")))]
        out.append(own.select("project_id", F.inline(F.array(*marks))).where("line IS NOT NULL"))
        ranked = numbered(stored[place], ["project_id"], section.order, "_n")
        out.append(ranked.join(own.select("project_id", "first"), "project_id").select(
            "project_id", (first + 1 + F.col("_n")).alias("line_no"), csv_line([F.col(c) for c in section.columns()]).alias("line")))
    return reduce(DataFrame.unionByName, out).withColumn("line_no", F.col("line_no").cast("int"))


def write_report(sections: dict[str, Section], projects: DataFrame, path: str, lines_per_file: int = LINES_PER_FILE) -> None:
    """One CSV report per project under ``project_id=…``, all its sections in order.

    A task writes at most ``lines_per_file`` lines of a project, so a large report has several files, which
    ``part`` numbers; every other report is one file.
    """
    placed = report_lines(sections, projects).withColumn("part", F.expr(f"CAST(line_no DIV {int(lines_per_file)} AS INT)"))
    (placed.repartition("project_id", "part").sortWithinPartitions("project_id", "part", "line_no").select("project_id", "part", "line")
     .write.mode("overwrite").option("lineSep", "\r\n").partitionBy("project_id", "part").text(path))


def read_report(spark: SparkSession, path: str, lines_per_file: int = LINES_PER_FILE) -> DataFrame:
    """project_id, line_no and line of the written reports."""
    files = spark.read.schema("value string, project_id long, part int").text(path, wholetext=True)
    text = F.expr("substring(value, 1, length(value) - 2)")  # the last line ends too
    lines = files.select("project_id", "part", F.posexplode(F.split(text, "\r\n")).alias("at", "line"))
    return lines.select("project_id", (F.col("part") * lines_per_file + F.col("at")).cast("int").alias("line_no"), "line")


# Columns of the exported views.
VIEW_COLUMNS = {
    "keywords": {"keyword": "keyword", "intent": "intent", "volume": "search_volume", "cpc": "cpc",
                 "difficulty": "difficulty", "opportunity": "opportunity", "provider": "provider"},
    "issues": {"severity": "severity", "rule": "code", "name": "name", "message": "message",
               "urls": "affected_count", "recommendation": "advice"},
    "pages": {"url": "url", "status_code": "status_code", "indexability": "indexability",
              "title": "title", "h1": "h1", "words": "word_count", "latency_ms": "response_time_ms"},
}


def view_rows(rows: DataFrame, view: str) -> DataFrame:
    """The columns of a view export under their header names."""
    return rows.select(*[F.col(c).alias(header) for header, c in VIEW_COLUMNS[view].items()])


def write_view(rows: DataFrame, view: str, path: str) -> None:
    view_rows(rows, view).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def usage_rows(calls: DataFrame) -> DataFrame:
    """Calls with a ``size`` (depth or keyword count) → metered usage rows."""
    return calls.withColumn("units", usage_units(F.col("service"), F.col("size"))).drop("size")
