"""Gold lists, markup lines and trip tables as text."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnmark.functions.text import repaired_date


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a gold list: trimmed lines, without blank ones and those that begin with #; drive letters and shares get a local: prefix."""
    line = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    rows = spark.read.text(path).select(line.alias("path")).where("path <> '' AND NOT startswith(path, '#')")
    return rows.select(F.when(F.col("path").rlike(r"^([A-Za-z]:\\|\\\\)"), F.concat(F.lit("local:"), "path")).otherwise(F.col("path")).alias("path")).distinct()


def read_markup(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines with one row for each ``path``, the last of the file; lines that are no JSON or have no path are left out."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    rows = lines.select("line", F.from_json("value", schema).alias("row")).where("row.path IS NOT NULL")
    return rows.groupBy("row.path").agg(F.max_by("row", "line").alias("row")).select("row.*")


def write_markup(rows: DataFrame, path: str) -> None:
    """JSON lines in order of path, in files that follow each other in that order."""
    rows.orderBy("path").write.mode("overwrite").json(path)


def read_trips(spark: SparkSession, path: str, headers: int = 2, encoding: str = "UTF-8") -> DataFrame:
    """(place_country, start_date, end_date) of a trip table with semicolons: country, ., entry, exit; dates are repaired and put in order."""
    raw = spark.read.option("encoding", encoding).text(path).select("value", F.monotonically_increasing_id().alias("line"))
    cells = F.split(F.regexp_replace("value", "^\ufeff", ""), ";")
    cell = lambda i: F.trim(F.try_element_at(cells, F.lit(i + 1)))
    skip = raw.orderBy("line").limit(headers).select("line")  # the first lines alone
    rows = raw.join(F.broadcast(skip), "line", "left_anti").select(cell(0).alias("place_country"), repaired_date(cell(2)).alias("a"), repaired_date(cell(3)).alias("b"))
    return rows.where("place_country <> '' AND a IS NOT NULL").select("place_country", F.least("a", "b").alias("start_date"), F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("end_date"))


def trip_rows(files: DataFrame) -> DataFrame:
    """(line, name, place_country, start_date, end_date) of trip tables (path, content): semicolons, two lines of heads, country, ., entry, exit.

    A file that is UTF-8 as a whole, with or without a mark, is read so, any other as cp1251. A trip without an exit lasts a
    day, swapped dates are put in order, and rows without a country or an entry date are left out. A trip is named by its
    year and country. Lines count through the files in the order of their paths.
    """

    def read(frames):
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = bytes(content)
                try:
                    text = raw.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = raw.decode("cp1251", "replace")
                for n, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=";")):
                    if n > 1 and len(row) > 3:
                        out.append((path, n, row[0].strip(), row[2], row[3]))
            yield pd.DataFrame(out, columns=["path", "n", "place_country", "entry", "exit"])

    rows = files.select("path", "content").mapInPandas(read, "path string, n long, place_country string, entry string, exit string")
    dated = rows.select(F.struct("path", "n").alias("line"), "place_country", repaired_date(F.col("entry")).alias("a"), repaired_date(F.col("exit")).alias("b")).where("place_country <> '' AND a IS NOT NULL").withColumn("b", F.coalesce("b", "a"))
    start = F.least("a", "b")
    return dated.select("line", F.concat(F.year(start).cast("string"), F.lit(" "), "place_country").alias("name"), "place_country", start.alias("start_date"), F.greatest("a", "b").alias("end_date"))


#: Statements that list what there is, beside queries.
LISTINGS = {"ShowTables", "ShowViews", "ShowColumns", "ShowFunctions", "ShowNamespaces", "DescribeRelation", "DescribeColumn", "DescribeQueryCommand"}


def read_query(spark: SparkSession, text: str) -> DataFrame:
    """The result of one query, or of one listing (``LISTINGS``), over registered views.

    What a statement is, its parsed plan tells: it may hold no command, no insertion and no script. Others, several
    statements and empty texts are refused with a ValueError; nothing of them runs.
    """
    if not text.strip():
        raise ValueError("the statement is empty")
    session, jvm = spark._jsparkSession, spark._jvm
    try:
        todo = [session.sessionState().sqlParser().parsePlan(text)]
    except ParseException as e:
        raise ValueError(f"not one statement: {e}") from e
    if todo[0].nodeName() not in LISTINGS:
        kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement", "ScriptTransformation")]
        while todo:
            node = todo.pop()
            if any(k.isInstance(node) for k in kinds):
                raise ValueError(f"only queries and listings are read, not {node.nodeName()}")
            inner = [node.children(), node.innerChildren()]
            todo += [s.apply(i) for s in inner for i in range(s.size()) if jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(s.apply(i))]
    return spark.sql(text)
