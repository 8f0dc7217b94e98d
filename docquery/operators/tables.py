"""Tables inside documents: cleaning, texts, records, Markdown and chunks, all within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.config import DEFAULTS
from docquery.functions.text import let, stripped


def admitted(tables: DataFrame) -> DataFrame:
    """Raw tables (rows: array<array<string>>) with a header row and a row of data at least: headers are the first row, null cells ''."""
    filled = F.transform("rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    return tables.filter(F.size("rows") > 1).withColumn("__r", filled).withColumn("headers", F.col("__r")[0]).withColumn("rows", F.slice("__r", F.lit(2), F.size("__r"))).drop("__r")


def clean_cell(cell: Column) -> Column:
    """Without white space at the ends, runs of it as one blank; null is ''."""
    return stripped(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def clean(tables: DataFrame) -> DataFrame:
    """Cells cleaned, headers made up where there is none, rows padded or cut to the headers; empty rows go, and tables without rows."""
    cells = lambda row: F.transform(row, clean_cell)
    widest = F.array_max(F.transform("rows", lambda r: F.size(r)))
    named = F.when(F.coalesce(F.exists(cells(F.col("headers")), lambda h: h != ""), F.lit(False)), cells(F.col("headers"))).otherwise(F.transform(F.sequence(F.lit(1), widest), lambda i: F.concat(F.lit("Column_"), i.cast("string"))))
    sized = lambda row, n: F.slice(F.concat(cells(row), F.array_repeat(F.lit(""), n)), F.lit(1), n)
    out = tables.filter(F.size("rows") > 0).withColumn("headers", named)
    out = out.withColumn("rows", let(F.size("headers"), lambda n: F.filter(F.transform("rows", lambda r: sized(r, n)), lambda r: F.exists(r, lambda c: c != ""))))
    return out.filter(F.size("rows") > 0)


def _header(headers: Column, i: Column, prefix: str) -> Column:
    return F.coalesce(F.get(headers, i), F.concat(F.lit(prefix), (i + 1).cast("string")))


def _row_lines(row: Column, number: Column, headers: Column, indent: str) -> Column:
    lines = F.transform(row, lambda c, j: F.concat(F.lit(indent), _header(headers, j, "Column "), F.lit(": "), c))
    return F.concat(F.array(F.concat(F.lit("Row "), number.cast("string"), F.lit(":"))), lines, F.array(F.lit("")))


def row_text(indent: str = "") -> Column:
    """A table's rows as text, a line for each cell; ``indent`` stands before cells."""
    head = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.array(F.concat(F.lit("Table: "), F.col("name")), F.lit(""))).otherwise(F.expr("cast(array() as array<string>)"))
    body = F.flatten(F.transform("rows", lambda r, i: _row_lines(r, i + 1, F.col("headers"), indent)))
    return F.array_join(F.concat(head, body), "\n")


def typed_value(value: Column) -> Column:
    """(type, value): a whole number, else a number, else the text; commas and underscores between digits don't count."""
    plain = F.regexp_replace(F.replace(stripped(value), F.lit(","), F.lit("")), r"(?<=[0-9])_(?=[0-9])", "")
    whole = F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint"))
    real = plain.try_cast("double")
    kind = F.when(value == "", "string").when(whole.isNotNull(), "int").when(real.isNotNull(), "float").otherwise("string")
    return F.struct(kind.alias("type"), F.when(kind == "int", whole.cast("string")).when(kind == "float", real.cast("string")).otherwise(value).alias("value"))


def records(tables: DataFrame) -> DataFrame:
    """Cells as typed records, in long form: (table_id, row_idx, key, type, value). Keys are headers in lower case with underscores; of equal keys in a row the last counts."""
    key = lambda h: F.replace(F.replace(F.lower(h), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    rows = tables.select("table_id", "headers", F.posexplode("rows").alias("row_idx", "row"))
    cells = rows.select("table_id", "row_idx", "headers", F.posexplode("row").alias("col", "cell"))
    named = cells.select("table_id", "row_idx", "col", key(F.when(F.col("col") < F.size("headers"), F.get("headers", F.col("col"))).otherwise(F.concat(F.lit("column_"), F.col("col") + 1))).alias("key"), "cell")
    last = named.groupBy("table_id", "row_idx", "key").agg(F.max_by("cell", "col").alias("cell"))
    return last.select("table_id", "row_idx", "key", typed_value(F.col("cell")).alias("v")).select("table_id", "row_idx", "key", "v.type", "v.value")


def markdown() -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.array(F.concat(F.lit("### "), F.col("name")), F.lit(""))).otherwise(F.expr("cast(array() as array<string>)"))
    bars = F.array(line(F.col("headers")), line(F.transform("headers", lambda h: F.lit("---"))))
    return F.array_join(F.concat(head, bars, F.transform("rows", lambda r: line(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))))), "\n")


def summary_line() -> Column:
    more = F.when(F.size("headers") > 3, "...").otherwise("")
    return F.format_string("Table '%s' with %d columns (%s%s) and %d rows", F.coalesce(F.col("name"), F.lit("Unnamed")), F.size("headers"), F.array_join(F.slice("headers", 1, 3), ", "), more, F.size("rows"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """One chunk for a whole table."""
    return tables.select("table_id", F.lit("table").alias("chunk_type"), row_text().alias("content"), F.size("rows").alias("row_count"), F.col("headers").alias("column_headers"))


def row_chunks(tables: DataFrame, limit: int = DEFAULTS.table_rows_limit, batch: int = DEFAULTS.table_batch) -> DataFrame:
    """Chunks of ``batch`` rows for tables of more than ``limit`` rows, with the range of rows."""
    large = tables.filter(F.size("rows") > limit).withColumn("first", F.explode(F.sequence(F.lit(1), F.size("rows"), F.lit(batch))))
    own = large.withColumn("part", F.slice("rows", F.col("first"), F.lit(batch))).withColumn("row_range", F.concat_ws("-", F.col("first").cast("string"), (F.col("first") + F.size("part") - 1).cast("string")))
    body = F.flatten(F.transform("part", lambda r, i: _row_lines(r, F.col("first") + i, F.col("headers"), "")))
    head = F.array(F.concat(F.lit("Table: "), F.col("name"), F.lit(" (Rows "), F.col("row_range"), F.lit(")")), F.lit(""))
    return own.select("table_id", F.lit("table_rows").alias("chunk_type"), "row_range", F.array_join(F.concat(head, body), "\n").alias("content"))


def named_by_page(tables: DataFrame, order: str = "place") -> DataFrame:
    """Admitted tables of pages (document_id, page_number, rows, and ``order``: where on the page), named by page and number on it; the number counts tables that are not admitted as well."""
    on_page = Window.partitionBy("document_id", "page_number").orderBy(order)
    numbered = tables.withColumn("table_index", F.row_number().over(on_page) - 1)
    return admitted(numbered).withColumn("name", F.concat_ws("_", F.lit("Table"), F.col("page_number").cast("string"), (F.col("table_index") + 1).cast("string")))


def section_tables(elements: DataFrame) -> DataFrame:
    """Tables of sectioned documents from their elements (document_id, place, type, text, rows) in order.

    A table is an element with ``rows``, its header row first; its section is the last
    heading before it, '' where there is none. Cells are stripped, null cells ''. A
    table is named by its number of rows, the header row among them; one that has a
    header alone stays, with no rows; one without any row goes.
    """
    so_far = Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when((F.col("type") == "heading") & (stripped(F.col("text")) != ""), stripped(F.col("text")))
    found = elements.withColumn("section", F.coalesce(F.last_value(heading, F.lit(True)).over(so_far), F.lit(""))).filter("type = 'table' and size(rows) > 0")
    cells = F.transform("rows", lambda r: F.transform(r, lambda c: stripped(F.coalesce(c, F.lit("")))))
    named = found.withColumns({"name": F.concat(F.lit("Table_"), F.size("rows").cast("string"), F.lit("rows")), "__r": cells})
    return named.withColumns({"headers": F.col("__r")[0], "rows": F.slice("__r", F.lit(2), F.size("__r"))}).drop("__r", "type", "text")
