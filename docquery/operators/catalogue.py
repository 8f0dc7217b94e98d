"""Admission of files, metadata, the chunk store and the document catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.config import DEFAULTS
from docquery.functions.text import stripped
from docquery.sources.storage import cut


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = DEFAULTS.extensions, recursive: bool = True) -> DataFrame:
    """Files of a directory by extension, with their text (UTF-8; bytes that are none are left out, the character U+FFFD that a file really holds is not)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    kept = found.filter(F.lower("path").rlike("(" + "|".join(e.replace(".", "\\.") for e in extensions) + ")$"))
    return kept.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), F.col("length").alias("file_size"), F.md5("path").alias("document_id"), decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    """Bytes as text. What doesn't decode becomes U+FFFD and is dropped; U+FFFD of the file itself is set apart before by a private character, and that one by doubling."""
    raw = content.cast("string")
    mark = "\ue000"
    kept = F.replace(F.replace(raw, F.lit(mark), F.lit(mark + "0")), F.lit("\ufffd"), F.lit(mark + "1"))
    left = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.replace(left, F.lit(mark + "1"), F.lit("\ufffd")), F.lit(mark + "0"), F.lit(mark)))


def admitted(files: DataFrame, extensions: tuple[str, ...] = DEFAULTS.extensions, most: int = DEFAULTS.max_file_bytes) -> tuple[DataFrame, DataFrame]:
    """Files that may come in, with their tags as a list, and the others with a reason."""
    kind = F.concat(F.lit("."), F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)))
    reason = F.when(~kind.isin(*extensions), F.concat(F.lit("unsupported type: "), kind)).when(F.col("file_size") > most, F.lit("too large"))
    marked = files.withColumn("reason", reason).withColumn("tags", tag_list(F.col("tags")))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def tag_list(tags: Column) -> Column:
    """Tags between commas, without blanks around them and without empty ones."""
    return F.filter(F.transform(F.split(tags, ","), stripped), lambda t: t != "")


def flattened(chunks: DataFrame) -> DataFrame:
    """Metadata as a store of simple values keeps it: lists joined by commas, null as ''."""
    kinds = dict(chunks.dtypes)
    flat = lambda c: F.array_join(c, ",") if kinds[c].startswith("array") else F.col(c).cast("string")
    return chunks.select(*[F.coalesce(flat(c), F.lit("")).alias(c) for c in chunks.columns])


def write_store(chunks: DataFrame, path: str) -> None:
    """The chunk store: Parquet by department, so that a filter on it prunes partitions."""
    chunks.write.mode("append").partitionBy("department").parquet(path)


def upserted(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with newer versions of its chunks in place of older ones: the last created of each key."""
    last = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("version"))
    both = store.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    return both.withColumn("place", F.row_number().over(last)).filter("place = 1").drop("place", "version")


def deleted(store: DataFrame, documents: DataFrame) -> DataFrame:
    """The store without the chunks of the given documents (document_id)."""
    return store.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def _replace(rows: DataFrame, path: str, touched: list[str | None]) -> None:
    """Puts ``rows`` in place of the touched departments of the store at ``path``; the files of others stay.

    Rows are computed and kept in the shared folder first and then written by dynamic
    partition overwrite, so whatever fails while they are computed or written leaves the
    old store as it is.
    """
    kept = cut(rows)
    filled = {r.department for r in kept.select("department").distinct().collect()}
    if filled:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("department").parquet(path)
    spark = rows.sparkSession
    names = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for department in set(touched) - filled:  # departments that are empty now: an overwrite leaves what it has no row for
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, names.getPartitionPathString("department", department))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _departments(store: DataFrame, rows: DataFrame, key: str) -> list[str | None]:
    """Departments of the store that hold any of the keys: names of partitions, few whatever the store's size."""
    return [r.department for r in store.join(rows.select(key).distinct(), key, "left_semi").select("department").distinct().collect()]


def _of(store: DataFrame, departments: list[str | None]) -> DataFrame:
    """The partitions of some departments."""
    named = F.col("department").isin([d for d in departments if d is not None])
    return store.filter(named | F.col("department").isNull() if None in departments else named)


def upsert_store(new: DataFrame, path: str, key: str = "chunk_id") -> list[str | None]:
    """New and newer chunks into the store at ``path``, see ``upserted``: only departments that hold one of them, or held its older version, are written anew. They are returned."""
    store = new.sparkSession.read.schema(new.schema).parquet(path)
    touched = {*_departments(store, new, key), *(r.department for r in new.select("department").distinct().collect())}
    _replace(upserted(_of(store, [*touched]), new, key), path, [*touched])
    return sorted(touched, key=str)


def delete_from_store(spark: SparkSession, documents: DataFrame, path: str) -> list[str | None]:
    """Takes the chunks of documents (document_id) out of the store at ``path``; only departments that hold any are written anew. They are returned."""
    store = spark.read.parquet(path)
    touched = _departments(store, documents, "document_id")
    if touched:
        _replace(deleted(_of(store, touched), documents), path, touched)
    return sorted(touched, key=str)


def deletion_report(store: DataFrame, documents: DataFrame) -> DataFrame:
    """For each document of a delete list the number of chunks that go, and whether any does."""
    counted = store.groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.select("document_id").distinct().join(counted, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("deleted_chunks"), F.col("n").isNotNull().alias("deleted"))


def listed(store: DataFrame) -> DataFrame:
    """One row a document: the first chunk's metadata, the number of chunks and the derived status, by first appearance."""
    first = F.min_by(F.struct("filename", "file_type", "department", "tags"), F.struct("created_at", "chunk_id"))
    out = store.groupBy("document_id").agg(first.alias("m"), F.min("created_at").alias("upload_date"), F.count("*").alias("chunks_count"))
    return out.select("document_id", "m.filename", "m.file_type", "m.department", F.array_join("m.tags", ",").alias("tags"), "upload_date", "chunks_count", F.when(F.col("chunks_count") > 0, "completed").otherwise("failed").alias("status"))


def page(documents: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of a listing: 1 to 100 rows after ``skip``."""
    if not 1 <= limit <= 100 or skip < 0:
        raise ValueError("limit is 1 to 100, skip is not negative")
    return documents.orderBy("upload_date", "document_id").offset(skip).limit(limit)


def one_document(store: DataFrame, document_id: str) -> DataFrame:
    """A document's listing; the filter is applied before grouping and reaches the scan."""
    return listed(store.filter(F.col("document_id") == document_id))


#: Tables of a file as its parser gives them: of each table the rows, of each row the cells.
TABLES = "array<array<array<string>>>"


def parsed(files: DataFrame, extensions: tuple[str, ...] = DEFAULTS.extensions, *, tables: str | None = None) -> DataFrame:
    """Files (filename, text) with ``error``: what stops one from being processed, null where nothing does; others go on.

    A file of a format without a parser and one without content fail. ``tables`` names a
    column with the file's tables as JSON (null: none): ``table_rows`` has them, and a
    file fails whose JSON is malformed. A failed file has no tables.
    """
    kind = F.concat(F.lit("."), F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)))
    error = F.when(~kind.isin(*extensions), F.concat(F.lit("Unsupported file format: "), F.when(kind == ".", "").otherwise(kind))).when(F.col("text").isNull(), "No content")
    none = F.expr(f"cast(array() as {TABLES})")
    if tables is None:
        return files.withColumns({"table_rows": none, "error": error})
    read = F.from_json(tables, TABLES)
    out = files.withColumn("table_rows", F.when(F.col(tables).isNull(), none).otherwise(read))
    error = error.when(F.col("table_rows").isNull(), F.concat(F.lit("Malformed tables in "), "filename"))
    return out.withColumn("error", error).withColumn("table_rows", F.when(F.col("error").isNull(), F.col("table_rows")).otherwise(none))


def ingest_log(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Outcome of each file of ``parsed``: failed with its error, completed with its chunks and tables, or a warning where it gave no chunk. Chunks of a failed file don't count."""
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    good, n = F.col("error").isNull(), F.coalesce("n", F.lit(0))
    status = F.when(~good, "failed").when(n > 0, "completed").otherwise("warning")
    return files.join(counted, "document_id", "left").select("document_id", "filename", F.when(good, n).otherwise(0).alias("chunks_count"), F.size("table_rows").alias("tables_count"), status.alias("status"), "error")


def with_metadata(files: DataFrame, *, document_id: Column | None = None, **values: str | None) -> DataFrame:
    """Files with the metadata of an upload: an id (md5 of the file name unless given, so that runs repeat) and values by name where there is no such column."""
    out = files.withColumn("document_id", F.md5("filename") if document_id is None else document_id)
    missing = {k: F.lit(v).cast("string") for k, v in values.items() if k not in files.columns}
    return out.withColumns(missing) if missing else out


def processed_totals(log: DataFrame) -> DataFrame:
    """Documents processed and chunks created, by an ingest log; failed documents are counted apart."""
    return log.agg(F.count_if(F.col("status") != "failed").alias("documents_processed"), F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("chunks_created"), F.count_if(F.col("status") == "warning").alias("warnings"), F.count_if(F.col("status") == "failed").alias("failures"))
