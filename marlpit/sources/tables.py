"""Schemas of stored tables, readers, and keyed upserts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.functions.text import base_name, document_id, document_type, extension, mime_type
from marlpit.sources.membership import build, possible
from marlpit.sources.pages import OWN_PARSERS, Parser, read_pages
from marlpit.sources.scratch import written

SCHEMAS = {
    "documents": "document_id string, title string, team_owner string, document_type string, visibility string, version string, sha256 string, source_path string, last_updated timestamp_ntz",
    "agents": "agent_id string, name string, parent_agent string, role string, version string, status string",
    "chunks": "chunk_id string, document_id string, sequence int, text string, char_start int, char_end int",
    "vectors": "chunk_id string, embedding array<double>",
    "files": "path string, file_name string, document_type string, mime_type string, file_size long, modified_at timestamp, sha256 string, text string, error string, run string",
    "agent_scores": "agent string, n long, total decimal(38,12), batch long",
    "memory": "memory_id string, content string, context map<string,string>, created_at string, confidence double",
    "memory_grams": "gram string, memory_id string, field int, place int",
    "graph_entities": "id string, name string, entity_type string, description string, metadata string, owner string, visibility string",
    "graph_relationships": "source_id string, target_id string, relation_type string, description string, confidence double, metadata string",
}
KEYS = {"documents": ["document_id"], "agents": ["agent_id"], "agent_scores": ["agent"], "chunks": ["chunk_id"], "vectors": ["chunk_id"], "files": ["path"], "memory": ["memory_id"], "memory_grams": ["gram", "memory_id", "field", "place"], "graph_entities": ["id"], "graph_relationships": ["source_id", "target_id", "relation_type"]}

#: Tables whose keys never come twice, so that versions are only put together.
ADDED = {"memory_grams"}
#: Tables whose versions have a membership filter, with its column.
FILTERED = {"documents": "sha256"}
#: Values that passed the filters and are broadcast at most; beyond it both sides are dealt out.
BROADCAST_HITS = 200_000
#: Rows in a page of a stored file: a reader skips pages that can't hold the keys that it is asked for.
PAGE_ROWS = 1_000

#: Extensions whose files need a parser.
PARSED = (".pdf", ".doc", ".docx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Versions of a stored table that are read together before they are written as one.
VERSIONS_MOST = 8
VERSION = re.compile(r"(\d{8})-(full|part)")


def _files(spark: SparkSession, path: str):
    """Hadoop's path and its file system, whatever store it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _files(spark, path)
    return fs.exists(target)


def versions_of(spark: SparkSession, folder: str, name: str) -> list[tuple[int, str]]:
    """(number, path) of complete versions, from the last full one on. Spark marks a folder when all of it is there."""
    target, fs = _files(spark, f"{folder}/{name}")
    if not fs.exists(target):
        return []
    found = sorted((int(m[1]), m[2], str(x.getPath())) for x in fs.listStatus(target) if (m := VERSION.fullmatch(x.getPath().getName())))
    found = [x for x in found if exists(spark, f"{x[2]}/_SUCCESS")]
    last = max((number for number, kind, _ in found if kind == "full"), default=0)
    return [(number, path) for number, _, path in found if number >= last]


def mark_complete(spark: SparkSession, path: str) -> None:
    """Marks a version that has several tables, as Spark marks those of one."""
    target, fs = _files(spark, f"{path}/_SUCCESS")
    fs.create(target, True).close()


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table: of each key the row of its last version. An empty one with its schema if it isn't there yet."""
    return _latest(spark, folder, name, F.lit(True))


def lookup(spark: SparkSession, folder: str, name: str, keys: Sequence[str]) -> DataFrame:
    """Rows of a stored table by values of its first key column. Files are in the order of keys, so that readers open the
    few row groups and pages that can hold these; versions are put together for these alone."""
    return _latest(spark, folder, name, F.col(KEYS[name][0]).isin(list(keys)))


def _latest(spark: SparkSession, folder: str, name: str, wanted: Column) -> DataFrame:
    versions = versions_of(spark, folder, name)
    if not versions:
        return spark.createDataFrame([], SCHEMAS[name])
    rows = spark.read.schema(f"{SCHEMAS[name]}, _version long").parquet(*[path for _, path in versions]).filter(wanted)
    if len(versions) > 1 and name not in ADDED:
        columns = [c for c in rows.columns if c != "_version"]
        return rows.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*columns), "_version").alias("row")).select("row.*")
    return rows.drop("_version")


def store(spark: SparkSession, folder: str, name: str, incoming: DataFrame) -> None:
    """Upserts into a stored table, by one writer at a time: incoming rows become its next version, nothing is rewritten.

    A version counts once Spark has marked it as complete, so a crash leaves the table as it was, and a batch that is
    stored again changes nothing. After some versions all rows are written as one, and older ones go.
    """
    versions = versions_of(spark, folder, name)
    _write(incoming, folder, name, versions[-1][0] + 1 if versions else 1, "part")
    if len(versions) + 1 > VERSIONS_MOST:
        compact(spark, folder, name)


def _write(rows: DataFrame, folder: str, name: str, number: int, kind: str) -> None:
    columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
    if kind == "full" or name in ADDED:
        rows = rows.repartitionByRange(KEYS[name][0])  # each file has a range of keys
    placed = rows.select(*columns, F.lit(number).cast("long").alias("_version")).sortWithinPartitions(*KEYS[name])
    path = f"{folder}/{name}/{number:08d}-{kind}"
    placed.write.option("parquet.page.row.count.limit", PAGE_ROWS).mode("overwrite").parquet(path)
    if name in FILTERED:
        _filter(rows.sparkSession, name, number, path).write.mode("overwrite").parquet(_filter_path(path, name))


def _filter_path(version: str, name: str) -> str:
    """The place of the filter of a version, beside the table."""
    head, _, last = version.rpartition("/")
    return f"{head.removesuffix(name)}{name}_filter/{last}"


def _filter(spark: SparkSession, name: str, number: int, path: str) -> DataFrame:
    rows = spark.read.schema(SCHEMAS[name]).parquet(path)
    return build(rows, FILTERED[name], number, rows.count())


def members(spark: SparkSession, folder: str, name: str, asked: DataFrame) -> DataFrame:
    """Rows of a stored table whose filtered column has a value among `asked`, a table of that column with few repeats.

    Filters of the versions name the values that may be there; rows with these are found by a scan of two columns, and
    the last versions of their keys are read and tested. The stored table is shuffled nowhere but for those keys. A
    version without a filter, after a crash between the two or from before there were any, has its filter worked out.
    """
    versions, by = versions_of(spark, folder, name), FILTERED[name]
    if not versions:
        return spark.createDataFrame([], SCHEMAS[name])
    there = {number: exists(spark, f"{_filter_path(path, name)}/_SUCCESS") for number, path in versions}
    filters = [spark.read.parquet(_filter_path(path, name)) if there[number] else _filter(spark, name, number, path) for number, path in versions]
    hits = _bounded(written(possible(asked, by, reduce(DataFrame.unionByName, filters))))
    rows = spark.read.schema(f"{SCHEMAS[name]}, _version long").parquet(*[path for _, path in versions])
    found = rows.select(*KEYS[name], by).join(hits, by, "left_semi").select(*KEYS[name])
    keys = _bounded(written(found.distinct()))
    columns = [c for c in rows.columns if c != "_version"]
    own = rows.join(keys, KEYS[name], "left_semi")
    last = own.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*columns), "_version").alias("row")).select("row.*")
    return last.join(hits, by, "left_semi").select(*columns)


def _bounded(rows: DataFrame) -> DataFrame:
    """Rows that are written, marked for broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_HITS else rows


def compact(spark: SparkSession, folder: str, name: str) -> None:
    """All rows of a stored table as one full version; those before it go when it is complete."""
    versions = versions_of(spark, folder, name)
    if not versions:
        return
    _write(stored(spark, folder, name), folder, name, versions[-1][0] + 1, "full")
    for old in [path for _, path in versions] + [_filter_path(path, name) for _, path in versions if name in FILTERED]:
        target, fs = _files(spark, old)
        fs.delete(target, True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both by key; incoming rows replace all columns, with nulls too. Keys of incoming rows are to be unique."""
    columns = existing.columns
    of = lambda rows, late: rows.select(F.struct(*[F.col(k) for k in keys]).alias("key"), F.struct(*columns).alias("row"), F.lit(late).alias("late"))
    latest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("late")))
    return of(existing, 0).unionByName(of(incoming, 1)).withColumn("rank", latest).filter("rank = 1").select("row.*")


def pages_text(pages: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, text): texts of a document's pages that aren't blank, in order, a newline between them."""
    kept = pages.filter(F.regexp_replace(text, r"(?U)\s+", "") != "")
    return kept.groupBy(by).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])).alias("text"))


def read_files(spark: SparkSession, folder: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """(path, file_name, document_type, mime_type, file_size, modified_at, content) of a folder's files by path.

    A limit of 0 or None is none. Creation times aren't known to Spark's file source.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    found = files.select("path", base_name("path").alias("file_name"), document_type("path").alias("document_type"), mime_type("path").alias("mime_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), "content").orderBy("path")
    return found.limit(limit) if limit else found


def read_texts(spark: SparkSession, folder: str, pattern: str = "*", limit: int | None = None, extractors: Mapping[str, Column | Parser] | None = None) -> DataFrame:
    """read_files with (sha256, text, error) in place of the content: a file that can't be read gives a row, no failure.

    Files are UTF-8 text, but for PDF and Word files, whose texts come from an extractor for their extension: a function
    in Python from the bytes to the pages' texts, or a column of `content`. What a function raises is the file's error;
    a column must not raise. `.docx` needs none. text is null and error says why where there is no extractor, it gives
    no text, or the bytes aren't UTF-8. A folder that isn't there is an error.
    """
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    files = read_files(spark, folder, pattern, limit)
    given = OWN_PARSERS | dict(extractors or {})
    columns = {k: x for k, x in given.items() if isinstance(x, Column)}
    parsers = {k: x for k, x in given.items() if k not in columns}
    kind, own = extension("path"), F.col("content").cast("string")
    text = F.when(kind.isin(*PARSED), F.lit(None).cast("string")).when(F.is_valid_utf8(own), own)
    error = F.when(kind.isin(*PARSED), F.concat(F.lit("no extractor for "), kind)).when(~F.is_valid_utf8(own), F.lit("not UTF-8"))
    for name, column in columns.items():
        text = F.when(kind == name, column).otherwise(text)
        error = F.when(kind == name, F.when(column.isNull(), F.concat(F.lit("no text in "), kind))).otherwise(error)
    named = [c for c in files.columns if c != "content"]
    read = files.select(*named, sha256(F.col("content")).alias("sha256"), text.alias("text"), error.alias("error"))
    pages = read_pages(files, parsers)
    kept = F.when(F.regexp_replace("text", r"(?U)\s+", "") != "", F.struct("page", "text"))
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]))
    parsed = pages.groupBy(F.col("path").alias("its")).agg(F.max("error").alias("raised"), joined.alias("pages"))
    of_parser = kind.isin(list(parsers))
    found = F.when(F.col("raised").isNull() & (F.col("pages") != ""), F.col("pages"))
    said = F.when(found.isNull(), F.coalesce("raised", F.concat(F.lit("no text in "), kind)))
    merged = read.join(parsed, read["path"] == parsed["its"], "left")
    return merged.select(*named, "sha256", F.when(of_parser, found).otherwise(F.col("text")).alias("text"), F.when(of_parser, said).otherwise(F.col("error")).alias("error")).orderBy("path")


def numbered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The driver's documents as (document_id, title, text, sha256, source_path)."""
    path = F.format_string("%s/%d.txt", F.col("source"), F.col("doc_id"))
    return docs.select(document_id(F.col("doc_id") + 1).alias("document_id"), F.col("source").alias("title"), F.col(text).alias("text"), sha256(F.col(text)).alias("sha256"), path.alias("source_path"))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)
