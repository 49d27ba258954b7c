"""Readers: paper directories, JSON lines, nested JSON corpora."""

from __future__ import annotations

import os
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .staging import staged

TEXT, PDF = [".md", ".txt"], [".pdf"]
#: Columns that tell where a line of JSON stands.
PLACE = ["_file", "_part", "_line"]


def _stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def fewer_tasks(files: DataFrame) -> DataFrame:
    """Small files read by as many tasks as a shuffle has, not by one for every few files."""
    return files.coalesce(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def paper_files(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """(doc_idx, paper_id, suffix, path, content) of the folder's own files with a supported
    suffix in any case, numbered by path. Decoding is left to the caller."""
    suffixes = suffixes or [*TEXT, *PDF]
    files = spark.read.format("binaryFile").load(folder.rstrip("/") + "/*").select("path", "content")
    files = fewer_tasks(files).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))).where(F.col("suffix").isin(suffixes))
    return files.join(_numbered_paths(files.select("path")), "path").select("doc_idx", _stem(F.col("path")).alias("paper_id"), "suffix", "path", "content")


def _numbered_paths(paths: DataFrame) -> DataFrame:
    """(path, doc_idx): places in the order of paths, from 1. Paths are sorted in ranges, and
    each range is numbered on from the counts of those before it: one row for each range."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(paths.repartitionByRange(n, "path").withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
    own = ranges.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy("path")))
    return own.join(F.broadcast(shifts), "_range").select("path", (F.col("_before") + F.col("_own")).cast("long").alias("doc_idx"))


def check_suffix(path: str) -> None:
    """Raise for a document whose suffix is none that is read."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in (*TEXT, *PDF):
        raise ValueError(f"no supported document format: {suffix or path}")


def split_file(spark: SparkSession, folder: str, name: str) -> str:
    """The path of the file of that name in the folder or anywhere below it: the first in
    order, should there be several; an error if there is none."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    found = []
    while files.hasNext():
        p = files.next().getPath()
        if p.getName() == name:
            found.append(p.toString())
    if not found:
        raise FileNotFoundError(f"no {name} in or below {folder}")
    return min(found, key=lambda x: (x.count("/"), x))


def unpack(archive: str, folder: str) -> None:
    """Unpack a tar or zip archive; members that would leave the folder, links and devices
    are refused before anything is written."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    root = target.resolve()

    def inside(name: str) -> None:
        if not (root / name).resolve().is_relative_to(root):
            raise ValueError(f"unsafe path in archive: {name}")

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for name in z.namelist():
                inside(name)
            z.extractall(root)
        return
    with tarfile.open(archive) as t:
        for m in t.getmembers():
            inside(m.name)
            if not (m.isfile() or m.isdir()):
                raise ValueError(f"unsafe member of archive: {m.name}")
        t.extractall(root, filter="data")


def document_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_idx, paper_id, suffix, path, content) of one document; an error for any other format."""
    check_suffix(path)
    file = spark.read.format("binaryFile").load(path)
    return file.select(F.lit(1).cast("long").alias("doc_idx"), _stem(F.col("path")).alias("paper_id"), F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).alias("suffix"), "path", "content")


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_idx, paper_id, text) of the .md and .txt files."""
    return paper_files(spark, folder, TEXT).select("doc_idx", "paper_id", F.decode("content", "UTF-8").alias("text"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """(doc_idx, paper_id, page, text, meta_title) of the non-blank pages of PDF files;
    pages count from 1. Needs the optional package pypdf on the executors."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pypdf") from e
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                doc = PdfReader(io.BytesIO(r.content))
                title = (doc.metadata and doc.metadata.title or "").strip()
                texts = ((n, p.extract_text() or "") for n, p in enumerate(doc.pages, 1))
                rows += [(r.doc_idx, r.paper_id, n, t, title) for n, t in texts if t.strip()]
            yield pd.DataFrame(rows, columns=["doc_idx", "paper_id", "page", "text", "meta_title"])

    return files.where(F.col("suffix").isin(PDF)).select("doc_idx", "paper_id", "content").mapInPandas(pages, "doc_idx long, paper_id string, page int, text string, meta_title string")


def documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Text documents and PDF pages of a folder, numbered together."""
    files = paper_files(spark, folder)
    return files.where(F.col("suffix").isin(TEXT)).select("doc_idx", "paper_id", F.decode("content", "UTF-8").alias("text")), pdf_pages(files)


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines, read line by line in parts of a file, with ``_file``, ``_part`` (where
    the part of the file begins) and ``_line`` (a number that grows within the part); blank
    lines are skipped. A line that is no JSON raises, naming the file, the part and the
    beginning of the line; one that is no object raises only if strict, else it is
    skipped. ``limit``: the first lines alone, which are brought to the driver; no more
    parts are read than hold them."""
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_line"), F.col("value").alias("line"))
    rows = raw.where(strip(F.col("line")) != "")
    if limit is not None:
        rows = spark.createDataFrame(rows.take(limit), rows.schema)
    v = F.try_parse_json("line")
    where = F.concat(F.lit("in "), "_file", F.lit(", part from byte "), F.col("_part").cast("string"), F.lit(": "), F.substring("line", 1, 80))
    kind = F.when(v.isNull(), F.raise_error(F.concat(F.lit("no JSON "), where))).otherwise(F.schema_of_variant(v))
    is_object = kind.startswith("OBJECT")
    if strict:
        is_object = F.when(is_object, True).otherwise(F.raise_error(F.concat(F.lit("no JSON object "), where)).cast("boolean"))
    return rows.where(is_object).select("_file", "_part", "_line", F.from_json("line", schema).alias("r")).select("_file", "_part", "_line", "r.*")


def last_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with an equal key the last by file and place in it."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_file", "_part", "_line")).alias("r")).select("r.*")


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(pos, key, value) of files that hold one object, in the file's order."""
    raw = fewer_tasks(spark.read.text(path, wholetext=True))
    return raw.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{value}>"))).alias("pos", "e")).select("pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def by_split(readers: dict[str, DataFrame]) -> DataFrame:
    """The union of one DataFrame for each split, with the split's name."""
    out = None
    for split, df in readers.items():
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
