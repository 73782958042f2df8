"""Files as tables: chunk texts, progress and event logs, packs, archives."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "ts string, seq int, run_id string, job_id string, phase string, event_type string, data map<string,string>"


def chunk_files(spark: SparkSession, job_dir: str) -> DataFrame:
    """(idx, src, mt) of ``chunks/chunk_NNN_original.txt`` and ``_translated.txt``; a missing translation is empty."""
    files = spark.read.text(f"{job_dir}/chunks/chunk_*.txt", wholetext=True)
    name = F.col("_metadata.file_name")
    files = files.select(F.regexp_extract(name, r"chunk_(\d+)_", 1).cast("int").alias("idx"), name.contains("_original").alias("o"), "value")
    mt = files.where("not o").select("idx", F.col("value").alias("mt"))
    return files.where("o").select("idx", F.col("value").alias("src")).join(mt, "idx", "left").select("idx", "src", F.coalesce("mt", F.lit("")).alias("mt"))


def judge_pairs(spark: SparkSession, job_dir: str, progress: DataFrame | None = None) -> DataFrame:
    """(idx, src, mt, score_pct): pairs worth judging: both texts there, the source of 20 characters or more.

    Where the chunk files have none, those of the maps input_chunks and translated_chunks
    of ``progress`` (json), one row, by their keys.
    """
    rows = chunk_files(spark, job_dir).select("idx", F.trim("src").alias("src"), F.trim("mt").alias("mt")) if _globbed(spark, f"{job_dir}/chunks/chunk_*_original.txt") else None
    good = lambda df: df.where("src <> '' and mt <> '' and length(src) >= 20").withColumn("score_pct", F.lit(50.0))
    found = good(rows) if rows is not None else None
    if progress is None or (found is not None and not found.isEmpty()):
        return good(chunk_files(spark, job_dir)) if found is None else found
    maps = progress.select(F.from_json("json", "input_chunks map<string,string>, translated_chunks map<string,string>").alias("m"))
    each = maps.select(F.explode("m.input_chunks").alias("key", "src"), F.col("m.translated_chunks").alias("t"))
    return good(each.select(F.col("key").try_cast("int").alias("idx"), F.trim("src").alias("src"), F.trim(F.coalesce(F.try_element_at("t", "key"), F.lit(""))).alias("mt")))


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Events of a JSON-lines file and the number of its lines; blank and malformed lines only count."""
    lines = spark.read.text(path)
    events = lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).where("e.event_type is not null").select("e.*")
    return events, lines.count()


def progress_files(spark: SparkSession, workspace: str) -> DataFrame:
    """All progress.json files under jobs and users, as text with path and time of change."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "progress.json").text(workspace, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"), F.col("value").alias("json")).where(F.col("path").rlike(r"/jobs/[^/]+/progress\.json$"))


def recent_progress(spark: SparkSession, workspace: str, limit: int, owner: str | None = None) -> DataFrame:
    """The ``limit`` latest progress files of PDF jobs; with an ``owner`` of that user's folder and the shared one."""
    found = progress_files(spark, workspace).where(F.col("path").rlike(r"/jobs/pdf_[^/]*/"))
    if owner is not None:
        user = F.regexp_extract("path", r"/users/([^/]+)/jobs/", 1)
        found = found.where((user == owner) | (user == ""))
    return found.orderBy(F.desc("changed"), "path").limit(limit)


def progress_of(spark: SparkSession, workspace: str, job_id: str) -> DataFrame:
    """The progress of one job; only folders of that name are looked into, and an id that is none finds nothing."""
    known = re.fullmatch(r"[A-Za-z0-9._-]{1,128}", job_id) and job_id not in (".", "..")
    places = [p for top in ("jobs", "users/*/jobs") for p in _globbed(spark, f"{workspace}/{top}/{job_id}/progress.json")] if known else []
    if not places:
        return spark.createDataFrame([], "path string, changed timestamp, json string")
    return spark.read.text(places, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"), F.col("value").alias("json"))


def _globbed(spark: SparkSession, pattern: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath().toString() for f in found or ()]


def packs(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary packs: id (the file's stem if none is given), name, terms; files without terms are left out."""
    rows = spark.read.schema("id string, name string, description string, version string, language string, terms map<string,string>").json(f"{folder}/*.json", multiLine=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return rows.select(F.coalesce("id", stem).alias("id"), "name", "terms", F.size("terms").alias("term_count"), stem.alias("stem")).where("terms is not null").orderBy("stem").drop("stem")


def pack(found: DataFrame, pack_id: str) -> DataFrame:
    """The pack of that id; an id that could leave the folder finds none."""
    return found.where((F.col("id") == pack_id) & F.lit(pack_id).rlike(r"^[\w-]+$"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines without comments, each once."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')").distinct()


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def _safe(name: str) -> bool:
    return not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of the files in tar and zip archives; members that would leave the folder are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, data in zip(f["path"], f["content"], strict=True):
                out = []
                if zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        out = [(where, m.filename, z.read(m)) for m in z.infolist() if not m.is_dir() and _safe(m.filename)]
                else:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        out = [(where, m.name, t.extractfile(m).read()) for m in t if m.isfile() and _safe(m.name)]
                yield pd.DataFrame(out, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def main_tex(members: DataFrame) -> DataFrame:
    """Of each archive the first .tex with a document environment, else the first."""
    text = F.decode("content", "ISO-8859-1")
    tex = members.where(F.col("member").endswith(".tex"))
    return tex.groupBy("archive").agg(F.min_by("member", F.struct(~text.contains(r"\begin{document}"), F.col("member"))).alias("main"))


def inputs(members: DataFrame) -> DataFrame:
    """(archive, member, target) of \\input commands that name a member; absolute and upward paths are left out."""
    text = F.decode("content", "ISO-8859-1")
    asked = members.where(F.col("member").endswith(".tex")).select("archive", "member", F.explode(F.regexp_extract_all(text, F.lit(r"\\input\{([^}]+)\}"), F.lit(1))).alias("t"))
    asked = asked.where(~F.col("t").startswith("/") & ~F.col("t").contains("..")).withColumn("target", F.when(F.col("t").endswith(".tex"), F.col("t")).otherwise(F.concat("t", F.lit(".tex"))))
    return asked.join(members.select("archive", F.col("member").alias("target")), ["archive", "target"]).select("archive", "member", "target")


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, block_idx, text) of the paragraphs of DOCX files."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, data in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
                texts = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")]
                out = [(where, i, t) for i, t in enumerate(texts) if t.strip()]
                yield pd.DataFrame(out, columns=["path", "block_idx", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, block_idx int, text string")
