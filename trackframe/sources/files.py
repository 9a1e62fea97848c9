"""Video files and file hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".m4v", ".webm")
PIECE = 1 << 20
DERIVED_STEMS, DERIVED_SUFFIX = ("result_max", "result_stabilized", "analyzed"), "_trackframe"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def looks_derived(path: Column, suffix: str = DERIVED_SUFFIX) -> Column:
    """Whether a file is the output of an earlier run, by its stem."""
    name = F.lower(stem(path))
    return name.endswith(suffix) | name.isin(*DERIVED_STEMS)


def discover_videos(spark: SparkSession, folder: str, recursive: bool = False, include_derived: bool = False) -> DataFrame:
    """path, video (relative to folder), length, in order of the lower-cased path. Contents aren't read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(folder)
    root = fs.getFileStatus(path).getPath().toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    kept = found.filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$"))
    if not include_derived:
        kept = kept.filter(~looks_derived(F.col("path")))
    return kept.select("path", video_identifier(F.col("path"), root).alias("video"), "length").orderBy(F.lower("path"))


def video_identifier(path: Column, root: str) -> Column:
    """The path below root, or the file name where it isn't below."""
    clean = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    top = clean(F.lit(root.rstrip("/") + "/"))
    return F.when(F.startswith(clean(path), top), F.substr(clean(path), F.length(top) + 1)).otherwise(F.element_at(F.split(path, "/"), -1))


def sha256_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and sha256 of whole files, of any size: they are read by pieces, where the files are listed to be."""

    def hashed(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            out = []
            for path in page.path:
                files, name = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                digest = hashlib.sha256()
                with files.open_input_stream(name) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                out.append((path, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "sha256"])

    listed = spark.read.format("binaryFile").load(folder).select("path")
    return listed.mapInPandas(hashed, "path string, sha256 string")


def sha256_matches(actual: Column, expected: Column) -> Column:
    """Whether a hash is the expected one, case and a leading "sha256:" aside."""
    return F.lower(actual) == F.lower(F.regexp_replace(F.btrim(expected), "^(?i)sha256:", ""))
