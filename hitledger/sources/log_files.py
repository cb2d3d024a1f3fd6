"""Log files and directories as a DataFrame of lines."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how the names of a directory's log files begin.
LOG_FILE_PREFIX = "access.log"
NOTHING_IN_DIRECTORY = "directory {} holds no access.log file of its own"
NOTHING_RESOLVED = "there is no log to read: name a file or a directory"
NOT_UTF8 = "a line is not UTF-8 in file "

# Where a mode is asked for: fail the run, or make such lines rejects and keep their bytes.
INVALID_UTF8_MODES = ("fail", "reject")


def resolve_inputs(spark: SparkSession, inputs: Iterable[str]) -> list[str]:
    """Files named by the inputs, in order. Paths are literal, repeats stay repeats.

    A directory stands for its own files whose names begin with the log prefix, sorted by name;
    one without any is an error even if other inputs resolve. Anything else is a file as it is.
    """
    resolved: list[str] = []
    for path in inputs:
        path = str(path)
        found = _directory_logs(spark, path)
        if found is None:
            resolved.append(path)
        elif not found:
            raise FileNotFoundError(NOTHING_IN_DIRECTORY.format(path))
        else:
            resolved.extend(found)
    if not resolved:
        raise FileNotFoundError(NOTHING_RESOLVED)
    return resolved


def _directory_logs(spark: SparkSession, path: str) -> list[str] | None:
    """Sorted log files directly inside a directory; None if the path is no directory."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.exists(jpath) or not file_system.getFileStatus(jpath).isDirectory():
        return None
    files = (p for p, is_directory in _listing(spark, path) if not is_directory)
    return sorted((p for p in files if _name(p).startswith(LOG_FILE_PREFIX)), key=_name)


def _listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Path and whether it is a directory, of all entries. No path can hold the character between them."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)
    paths = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(entries)
    joined = spark._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(paths).mkString("\0")
    found = joined.split("\0") if len(entries) else []
    return [(name, entry.isDirectory()) for name, entry in zip(found, entries)]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _spark_skips(name: str) -> bool:
    """Whether Spark passes over a file of this name without a word."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def read_lines(
    spark: SparkSession, files: Iterable[str], invalid_utf8: str = "fail"
) -> DataFrame:
    """One row per line in column ``value``, without its line feed and one carriage return.

    Only a line feed ends a line; a last line without one counts, an empty file has none. A line
    that is not UTF-8 ends the run with its file's name. Files can have any name. A folder among them,
    such as one that Spark wrote, stands for the files in it that Spark takes for data. With ``invalid_utf8="reject"`` it becomes
    a null ``value``, which the parser counts as a reject, and column ``undecodable`` keeps its
    bytes. Compressed files are decompressed by their ending, each as one task.
    """
    if invalid_utf8 not in INVALID_UTF8_MODES:
        raise ValueError(f"invalid_utf8 must be one of {', '.join(INVALID_UTF8_MODES)}")
    files = [str(f) for f in files]
    plain, options = _plain_names(spark, files)
    reader = spark.read.options(lineSep="\n", **options)
    folder = None if options else _whole_folder(spark, files)
    if folder is None:
        text = reader.text([_literal_path(plain.get(f, f)) for f in files])
    else:
        text = reader.option("pathGlobFilter", f"{LOG_FILE_PREFIX}*").text(_literal_path(folder))
    if not _all_read(spark, set(files), plain, list(text._jdf.inputFiles())):
        raise ValueError("Spark does not read every one of the log files")
    raw = F.col("value")
    readable = F.is_valid_utf8(raw)
    line = F.when(raw.endswith("\r"), F.regexp_replace(raw, r"\r\z", "")).otherwise(raw)
    if invalid_utf8 == "reject":
        return text.select(
            F.when(readable, line).alias("value"),
            F.when(~readable, raw.cast("binary")).alias("undecodable"),
        )
    name = F.input_file_name()
    if plain:
        known = F.create_map(*[F.lit(x) for file, other in plain.items() for x in (other, file)])
        name = F.coalesce(known[name], name)
    failure = F.raise_error(F.concat(F.lit(NOT_UTF8), name))
    return text.select(F.when(readable, line).otherwise(failure).alias("value"))


def _all_read(spark: SparkSession, files: set[str], plain: dict[str, str], read: list[str]) -> bool:
    """Whether each file is one of those that Spark reads, or a folder with some of them."""
    if sorted(_name(plain.get(f, f)) for f in files) == sorted(unquote(_name(r)) for r in read):
        return True  # one for each; asking the file system about every path would take long
    known = {_plain_uri(r) for r in read}
    for path in list(known):
        while (path := path.rpartition("/")[0]) and path not in known:
            known.add(path)

    def whole(path: str) -> str:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        file_system = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        return file_system.makeQualified(jpath).toUri().toString()

    return all(_plain_uri(plain[f] if f in plain else whole(f)) in known for f in files)


def _plain_uri(uri: str) -> str:
    """Hadoop writes a scheme without a host as file:/x or file:///x."""
    return re.sub(r"\A([A-Za-z][\w+.-]*):///", r"\1:/", uri)


def _plain_names(spark: SparkSession, files: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Other paths for the files whose names Spark would skip, and the reader options that make them.

    A mount table, which holds for this reader alone, links a plain name to each file; endings stay,
    as they tell how a file is compressed. The files are read where they are, and split like others.
    """
    skipped = sorted({f for f in files if _spark_skips(_name(f))})
    if not skipped:
        return {}, {}
    table, plain = f"names{uuid.uuid4().hex}", {}
    options = {"fs.viewfs.impl.disable.cache": "true"}
    for number, file in enumerate(skipped):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(file)
        whole = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath)
        ending = re.search(r"(?<=.)\.[A-Za-z0-9]+\Z", _name(file))
        link = f"/file-{number}{ending[0] if ending else ''}"
        options[f"fs.viewfs.mounttable.{table}.link.{link}"] = whole.toUri().toString()
        plain[file] = f"viewfs://{table}{link}"
    return plain, options


def _whole_folder(spark: SparkSession, files: list[str]) -> str | None:
    """The folder whose log files these are, if they are all of them, each once.

    Spark lists one folder much faster than it looks up many files. It would also descend into
    folders named like partitions, so one with any folder in it is not read as a whole.
    """
    folders = {f.rpartition("/")[0] for f in files}
    if len(files) < 2 or len(folders) > 1 or len(set(files)) < len(files) or "" in folders:
        return None
    if not all(_name(f).startswith(LOG_FILE_PREFIX) for f in files):
        return None
    folder = folders.pop()
    listed = _listing(spark, folder)
    logs = {p for p, _ in listed if _name(p).startswith(LOG_FILE_PREFIX)}
    return folder if logs == set(files) and not any(d for _, d in listed) else None


def _literal_path(path: str) -> str:
    """Spark reads paths as glob patterns; escape what a file name may contain."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path)
