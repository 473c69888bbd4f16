"""Readers: lines, log files, text datasets, dumps, listings, settings, properties and releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators.config import settings_defaults
from opsframe.plans import schemas
from opsframe.sources import files, publish

# Splits of a file start at least this far apart: the reader's opening cost (4 MiB) and split size must not be set lower
# than 64 KiB. Files may have up to 64 TiB.
SPLIT_STEP = 1 << 16
# Rows of one read task that a sequence number has room for.
SPLIT_ROWS = 1 << 33


def line_seq() -> Column:
    """A number for each line of a file, ascending in file order, without a shuffle.

    The place of the split in the file comes first, then the row's place in its read task.
    """
    split = F.col("_metadata.file_block_start").cast("bigint")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(SPLIT_ROWS - 1))
    return F.call_function("div", split, F.lit(SPLIT_STEP)) * F.lit(SPLIT_ROWS) + row


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Lines of text files: split at newlines only, without trailing CRs; ``file`` and ``seq`` give the place.

    Other columns are the partition columns of the folder.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path if isinstance(path, str) else list(path))
    parts = [name for name in raw.columns if name != "value"]
    return raw.select(
        S.strip_cr(F.col("value"), every=True).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        line_seq().alias("seq"),
        *parts,
    )


# Fixed value: the layout of a stored log line, and how much of it the time takes.
LOG_LINE = r"(?s)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} \S+ \S+ \| .*\z"
STAMP_CHARS = 23


def parse_log_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored log lines (``line``) as columns, and the lines that do not have the layout.

    The layout is looked for once; what has it is cut at its fixed places.
    """
    line = F.col("line")
    rest = [name for name in lines.columns if name != "line"]
    fits = F.coalesce(line.rlike(LOG_LINE), F.lit(False))
    parts = F.split(F.substring(line, F.lit(STAMP_CHARS + 2), F.length(line)), " ", 4)  # level, stream, the bar, text
    stamp = F.to_timestamp_ntz(F.substring(line, 1, STAMP_CHARS), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    parsed = lines.filter(fits).select(*rest, stamp.alias("ts"), parts.alias("_parts"), "line")
    text = F.get("_parts", F.lit(3))
    parsed = parsed.select(
        *rest, "ts", F.get("_parts", F.lit(0)).alias("level"), F.get("_parts", F.lit(1)).alias("stream"), text.alias("text")
    )
    return parsed, lines.filter(~fits)


def read_log_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Log files as columns and rejects. The service is the partition folder, or else the stem of the file."""
    lines = read_lines(spark, path)
    if "service" not in lines.columns:
        lines = lines.withColumn("service", F.regexp_extract("file", r"([^/]+?)(?:\.log)?\z", 1))
    return parse_log_lines(lines.drop("file"))


def read_text_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every file of an input folder, or of its newest published copy, is a record, headers included.

    ``folder_dataset`` (``sources/dataset.py``) chooses one file of a folder instead.
    """
    return read_lines(spark, publish.current(spark, folder)).select(F.col("line").alias("text"))


def concat_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """All files of a pattern as one input."""
    return read_lines(spark, publish.current(spark, folder), glob).select(F.col("line").alias("text"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Lines of collected command outputs with their line numbers.

    One file is one command's output on one host, at most a line per port or process, so it is read whole.
    """
    raw = spark.read.text(path, wholetext=True)
    parts = [name for name in raw.columns if name != "value"]
    numbered = raw.select(
        F.col("_metadata.file_path").alias("file"), *parts, F.posexplode(F.split("value", "\n")).alias("line_no", "line")
    )
    return numbered.filter(F.col("line") != "")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Directory listing documents, one JSON document per line, as entry rows.

    A field that a document lacks is null. A large directory's listing may come in several documents.
    """
    raw = spark.read.text(path)
    parts = [name for name in raw.columns if name != "value"]
    return decode_listings(raw, "value", *parts)


def decode_listings(documents: DataFrame, column: str, *keep: str) -> DataFrame:
    decoded = documents.select(*keep, F.from_json(column, schemas.LISTING).alias("_doc"))
    return decoded.select(*keep, F.inline("_doc.FileStatuses.FileStatus"))


def dir_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files and folders anywhere below a folder, empty ones too, with name, kind, size and time (ms).

    Folders are listed in tasks, depth by depth; no folder, no rows.
    """
    return files.list_tree(spark, path).select("path", "name", "is_dir", "size", "modified_ms")


def read_settings(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Settings documents (or their newest published copy) with defaults filled in.

    ``malformed`` flags a document that cannot be read, which then has the defaults throughout. Documents are
    one per line, or one per file with ``multiline``, where the name of the file is the host unless it says so.
    """
    schema = f"{schemas.SETTINGS}, _raw STRING"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw")
    loaded = reader.option("multiLine", multiline).json(publish.current(spark, path))
    bad = F.col("_raw").isNotNull()
    # A document that breaks off midway counts for nothing, also where its first fields were read.
    values = [
        F.when(~bad, F.col(name)).alias(name) for name in loaded.columns if name not in ("_raw", "host")
    ]
    named = F.nullif(F.regexp_extract("_raw", r'"host"\s*:\s*"([^"]*)"', 1), F.lit(""))
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?\z", 1)
    host = F.coalesce("host", named, stem) if multiline else F.coalesce("host", named)
    return settings_defaults(loaded.select(host.alias("host"), *values, bad.alias("malformed")))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Property files (XML) as rows ``host, name, value, file``.

    The file is the partition folder, or else the file's own name; properties need not name a host.
    """
    schema = "host STRING, name STRING, value STRING"
    rows = spark.read.format("xml").option("rowTag", "property").schema(schema).load(path)
    if "file" not in rows.columns:
        rows = rows.select("*", F.col("_metadata.file_name").alias("file"))
    return rows


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Release documents; system and architecture are in the name ``latest-<os>-<arch>.json``."""
    named = r"latest-(\w+)-(\w+)\.json"
    place = F.col("_metadata.file_path")
    docs = spark.read.schema(schemas.RELEASE).option("recursiveFileLookup", True).json(path)
    return docs.select(
        F.regexp_extract(place, named, 1).alias("os"),
        F.regexp_extract(place, named, 2).alias("arch"),
        "version",
        "sha256",
        "url",
    )
