"""File catalogues: listings, directory classing, completeness and roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.functions import scalars as S

# Required folders, marker files, the template's files and the folder of compiled files.
REQUIRED_FOLDERS = ("common_jdk", "hadoop", "kafka_kraft", "elasticsearch", "python")
STORAGE_MARKER = "VERSION"
MARKERS = {
    "hadoop_config": "etc/hadoop/core-site.xml",
    "namenode": "hdfs/namenode/current/VERSION",
    "kafka": "data/data_kraft/meta.properties",
}
TEMPLATE_FILES = ("mapper.py", "reducer.py")
EXERCISE_PREFIX = "Ejercicio_"
DEFAULT_DATASET = "input.txt"
CACHE_FOLDER = "__pycache__"
NO_SIZE = "—"


def visible_files(files: DataFrame, name: str = "name") -> DataFrame:
    return files.filter(~F.col(name).startswith("."))


def name_match(
    files: DataFrame, prefix: str = "", suffix: str = "", but_not: str | None = None, glob: str | None = None
) -> DataFrame:
    """Names with a prefix, a suffix (in any case), other than one name, or matching a regular expression."""
    name = F.col("name")
    if prefix:
        files = files.filter(name.startswith(prefix))
    if suffix:
        files = files.filter(F.lower(name).endswith(suffix.lower()))
    if but_not is not None:
        files = files.filter(name != but_not)
    if glob is not None:
        files = files.filter(name.rlike(glob))
    return files


def file_display(files: DataFrame) -> DataFrame:
    """Size and time for people; a directory has no size."""
    size = F.when(F.col("type") == "DIRECTORY", NO_SIZE).otherwise(S.human_size(F.col("length")))
    return files.withColumn("size", size).withColumn("modified", S.millis_to_ts(F.col("modification_ms")))


def missing_required(
    units: DataFrame, present: DataFrame, required: Sequence[str] = REQUIRED_FOLDERS, by: Sequence[str] = ("host",)
) -> DataFrame:
    """Required names that a unit (host or folder) lacks, sorted; ``ok`` iff there is none.

    Presence is one flag per required name and unit, so only flags are shuffled, never name lists.
    """
    names = sorted(required)
    flags = [F.max(F.col("name") == name).alias(f"_has{n}") for n, name in enumerate(names)]
    seen = present.filter(F.col("name").isin(names)).groupBy(*by).agg(*flags)
    joined = units.select(*by).distinct().join(seen, list(by), "left")
    gaps = [F.when(~F.coalesce(F.col(f"_has{n}"), F.lit(False)), name) for n, name in enumerate(names)]
    missing = F.array_compact(F.array(*gaps))
    return joined.select(*by, (F.size(missing) == 0).alias("ok"), missing.alias("missing"))


def missing_prereqs(exercises: DataFrame, services: DataFrame) -> DataFrame:
    """Required services of each exercise that do not run; an unknown service counts as missing.

    ``exercises`` has ``id`` and ``requires`` (an array); ``services`` has one row per id.
    """
    needed = exercises.select(F.col("id").alias("exercise"), F.explode("requires").alias("id"))
    up = services.filter(F.col("running")).select("id")
    return needed.join(up, "id", "left_anti").select("exercise", F.col("id").alias("missing"))


def namenode_state(units: DataFrame, files: DataFrame, by: Sequence[str] = ("host", "dir")) -> DataFrame:
    """``empty`` without entries, ``formatted`` with the marker file, else ``corrupted``."""
    seen = files.groupBy(*by).agg(
        F.max(F.col("name") == STORAGE_MARKER).alias("_marker"), F.count("name").alias("_entries")
    )
    state = (
        F.when(F.coalesce(F.col("_entries"), F.lit(0)) == 0, "empty")
        .when(F.col("_marker"), "formatted")
        .otherwise("corrupted")
    )
    return units.select(*by).distinct().join(seen, list(by), "left").select(*by, state.alias("state"))


def setup_readiness(
    units: DataFrame, files: DataFrame, markers: Mapping[str, str] = MARKERS, by: Sequence[str] = ("host",), column: str = "path"
) -> DataFrame:
    """One flag per marker file, the missing ones, and whether setup is still needed, for every unit.

    A marker is the end of a path (``MARKERS``). A unit without files needs setup.
    """
    here = F.concat(F.lit("/"), F.col(column))
    flags = [F.max(here.endswith(f"/{path}") & (F.col("type") == "FILE")).alias(flag) for flag, path in markers.items()]
    seen = units.select(*by).distinct().join(files.groupBy(*by).agg(*flags), list(by), "left")
    ready = seen.select(*by, *[F.coalesce(flag, F.lit(False)).alias(flag) for flag in markers])
    missing = F.array_compact(F.array(*[F.when(~F.col(flag), flag) for flag in sorted(markers)]))
    return ready.withColumn("missing", missing).withColumn("setup_needed", F.size("missing") > 0)


def exercise_catalog(
    folders: DataFrame, files: DataFrame, prefix: str = EXERCISE_PREFIX, by: Sequence[str] = ("host",)
) -> DataFrame:
    """One row per exercise folder (``folder``): id, title, template and number of files.

    The template is ``wordcount`` iff both template files are there, else ``raw``. Directories inside are
    skipped, folders without files are kept, folders with a blank id are not. A folder may hold any number of
    files, so its sorted file list is a table of its own, ``exercise_files``.
    """
    keys = [*by, "folder"]
    named = folders.filter(F.col("folder").startswith(prefix)).select(*keys).distinct()
    named = named.withColumn("id", S.exercise_id(F.col("folder"), prefix)).filter(F.col("id").isNotNull())
    has = [F.max(F.col("name") == name).alias(f"_has{n}") for n, name in enumerate(TEMPLATE_FILES)]
    inside = _exercise_rows(files, prefix).groupBy(*keys).agg(F.count("*").alias("_files"), *has)
    both = F.col("_has0") & F.col("_has1")
    joined = named.join(inside, keys, "left")
    return joined.select(
        *by,
        "id",
        F.col("folder").alias("title"),
        F.when(F.coalesce(both, F.lit(False)), "wordcount").otherwise("raw").alias("template"),
        F.coalesce("_files", F.lit(0)).alias("n_files"),
    )


def exercise_files(files: DataFrame, prefix: str = EXERCISE_PREFIX, by: Sequence[str] = ("host",)) -> DataFrame:
    """Files of each exercise, sorted by id and name."""
    rows = _exercise_rows(files, prefix).withColumn("id", S.exercise_id(F.col("folder"), prefix))
    order = [F.asc(column) for column in [*by, "id", "name"]]
    return _sorted(rows.filter(F.col("id").isNotNull()), *order).select(*by, "id", "name")


def _exercise_rows(files: DataFrame, prefix: str) -> DataFrame:
    return files.filter(F.col("folder").startswith(prefix) & (F.col("type") == "FILE"))


def dir_match_count(paths: DataFrame, folder: str = CACHE_FOLDER, by: Sequence[str] = ("host",)) -> DataFrame:
    """Folders of a name anywhere in the tree, 0 where there is none; a match inside another match does not count.

    A path shows the folders above its own entry; a file of that name is no match.
    """
    place = F.when(F.col("type") == "DIRECTORY", F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    topmost = F.nullif(F.regexp_extract(place, f"^(.*?/{folder})/", 1), F.lit(""))
    return paths.groupBy(*by).agg(F.countDistinct(topmost).alias("matches"))


def dir_rollup(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Bytes and files below every directory, the root included.

    Each file is counted at its ancestors; the counts are partly summed before the shuffle, so the root is not
    a hot key.
    """
    parts = F.split(F.col(path), "/")
    depth = F.size(parts) - 2
    ancestor = F.explode(
        F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(parts, 1, n + 1), "/"))
    )
    inside = files.filter(F.col("type") == "FILE")
    rows = inside.select(ancestor.alias("_prefix"), F.col(length).alias("_length"))
    prefix = F.when(F.col("_prefix") == "", "/").otherwise(F.col("_prefix"))
    return rows.groupBy(prefix.alias("dir")).agg(
        F.sum("_length").cast("bigint").alias("bytes"), F.count("*").alias("files")
    )


def _sorted(df: DataFrame, *first: Column) -> DataFrame:
    """Global sort with all other sortable columns as tie-breakers.

    Ranges are cut between different sort keys, so many rows with one name would otherwise be one task.
    """
    rest = [field.name for field in df.schema.fields if isinstance(field.dataType, T.AtomicType)]
    return df.orderBy(*first, *rest)


def dir_first_sort(entries: DataFrame, locale: str | None = "UNICODE") -> DataFrame:
    """Directories first, then by name in a collation; ``locale=None`` sorts by bytes."""
    name = F.col("name") if locale is None else F.collate("name", locale)
    return _sorted(entries, (F.col("type") == "DIRECTORY").desc(), name.asc(), F.col("name").asc())


def sort_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    return _sorted(df, F.asc(key))


def registration_order(df: DataFrame, ordinal: str = "ordinal", reverse: bool = False) -> DataFrame:
    """Rows in the order they were registered in, or the reverse."""
    return _sorted(df, F.desc(ordinal) if reverse else F.asc(ordinal))


def first_by_name(
    files: DataFrame, matches: Column, default: str | None = DEFAULT_DATASET, by: Sequence[str] = ("host",)
) -> DataFrame:
    """First matching file of each folder in byte order, else a default.

    Directories do not match; listings without a ``type`` have files only.
    """
    if "type" in files.columns:
        matches = matches & (F.col("type") == "FILE")
    first = F.min(F.when(matches, F.col("name")))
    return files.groupBy(*by).agg(F.coalesce(first, F.lit(default)).alias("name"))


def is_csv(name: Column) -> Column:
    return F.lower(name).endswith(".csv")
