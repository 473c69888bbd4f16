"""Queries on file catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators import catalog, config
from opsframe.operators.status import latest_status
from opsframe.plans.registry import query

NAMES = ("VERSION", "core-site.xml", "mapper.py", "meta.properties", "pom.xml", "reducer.py")
PLACE = ["host", "dir"]


def size_sql(column: str) -> str:
    def unit(power: int, name: str) -> str:
        return f"printf('%.1f', floor({column} / {float(1024 ** power)} * 10 + 0.5) / 10) || ' {name}'"

    return f"""CASE WHEN coalesce({column}, 0) = 0 THEN '0' WHEN {column} < 1024 THEN {column} || ' B'
     WHEN {column} < 1048576 THEN {unit(1, 'KB')} WHEN {column} < 1073741824 THEN {unit(2, 'MB')}
     WHEN {column} < 1099511627776 THEN {unit(3, 'GB')} ELSE {unit(4, 'TB')} END"""


# The documents' folders as exercise folders.
FOLDERS = "SELECT *, concat('Ejercicio_', upper(dir)) AS folder FROM {files}"


@query("visible_files", "SELECT doc_id, name FROM files WHERE NOT starts_with(name, '.')", "files")
def _(v):
    return catalog.visible_files(v["files"]).select("doc_id", "name")


@query(
    "name_match",
    """SELECT doc_id, name FROM files
WHERE starts_with(name, 'part') AND lower(name) LIKE '%.csv' AND name <> 'part 7.csv'""",
    "files",
)
def _(v):
    return catalog.name_match(v["files"], "part", ".CSV", "part 7.csv").select("doc_id", "name")


@query(
    "file_display",
    f"""SELECT doc_id, name, CASE WHEN type = 'DIRECTORY' THEN '—' ELSE {size_sql('length')} END AS size,
       strftime(make_timestamp(modification_ms * 1000), '%Y-%m-%d %H:%M:%S') AS modified FROM files""",
    "files",
)
def _(v):
    shown = catalog.file_display(v["files"])
    return shown.select("doc_id", "name", "size", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query(
    "missing_required",
    f"""SELECT u.host, u.dir, count(n.name) FILTER (WHERE f.name IS NULL) = 0 AS ok,
       coalesce(string_agg(n.name, ',' ORDER BY n.name) FILTER (WHERE f.name IS NULL), '') AS missing
FROM (SELECT DISTINCT host, dir FROM files) u CROSS JOIN (SELECT unnest({list(NAMES)}) AS name) n
LEFT JOIN (SELECT DISTINCT host, dir, name FROM files) f ON f.host = u.host AND f.dir = u.dir AND f.name = n.name
GROUP BY u.host, u.dir""",
    "files",
)
def _(v):
    found = catalog.missing_required(v["files"], v["files"], NAMES, PLACE)
    return found.withColumn("missing", F.array_join("missing", ","))


EXERCISES = """SELECT concat('ej', doc_id) AS id,
       array(concat('h', doc_id % 150), concat('h', (doc_id * 7) % 200)) AS requires FROM {documents}"""


@query(
    "missing_prereqs",
    """WITH need AS (SELECT concat('ej', doc_id) AS exercise,
              unnest([concat('h', doc_id % 150), concat('h', (doc_id * 7) % 200)]) AS missing FROM documents)
SELECT exercise, missing FROM need WHERE missing NOT IN (
  SELECT concat('h', user_id) FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error')""",
)
def _(v):
    return catalog.missing_prereqs(v.sql(EXERCISES), latest_status(v["status"]))


@query(
    "namenode_state",
    """SELECT u.host, u.dir, CASE WHEN count(f.name) = 0 THEN 'empty'
       WHEN bool_or(f.name = 'VERSION') THEN 'formatted' ELSE 'corrupted' END AS state
FROM (SELECT DISTINCT host, dir FROM files UNION ALL SELECT 'src99', 'en') u
LEFT JOIN files f ON f.host = u.host AND f.dir = u.dir GROUP BY u.host, u.dir""",
    "files",
)
def _(v):
    units = v.sql("SELECT host, dir FROM {files} UNION SELECT 'src99', 'en'")
    return catalog.namenode_state(units, v["files"])


@query(
    "setup_readiness",
    """SELECT host, dir, hadoop_config, namenode, kafka,
       concat_ws(',', CASE WHEN NOT hadoop_config THEN 'hadoop_config' END, CASE WHEN NOT kafka THEN 'kafka' END,
                 CASE WHEN NOT namenode THEN 'namenode' END) AS missing,
       NOT (hadoop_config AND namenode AND kafka) AS setup_needed
FROM (SELECT u.host, u.dir, coalesce(bool_or(name = 'core-site.xml' AND type = 'FILE'), false) AS hadoop_config,
             coalesce(bool_or(name = 'VERSION' AND type = 'FILE'), false) AS namenode,
             coalesce(bool_or(name = 'meta.properties' AND type = 'FILE'), false) AS kafka
      FROM (SELECT host, dir FROM files UNION SELECT host, 'new' FROM files) u
      LEFT JOIN files f ON f.host = u.host AND f.dir = u.dir GROUP BY u.host, u.dir)""",
    "files",
)
def _(v):
    # Every host has a folder that nothing has been written to yet.
    units = v["files"].select(*PLACE).unionByName(v["files"].select("host", F.lit("new").alias("dir")))
    markers = {"hadoop_config": "core-site.xml", "namenode": "VERSION", "kafka": "meta.properties"}
    ready = catalog.setup_readiness(units, v["files"], markers, PLACE)
    return ready.withColumn("missing", F.array_join("missing", ","))


@query(
    "exercise_catalog",
    """SELECT host, concat('ej', lower(dir)) AS id, concat('Ejercicio_', upper(dir)) AS title,
       CASE WHEN coalesce(bool_or(name = 'mapper.py') FILTER (WHERE type = 'FILE'), false)
             AND coalesce(bool_or(name = 'reducer.py') FILTER (WHERE type = 'FILE'), false)
            THEN 'wordcount' ELSE 'raw' END AS template,
       count(*) FILTER (WHERE type = 'FILE') AS n_files
FROM files GROUP BY host, dir""",
    "files",
)
def _(v):
    files = v.sql(FOLDERS)
    return catalog.exercise_catalog(files, files)


@query(
    "exercise_files",
    "SELECT host, concat('ej', lower(dir)) AS id, name FROM files WHERE type = 'FILE'",
    "files",
)
def _(v):
    return catalog.exercise_files(v.sql(FOLDERS))


@query(
    "dir_match_count",
    r"""SELECT host, count(DISTINCT nullif(regexp_extract(CASE WHEN type = 'DIRECTORY' THEN path || '/' ELSE path END,
       '^(.*?/__pycache__)/', 1), '')) AS matches FROM files GROUP BY host""",
    "files",
)
def _(v):
    return catalog.dir_match_count(v["files"])


@query(
    "dir_rollup",
    """SELECT CASE WHEN prefix = '' THEN '/' ELSE prefix END AS dir, CAST(sum(length) AS BIGINT) AS bytes,
       count(*) AS files
FROM (SELECT length, array_to_string(parts[1:n], '/') AS prefix
      FROM (SELECT length, string_split(path, '/') AS parts,
                   unnest(range(1, len(string_split(path, '/')))) AS n FROM files WHERE type = 'FILE'))
GROUP BY prefix""",
    "files",
)
def _(v):
    return catalog.dir_rollup(v["files"])


@query("dir_first_sort", "SELECT type, name, path FROM files", "files")
def _(v):
    return catalog.dir_first_sort(v["files"], None).select("type", "name", "path")


@query(
    "first_by_name",
    """SELECT host, dir, coalesce(min(name) FILTER (WHERE type = 'FILE' AND lower(name) LIKE '%.csv'), 'input.txt') AS name
FROM files GROUP BY host, dir""",
    "files",
)
def _(v):
    return catalog.first_by_name(v["files"], catalog.is_csv(F.col("name")), by=PLACE)


@query("human_size", f"SELECT doc_id, {size_sql('length * length * 7')} AS size FROM files", "files")
def _(v):
    size = F.col("length") * F.col("length") * 7
    return v["files"].select("doc_id", S.human_size(size).alias("size"))


@query("path_join", "SELECT doc_id, '/' || host || '/' || name AS path, '/' || name AS top FROM files", "files")
def _(v):
    parent = S.normalise_path(F.concat("host", F.lit("/")))
    return v["files"].select(
        "doc_id",
        S.path_join(parent, F.col("name")).alias("path"),
        S.path_join(F.lit("/"), F.col("name")).alias("top"),
    )


@query(
    "escape_path",
    """SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(url_encode(p), '%2F', '/'), '%24', '$'),
       '%26', '&'), '%2B', '+'), '%3A', ':'), '%3D', '='), '%40', '@') AS path
FROM (SELECT doc_id, concat(path, '/ñ+~*;,(x)&$:=@') AS p FROM files)""",
    "files",
)
def _(v):
    return v["files"].select("doc_id", S.escape_path(F.concat("path", F.lit("/ñ+~*;,(x)&$:=@"))).alias("path"))


@query(
    "file_uri",
    """SELECT doc_id, 'file://' || path AS uri, 'file:///D:' || path AS drive_uri FROM files""",
    "files",
)
def _(v):
    drive = F.concat(F.lit("D:"), F.replace("path", F.lit("/"), F.lit("\\")))
    return v["files"].select(
        "doc_id", S.file_uri(F.col("path")).alias("uri"), S.file_uri(drive).alias("drive_uri")
    )


@query(
    "millis_to_ts",
    "SELECT doc_id, make_timestamp(modification_ms * 1000) AS modified FROM files",
    "files",
)
def _(v):
    ts = S.millis_to_ts(F.col("modification_ms")).cast("timestamp_ntz")
    return v["files"].select("doc_id", ts.alias("modified"))


@query(
    "exercise_id",
    """SELECT doc_id, CASE WHEN doc_id % 9 = 3 THEN NULL ELSE concat('ej', lower(host)) END AS id FROM files""",
    "files",
)
def _(v):
    hidden = F.col("name").startswith(".")
    name = F.concat(F.lit("Ejercicio_"), F.when(hidden, "").otherwise(F.upper("host")))
    return v["files"].select("doc_id", S.exercise_id(name, "Ejercicio_").alias("id"))


@query("sha256_hex", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(v):
    return v["documents"].select("doc_id", S.sha256_hex(F.col("text").cast("binary")).alias("digest"))


EXPECTED = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN upper(sha2(text, 256)) ELSE 'bad' END AS sha256
FROM {documents}"""


@query(
    "checksum_audit",
    """SELECT doc_id, sha256(text) AS digest,
       CASE doc_id % 3 WHEN 0 THEN 'unchecked' WHEN 1 THEN 'ok' ELSE 'mismatch' END AS verdict FROM documents""",
)
def _(v):
    digests = v["documents"].select("doc_id", S.sha256_hex(F.col("text").cast("binary")).alias("digest"))
    return config.checksum_audit(digests, v.sql(EXPECTED), ["doc_id"]).select("doc_id", "digest", "verdict")


HOSTS = """SELECT doc_id AS host, source AS os, lang AS arch, concat('0.2.', doc_id DIV 20 % 10) AS current FROM {documents}"""


@query(
    "release_lookup",
    """SELECT doc_id AS host, os, arch, concat('0.2.', doc_id // 20 % 10) AS current, version
FROM documents JOIN releases ON os = source AND arch = lang""",
    "releases",
)
def _(v):
    return config.release_lookup(v.sql(HOSTS), v["releases"])


@query(
    "release_drift",
    """SELECT doc_id AS host, os, arch, concat('0.2.', doc_id // 20 % 10) AS current, version AS latest
FROM documents JOIN releases ON os = source AND arch = lang
WHERE version <> '' AND version <> concat('0.2.', doc_id // 20 % 10)""",
    "releases",
)
def _(v):
    return config.release_drift(v.sql(HOSTS), v["releases"])


@query(
    "rewrite_url_path",
    r"""SELECT page_id, regexp_replace(url, '^([^:/?#]+://[^/?#]*)[^?#]*(.*)$',
       concat('\1/lab/tree/p', page_id, '\2')) AS url FROM pages""",
)
def _(v):
    path = F.concat(F.lit("/lab/tree/p"), "page_id")
    return v["pages"].select("page_id", S.rewrite_url_path(F.col("url"), path).alias("url"))
