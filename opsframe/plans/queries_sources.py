"""Queries through files: a view is written to a fresh shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import text
from opsframe.plans.queries_config import SETTINGS, SETTINGS_CHECK, flat_settings
from opsframe.plans.queries_logs import LEVELED, STAMP, leveled
from opsframe.plans.queries_text import COUNTS
from opsframe.plans.registry import query
from opsframe.plans.session import scratch
from opsframe.sources import dataset, files, readers, sinks

LINES = "SELECT unnest(string_split(text, chr(10))) AS text FROM documents"


@query("read_lines", "SELECT service, text AS line FROM log_lines", "log_lines")
def _(v):
    place = scratch(v.spark, "lines")
    raw = v["log_lines"].select("service", F.concat("text", F.lit("\r")).alias("value"))
    raw.write.partitionBy("service").text(place)
    return readers.read_lines(v.spark, place).select("service", "line")


@query(
    "parse_log_file",
    f"SELECT service, date_trunc('millisecond', ts) AS ts, level, stream, text FROM {LEVELED}",
    "log_lines",
)
def _(v):
    place = scratch(v.spark, "logs")
    sinks.write_log_files(leveled(v), place)
    parsed, _ = readers.read_log_files(v.spark, place)
    return parsed.select("service", "ts", "level", "stream", "text")


@query(
    "write_log_file",
    f"SELECT service, {STAMP} || ' ' || level || ' ' || stream || ' | ' || text AS line FROM {LEVELED}",
    "log_lines",
)
def _(v):
    place = scratch(v.spark, "logs")
    lines = leveled(v)
    # Two appends, as of two runs.
    sinks.write_log_files(lines.filter("stream = 'stdout'"), place)
    sinks.write_log_files(lines.filter("stream = 'stderr'"), place)
    return readers.read_lines(v.spark, place).select("service", "line")


@query(
    "log_rejects",
    f"SELECT service, text AS line FROM {LEVELED} WHERE stream = 'stderr'",
    "log_lines",
)
def _(v):
    # Errors come as they are, without the layout of stored lines.
    place = scratch(v.spark, "logs")
    lines = leveled(v)
    sinks.write_log_files(lines.filter("stream = 'stdout'"), place)
    lines.filter("stream = 'stderr'").select("service", F.col("text").alias("value")).write.partitionBy("service").mode("append").text(place)
    return readers.read_log_files(v.spark, place)[1].select("service", "line")


@query("text_dataset_scan", LINES)
def _(v):
    # Folders of 25 documents each, with several candidates: a .csv beside others, or input.txt beside what is none.
    place = scratch(v.spark, "exercises")
    block = F.call_function("div", F.col("doc_id"), F.lit(25))
    named = F.when(block % 2 == 0, F.array(F.lit("Data.CSV"), F.lit("other.csv"), F.lit("input.txt")))
    named = named.otherwise(F.array(F.lit("input.txt"), F.lit("notes.md")))
    lines = v["documents"].select(block.cast("string").alias("block"), "doc_id", "text", F.posexplode(named).alias("k", "name"))
    path = F.concat(F.lit(f"{place}/"), "block", F.lit("/"), "name")
    files.land_files(lines.select(path.alias("path"), F.when(F.col("k") == 0, F.col("text")).alias("text"))).count()
    dataset.register(v.spark)
    return v.spark.read.format("folder_dataset").option("children", True).load(place).select("text")


@query("put_overwrite", LINES)
def _(v):
    place = scratch(v.spark, "dataset")
    for _ in range(2):
        sinks.put_overwrite(v["documents"].select("text"), place)
    return readers.read_text_dataset(v.spark, place)


@query("wordcount_sink", COUNTS)
def _(v):
    place = scratch(v.spark, "counts")
    for _ in range(2):
        sinks.write_word_counts(text.word_count(v["documents"]), place)
    return sinks.parse_word_counts(readers.read_text_dataset(v.spark, place))


@query(
    "output_check",
    f"""SELECT 'counts' AS job, 'ok' AS outcome, CAST(sum(octet_length(encode(word)) + length(CAST(count AS VARCHAR)) + 2) AS BIGINT) AS bytes
FROM ({COUNTS}) UNION ALL SELECT 'nothing', 'empty', 0 UNION ALL SELECT 'none', 'missing', 0""",
)
def _(v):
    # A job with output, one whose parts have no bytes, and one that has not run.
    place = scratch(v.spark, "jobs")
    lines = text.word_count(v["documents"]).select(F.concat_ws("\t", "word", "count").alias("value"))
    lines.write.text(f"{place}/counts")
    lines.filter(F.col("value") == "").write.text(f"{place}/nothing")
    found = files.output_checks(v.spark, [f"{place}/{job}" for job in ("counts", "nothing", "none")])
    return found.select(F.substring_index("path", "/", -1).alias("job"), "outcome", "bytes")


# Listings come in documents of at most 1,000 entries each.
LISTED = """SELECT host, dir, doc_id DIV 1000 AS block, name, type, length, modification_ms,
       CASE WHEN type = 'FILE' THEN host END AS owner FROM {files}"""


@query(
    "listing_json",
    """SELECT host, dir, name AS pathSuffix, type, length, modification_ms AS modificationTime,
       CASE WHEN type = 'FILE' THEN host END AS owner FROM files""",
    "files",
)
def _(v):
    place = scratch(v.spark, "listings")
    entry = F.struct(
        F.col("name").alias("pathSuffix"),
        "type",
        "length",
        F.col("modification_ms").alias("modificationTime"),
        "owner",
    )
    envelope = F.struct(F.struct(F.collect_list(entry).alias("FileStatus")).alias("FileStatuses"))
    documents = v.sql(LISTED).groupBy("host", "dir", "block").agg(F.to_json(envelope).alias("value"))
    documents.select("host", "dir", "value").write.partitionBy("host", "dir").text(place)
    found = readers.read_listings(v.spark, place)
    return found.select("host", "dir", "pathSuffix", "type", "length", "modificationTime", "owner")


# Texts of a source in files of 25 documents, and for each source an empty file and an empty folder.
TREE = """SELECT concat(source, '/', doc_id // 25, '.txt') AS path, false AS is_dir,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size FROM documents GROUP BY ALL
UNION ALL SELECT DISTINCT concat(source, '/empty.txt'), false, 0 FROM documents
UNION ALL SELECT DISTINCT concat(source, '/none'), true, 0 FROM documents
UNION ALL SELECT DISTINCT source, true, 0 FROM documents"""


def landed_tree(v):
    """The folder of that tree."""
    place = scratch(v.spark, "tree")
    block = F.call_function("div", F.col("doc_id"), F.lit(25)).cast("string")
    folder = F.concat(F.lit(f"{place}/"), "source", F.lit("/"))
    texts = v["documents"].select(F.concat(folder, block, F.lit(".txt")).alias("path"), "doc_id", "text")
    sources = v["documents"].select(folder.alias("_folder")).distinct()
    bare = sources.select(F.explode(F.array(F.concat("_folder", F.lit("empty.txt")), F.concat("_folder", F.lit("none/")))).alias("path"))
    nothing = bare.select("path", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    files.land_files(texts.unionByName(nothing), ["doc_id"]).count()
    return place


@query("dir_listing", TREE)
def _(v):
    place = landed_tree(v)
    found = readers.dir_listing(v.spark, place)
    return found.select(F.substring("path", F.lit(len(place) + 2), F.length("path")).alias("path"), "is_dir", "size")


@query(
    "folder_listing",
    f"SELECT split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS name, is_dir, size FROM ({TREE}) WHERE contains(path, '/')",
)
def _(v):
    place = landed_tree(v)
    folders = v["documents"].select(F.concat(F.lit(f"{place}/"), "source").alias("path")).distinct()
    absent = folders.select(F.concat("path", F.lit("/absent")).alias("path"))
    found = files.list_folders(files.spread(folders.unionByName(absent)))
    return found.select(F.substring_index("folder", "/", -1).alias("folder"), "name", "is_dir", "size")


@query(
    "state_json_load",
    """SELECT concat('h', c_custkey) AS host, c_nationkey = 11 AS malformed,
       CASE WHEN c_nationkey <= 11 AND c_nationkey <> 10 THEN 'es' ELSE 'en' END AS language,
       c_acctbal > 0 AND c_nationkey <> 11 AS setup_completed, false AS always_on_top,
       c_nationkey % 2 <> 0 AS auto_start_notebooks,
       CASE WHEN c_nationkey = 3 THEN CAST(c_custkey AS INT) END AS kafka_port,
       CASE WHEN c_nationkey > 12 THEN '2g' ELSE '1g' END AS elasticsearch_heap, '1g' AS hadoop_heap
FROM customer""",
)
def _(v):
    place = scratch(v.spark, "settings")
    documents = v.sql(SETTINGS.replace("FROM {customer}", ", c_nationkey FROM {customer}"))
    document = F.to_json(F.struct(*[c for c in documents.columns if c != "c_nationkey"]))
    broken = F.substring(document, F.lit(1), F.length(document) - 3)
    value = F.when(F.col("c_nationkey") == 11, broken).otherwise(document)
    documents.select(value.alias("value")).write.text(place)
    return flat_settings(readers.read_settings(v.spark, place))


@query("state_json_save", SETTINGS_CHECK)
def _(v):
    place = scratch(v.spark, "settings")
    sinks.write_settings(v.sql(SETTINGS), place)
    return flat_settings(readers.read_settings(v.spark, place).drop("malformed"))


PROPERTIES_CHECK = """SELECT concat('h', c_custkey) AS host,
       CASE WHEN n < 2 THEN 'core-site.xml' ELSE 'hdfs-site.xml' END AS file,
       CASE n WHEN 0 THEN 'fs.defaultFS' WHEN 1 THEN 'hadoop.tmp.dir' WHEN 2 THEN 'dfs.replication'
              ELSE 'dfs.namenode.name.dir' END AS name,
       CASE n WHEN 0 THEN 'hdfs://localhost:9000' WHEN 1 THEN 'file:///srv/h' || c_custkey || '/data/hadoop_tmp'
              WHEN 2 THEN '1' ELSE 'file:///srv/h' || c_custkey || '/data/hdfs/namenode' END AS value
FROM customer, range(4) r(n)"""


def properties(v):
    """Property files written for every host, each with its own address."""
    place = scratch(v.spark, "properties")
    customers = v["customer"].select(F.concat(F.lit("h"), "c_custkey").alias("host")).repartition("host")
    templates = [
        ("core-site.xml", "fs.defaultFS", "hdfs://localhost:9000"),
        ("core-site.xml", "hadoop.tmp.dir", "{{.URI}}/data/hadoop_tmp"),
        ("hdfs-site.xml", "dfs.replication", "1"),
        ("hdfs-site.xml", "dfs.namenode.name.dir", "{{.URI}}/data/hdfs/namenode"),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("file"), F.lit(n).alias("name"), F.lit(t).alias("value"))
            for f, n, t in templates
        ]
    )
    filled = sinks.fill_properties(
        customers.select("host", F.inline(rows)), F.concat(F.lit("file:///srv/"), "host")
    ).select("host", "file", "name", "value")
    sinks.write_properties(filled, place)
    return place


@query("xml_properties_read", PROPERTIES_CHECK)
def _(v):
    return readers.read_properties(v.spark, properties(v)).select("host", "file", "name", "value")


@query(
    "xml_properties_write",
    """SELECT host, file, line FROM (
  SELECT host, file, unnest(['<property>', '<host>' || host || '</host>', '<name>' || name || '</name>',
                             '<value>' || value || '</value>', '</property>']) AS line
  FROM (%s))""" % PROPERTIES_CHECK,
)
def _(v):
    # The text of the files themselves, property by property.
    place = properties(v)
    whole = v.spark.read.option("lineSep", "</property>").text(place).filter(F.contains("value", F.lit("<property>")))
    parts = F.split(F.regexp_extract("value", r"(?s)<property>(.*)\z", 1), "\n")
    lines = F.filter(F.transform(parts, lambda line: F.trim(line)), lambda line: line != "")
    full = F.concat(F.array(F.lit("<property>")), lines, F.array(F.lit("</property>")))
    host = F.regexp_extract("value", "<host>(.*)</host>", 1)
    return whole.select(host.alias("host"), "file", F.explode(full).alias("line"))


@query(
    "file_digests",
    """SELECT CAST(doc_id // 25 AS INT) AS block, sha256(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS digest,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size
FROM documents GROUP BY ALL""",
)
def _(v):
    place = scratch(v.spark, "blocks")
    block = F.call_function("div", F.col("doc_id"), F.lit(25)).alias("block")
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    content = F.array_join(F.transform(listed, lambda row: row["text"]), "\n")
    v["documents"].groupBy(block).agg(content.alias("value")).write.partitionBy("block").text(place)
    parts = files.list_tree(v.spark, place).filter(F.col("name").startswith("part-"))
    return files.file_digests(parts).select(
        F.regexp_extract("path", r"block=(\d+)/", 1).cast("int").alias("block"), "digest", "size"
    )


@query(
    "release_manifest",
    """SELECT os, arch, version, sha256(version) AS sha256, 'https://example.org/' || os AS url FROM releases""",
    "releases",
)
def _(v):
    place = scratch(v.spark, "releases")
    named = F.concat(F.lit("latest-"), "os", F.lit("-"), "arch", F.lit(".json")).alias("name")
    documents = v["releases"].select(
        named,
        "version",
        F.sha2(F.col("version").cast("binary"), 256).alias("sha256"),
        F.concat(F.lit("https://example.org/"), "os").alias("url"),
    )
    documents.write.partitionBy("name").json(place)
    return readers.read_releases(v.spark, place)


@query("concat_files", LINES)
def _(v):
    place = scratch(v.spark, "dataset")
    sinks.put_overwrite(v["documents"].select("text"), place)
    return readers.concat_files(v.spark, place, "part-*.txt")
