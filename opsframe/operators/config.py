"""Settings: defaults and overrides, overlays, change logs, drift, releases and line rewrites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators.ordered import latest_by

# Default settings, and the active settings line that gets a value without blanks.
DEFAULT_LANGUAGE = "es"
LANGUAGES = ("es", "en")
DEFAULT_HEAP = {"elasticsearch": "1g", "hadoop": "1g"}
IDENT_LINE = r"(?i)^[ \t]*set HADOOP_IDENT_STRING=[^\r\n]*"
IDENT_PREFIX = "set HADOOP_IDENT_STRING="


def domain_clamp(value: Column, allowed: Sequence[str] = LANGUAGES, default: str = DEFAULT_LANGUAGE) -> Column:
    """A value outside the allowed ones becomes the default."""
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(default))


def port_overrides(services: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective port: the override if there is a positive one, else the default."""
    own = overrides.select("id", F.col("port").alias("_port"))
    port = F.when(F.col("_port") > 0, F.col("_port")).otherwise(F.col("port"))
    joined = services.join(own, "id", "left")
    return joined.select(*[c for c in services.columns if c != "port"], port.alias("port"))


def heap_overrides(services: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective heap: the override if it is not blank, else the service's own default."""
    own = overrides.select("id", F.col("heap").alias("_heap"))
    heap = F.coalesce(F.nullif("_heap", F.lit("")), F.col("heap"))
    joined = services.join(own, "id", "left")
    return joined.select(*[c for c in services.columns if c != "heap"], heap.alias("heap"))


def orphan_overrides(services: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides of ids that no service has: stored, but never read."""
    return overrides.join(services.select("id"), "id", "left_anti")


def kv_overlay(base: DataFrame, overrides: DataFrame, by: Sequence[str] = ("owner",)) -> DataFrame:
    """Base entries ``k=v`` with overrides put in place, then the overrides of new keys.

    ``base`` has ``pos, entry``, ``overrides`` has ``key, value`` (unique per key). Every duplicate of a key is
    replaced, entries without ``=`` pass through. Order: ``section`` (base, new), then ``pos``, then ``key``.
    A left join and an anti join instead of a full outer one, so that AQE can split a frequent key.
    """
    keyed = base.withColumn("key", S.kv_key(F.col("entry")))
    value = overrides.select(*by, "key", F.col("value").alias("_value"))
    entry = F.when(F.col("_value").isNotNull(), F.concat_ws("=", "key", "_value")).otherwise(F.col("entry"))
    on = [*by, "key"]
    # Keys that are null match nothing, and stay.
    replaced = keyed.join(value, on, "left").select(
        *by, F.lit(0).alias("section"), F.col("pos").cast("bigint").alias("pos"), "key", entry.alias("entry")
    )
    known = keyed.filter(F.col("key").isNotNull()).select(*on).distinct()
    new = overrides.join(known, on, "left_anti").select(
        *by,
        F.lit(1).alias("section"),
        F.lit(None).cast("bigint").alias("pos"),
        "key",
        F.concat_ws("=", "key", "value").alias("entry"),
    )
    return replaced.unionByName(new)


def checksum_audit(digests: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """``unchecked`` without an expected digest, else ``ok`` or ``mismatch``, in any letter case."""
    joined = digests.join(expected.select(*on, "sha256"), list(on), "left")
    blank = F.coalesce(F.col("sha256"), F.lit("")) == ""
    same = F.lower("digest") == F.lower("sha256")
    return joined.withColumn("verdict", F.when(blank, "unchecked").when(same, "ok").otherwise("mismatch"))


def release_lookup(hosts: DataFrame, manifest: DataFrame) -> DataFrame:
    """The release of each host's system and architecture.

    There are few platforms and one may have most of the hosts; AQE broadcasts a small manifest or splits the hosts.
    """
    return hosts.join(manifest, ["os", "arch"])


def release_drift(hosts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Hosts with another release than the published one; a blank version publishes nothing."""
    found = release_lookup(hosts, manifest.withColumnRenamed("version", "latest"))
    return found.filter((F.col("latest") != "") & (F.col("latest") != F.col("current")))


def config_drift(
    expected: DataFrame, actual: DataFrame, stale: str | None = None, on: Sequence[str] = ("file", "name")
) -> DataFrame:
    """Properties that are missing, extra or changed; ``stale`` flags actual values that hold a stale token."""
    left = expected.select(*on, F.col("value").alias("expected"), F.lit(True).alias("_left"))
    right = actual.select(*on, F.col("value").alias("actual"), F.lit(True).alias("_right"))
    state = (
        F.when(F.col("_right").isNull(), "missing")
        .when(F.col("_left").isNull(), "extra")
        .when(~F.col("expected").eqNullSafe(F.col("actual")), "changed")
    )
    flagged = F.lit(False) if stale is None else F.coalesce(F.contains("actual", F.lit(stale)), F.lit(False))
    joined = left.join(right, list(on), "full_outer")
    rows = joined.select(*on, "expected", "actual", state.alias("drift"), flagged.alias("stale"))
    return rows.filter(F.col("drift").isNotNull() | F.col("stale"))


def line_rewrite(
    lines: DataFrame, value: str, pattern: str = IDENT_LINE, prefix: str = IDENT_PREFIX, key: str = "file"
) -> DataFrame:
    """Give the active lines that match a pattern a new value; ``changed`` tells which ones.

    Comment lines do not match and stay, and so does a trailing CR. A file that already holds the new text is
    left alone, so a second pass changes nothing.
    """
    new = prefix + value
    found = lines.filter(F.contains("line", F.lit(new))).select(key).distinct()
    done = found.withColumn("_done", F.lit(True))
    quoted = new.replace("\\", "\\\\").replace("$", "\\$")
    rewritten = F.when(F.col("_done").isNull(), F.regexp_replace("line", pattern, quoted)).otherwise(F.col("line"))
    rows = lines.join(done, key, "left").withColumn("_line", rewritten)
    kept = [F.col("_line").alias("line") if name == "line" else F.col(name) for name in lines.columns]
    return rows.select(*kept, (F.col("_line") != F.col("line")).alias("changed"))


def upsert_registry(entries: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Registering a key again replaces its value but keeps its first position (``ordinal``)."""
    rows = latest_by(entries, [key], order, [F.min(order).alias("ordinal")])
    return rows.select(key, "ordinal", *[name for name in entries.columns if name not in (key, order)])


def apply_changes(
    changes: DataFrame, registered: DataFrame | None = None, owner: str = "owner", key: str = "key"
) -> DataFrame:
    """State after a log of ``set``, ``delete`` and ``reset`` operations, one row per owner and key.

    The last change of a key wins and a delete removes it. A reset (a row without a key) removes the owner's
    keys of ``registered`` services (all keys if not given) that were not set after it.
    """
    single = changes.filter(F.col("op") != "reset")
    state = single.groupBy(owner, key).agg(
        F.max("seq").alias("_seq"),
        F.max_by(F.col("op") == "set", "seq").alias("_set"),
        F.max_by("value", "seq").alias("value"),
    )
    state = state.filter("_set")
    resets = changes.filter(F.col("op") == "reset").groupBy(owner).agg(F.max("seq").alias("_reset"))
    state = state.join(resets, owner, "left")
    wiped = F.coalesce(F.col("_seq") < F.col("_reset"), F.lit(False))
    if registered is not None:
        known = registered.select(F.col("id").alias(key)).distinct().withColumn("_known", F.lit(True))
        state = state.join(known, key, "left")
        wiped = wiped & F.col("_known").isNotNull()
    return state.filter(~wiped).select(owner, key, "value")


def merge_maps(defaults: Column, loaded: Column, mode: str = "merge") -> Column:
    """Loaded map over defaults: ``merge`` per key, or ``replace`` the whole map if there is one."""
    if mode == "replace":
        return F.coalesce(loaded, defaults)
    filled = F.coalesce(loaded, F.create_map().cast("map<string,string>"))
    return F.map_zip_with(defaults, filled, lambda key, old, new: F.coalesce(new, old))


def settings_defaults(
    loaded: DataFrame, language: str = DEFAULT_LANGUAGE, heap: Mapping[str, str] = DEFAULT_HEAP
) -> DataFrame:
    """Loaded settings with defaults field by field; blank or absent ones take the default."""
    heaps = F.create_map(*[F.lit(part) for pair in heap.items() for part in pair])
    no_ports = F.create_map().cast("map<string,int>")
    filled = {
        "language": F.coalesce(F.nullif("language", F.lit("")), F.lit(language)),
        "setup_completed": F.coalesce("setup_completed", F.lit(False)),
        "always_on_top": F.coalesce("always_on_top", F.lit(False)),
        "auto_start_notebooks": F.coalesce("auto_start_notebooks", F.lit(True)),
        "port_overrides": merge_maps(no_ports, F.col("port_overrides"), "replace"),
        "jvm_heap": merge_maps(heaps, F.col("jvm_heap"), "merge"),
    }
    return loaded.withColumns(filled)


def explode_map(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Map entries as rows."""
    return df.select(*keep, F.explode(column).alias("key", "value"))
