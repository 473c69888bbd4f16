"""Port inventory: collisions, ownership, preflight checks and gap search.

A host has 65,535 ports, so a listener table has at most that many rows per host. Where ``host`` is among the
columns, joins are per host; join strategies are left to Catalyst and AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions import scalars as S

# The searchable ports, the length of a gap search and the ports watched besides the services'.
FIRST_PORT = 1024
END_PORT = 65535
SEARCH_SPAN = 200
EXTRA_PORTS = (("hdfs_rpc", "HDFS RPC", 9000), ("kafka_ctl", "Kafka Controller", 9093))
UNKNOWN_PROCESS = "proceso desconocido"


def union_probes(services: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Ports of the services and the extra ones, duplicates kept; ``origin`` tells them apart, services first."""
    if extras is None:
        extras = services.sparkSession.createDataFrame(
            EXTRA_PORTS, "service_id STRING, service_name STRING, port INT"
        )
    named = services.select(F.col("service_id").cast("string"), "service_name", F.col("port").cast("int"))
    return named.withColumn("origin", F.lit("0 service")).unionByName(extras.withColumn("origin", F.lit("1 extra")))


def port_scan(requests: DataFrame, listeners: DataFrame, ours: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """State of each requested port: ``free`` without a listener, ``ours`` if one of our pids holds it, else
    ``other``; ``releasable`` if someone else's pid is known."""
    # Our pids are looked up per listener, of which there are few, and not per request.
    own = ours.select(*by, "pid").distinct().withColumn("_ours", F.lit(True))
    held = listeners.join(own, [*by, "pid"], "left").select(
        *by, "port", "pid", F.col("name").alias("owner"), "_ours", F.lit(True).alias("_held")
    )
    joined = requests.join(held, [*by, "port"], "left")
    known = F.coalesce(F.col("pid"), F.lit(0)) > 0
    free = F.col("_held").isNull()
    status = F.when(free, "free").when(known & F.col("_ours").isNotNull(), "ours").otherwise("other")
    return joined.select(
        *requests.columns, "pid", "owner", status.alias("status"), ((status == "other") & known).alias("releasable")
    )


def peer_vm_owner(name: Column) -> Column:
    """Does a process name belong to the virtual-machine family?"""
    return S.contains_any(name, S.VM_FAMILY)


def vm_running(listing: Column, vm: str) -> Column:
    """A machine runs if its quoted name is in the list of running machines."""
    return F.contains(listing, F.lit(f'"{vm}"'))


def preflight_conflict(
    required: DataFrame, listeners: DataFrame, own: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """First required port of each service (``service_id, pos, port``) that another process holds.

    ``own`` has the pid of each service's process (``service_id, pid``); a service without one owns nothing.
    """
    service = [*by, "service_id"]
    mine = own.select(*service, F.col("pid").alias("_own"))
    held = listeners.filter(F.col("pid") > 0).select(*by, "port", "pid", "name")
    conflicts = required.join(held, [*by, "port"]).join(mine, service, "left")
    conflicts = conflicts.filter(F.col("_own").isNull() | (F.col("pid") != F.col("_own")))
    owner = F.when(F.coalesce(F.col("name"), F.lit("")) == "", UNKNOWN_PROCESS).otherwise(F.col("name"))
    first = F.min_by(F.struct("port", "pid", owner.alias("owner")), "pos").alias("_first")
    found = conflicts.groupBy(*service).agg(first).select(*service, "_first.*")
    return found.withColumn("kind", F.when(peer_vm_owner(F.col("owner")), "peer_vm").otherwise("foreign"))


def required_ports(services: DataFrame, ports: str = "ports") -> DataFrame:
    """One row per service and required port, in the order of its array."""
    return services.select("service_id", F.posexplode(ports).alias("pos", "port"))


def listener_process(listeners: DataFrame, processes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Name of each listener's process (``pid, image``), blank if unknown."""
    named = processes.select(*by, "pid", F.col("image").alias("_image"))
    joined = listeners.join(named, [*by, "pid"], "left")
    return joined.select(*listeners.columns, F.coalesce("_image", F.lit("")).alias("process"))


def kill_guard(listeners: DataFrame, ours: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Listeners with a known pid that is not one of ours: the only ones that may be ended."""
    on = [*by, "pid"]
    return listeners.filter(F.col("pid") > 0).join(ours.select(*on), on, "left_anti").select(*listeners.columns)


def port_in_range(port: Column, low: int = 1, high: int = END_PORT - 1) -> Column:
    """Null for an acceptable port, else why it is rejected."""
    return F.when(port.isNull(), "no port").when(~port.between(low, high), F.lit(f"not in {low}-{high}"))


def suggest_free_port(requests: DataFrame, listeners: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest free port at or above each requested one, within the search span; 0 if there is none.

    Searched once per distinct start (at most one per port and host) and joined back.
    """
    start = F.greatest(F.col("port"), F.lit(FIRST_PORT))
    high = F.least(F.col("_start") + (SEARCH_SPAN - 1), F.lit(END_PORT - 1))
    wanted = requests.withColumn("_start", start)
    starts = wanted.select(*by, "_start").distinct().filter(F.col("_start") < END_PORT)
    candidates = starts.select(*by, "_start", F.explode(F.sequence("_start", high)).alias("port"))
    free = candidates.join(listeners.select(*by, "port"), [*by, "port"], "left_anti")
    best = free.groupBy(*by, "_start").agg(F.min("port").alias("_free"))
    # Without hosts there are at most as many starts as ports, few enough to broadcast.
    joined = wanted.join(best if by else F.broadcast(best), [*by, "_start"], "left")
    return joined.select(*requests.columns, F.coalesce("_free", F.lit(0)).alias("free_port"))
