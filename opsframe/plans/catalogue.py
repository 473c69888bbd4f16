"""All registered queries."""

from __future__ import annotations

from opsframe.plans import (  # noqa: F401
    queries_config,
    queries_files,
    queries_logs,
    queries_ports,
    queries_sources,
    queries_status,
    queries_streams,
    queries_text,
)
from opsframe.plans.registry import ORACLES, QUERIES  # noqa: F401
