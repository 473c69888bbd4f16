"""Schemas of the records that the operators exchange."""

from __future__ import annotations

FILE_ENTRY = (
    "pathSuffix: STRING, type: STRING, length: BIGINT, modificationTime: BIGINT, owner: STRING, "
    "`group`: STRING, permission: STRING"
)

# Envelope of a directory listing document.
LISTING = f"STRUCT<FileStatuses: STRUCT<FileStatus: ARRAY<STRUCT<{FILE_ENTRY}>>>>"

SETTINGS = (
    "host STRING, language STRING, setup_completed BOOLEAN, always_on_top BOOLEAN, "
    "auto_start_notebooks BOOLEAN, port_overrides MAP<STRING, INT>, jvm_heap MAP<STRING, STRING>"
)

RELEASE = "version STRING, sha256 STRING, url STRING"

TASKLIST = "image STRING, pid STRING, session STRING, session_no STRING, mem STRING"
