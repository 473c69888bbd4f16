"""Scalar functions as JVM-side column expressions (no Python UDF anywhere here)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity words, the access-link pattern and the load-failure signatures to look for.
ERROR_WORDS = "ERROR|FATAL|SEVERE|Exception|Traceback"
WARN_WORDS = "WARN(ING)?"
ACCESS_URL = r"https?://(?:127\.0\.0\.1|localhost)(?::\d+)?/(?:lab|tree)?\??token=[A-Za-z0-9]+"
FATAL_SIGNATURES = (
    "could not find or load main class",
    "classnotfoundexception",
    "no se ha encontrado o cargado la clase",
)
VM_FAMILY = ("vboxheadless", "virtualboxvm", "vboxsvc")
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def whole_word(words: str) -> str:
    """Case-insensitive pattern for whole words with ASCII word boundaries.

    Java's word boundary is Unicode-aware, so the boundaries are written out.
    """
    return rf"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"


def detect_level(text: Column, strict: bool = True) -> Column:
    """ERROR, WARN or INFO by the words in a line; ERROR is tested first.

    ``strict=False`` also takes names such as ``NullPointerException`` or ``IOError`` for errors.
    """
    error = text.rlike(whole_word(ERROR_WORDS))
    if not strict:
        error = error | text.rlike(whole_word(r"\w+(?:Exception|Error)"))
    return F.when(error, "ERROR").when(text.rlike(whole_word(WARN_WORDS)), "WARN").otherwise("INFO")


def human_size(size: Column) -> Column:
    """Size for people: ``0`` for none, whole bytes, else one decimal up to TB."""
    out = F.when(F.coalesce(size, F.lit(0)) == 0, "0").when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        tenths = F.floor(size / F.lit(float(1024**power)) * 10 + 0.5)
        shown = F.concat((tenths / 10).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))
        out = out.otherwise(shown) if unit == SIZE_UNITS[-1] else out.when(size < 1024 ** (power + 1), shown)
    return out


def path_join(parent: Column, child: Column) -> Column:
    """Parent and child with one slash between; blank or root parent gives a child of the root."""
    return F.when(parent.isin("", "/"), F.concat(F.lit("/"), child)).otherwise(
        F.concat(F.regexp_replace(parent, r"/\z", ""), F.lit("/"), child)
    )


def normalise_path(path: Column) -> Column:
    """Blank becomes the root; a leading slash is added where it is missing."""
    return F.when(path == "", "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def escape_path(path: Column) -> Column:
    """Percent-encode each segment of a path and keep the slashes."""
    out = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    kept = {"%2F": "/", "%7E": "~", "%24": "$", "%26": "&", "%2B": "+", "%3A": ":", "%3D": "=", "%40": "@"}
    for code, char in kept.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def file_uri(path: Column) -> Column:
    """``file:`` address of an absolute path in either slash style."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith("/"), F.concat(F.lit("file://"), slashed)).otherwise(
        F.concat(F.lit("file:///"), slashed)
    )


def round1(value: Column) -> Column:
    """One decimal: add a half and cut off towards zero (so -1.26 gives -1.2)."""
    return (value * 10 + 0.5).cast("bigint") / F.lit(10.0)


def bytes_to_mb(size: Column) -> Column:
    """Whole mebibytes."""
    return F.call_function("div", size, F.lit(1048576))


def millis_to_ts(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def clock_millis(ts: Column) -> Column:
    """Time of day with milliseconds, cut off and not rounded."""
    return F.date_format(ts, "HH:mm:ss.SSS")


def extract_access_url(text: Column) -> Column:
    """First local access link with a token in a line; blank if there is none."""
    return F.regexp_extract(text, ACCESS_URL, 0)


def rewrite_url_path(url: Column, path: Column) -> Column:
    """Put another path into a URL; scheme, authority, query and fragment stay."""
    head = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    tail = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*[^?#]*(?s)(.*)\z", 1)
    return F.concat(head, path, tail)


def kv_key(entry: Column) -> Column:
    """Key of ``k=v`` (up to the first ``=``); null where there is no ``=``."""
    at = F.instr(entry, "=")
    return F.when(at > 0, F.substring(entry, F.lit(1), at - 1))


def kv_value(entry: Column) -> Column:
    at = F.instr(entry, "=")
    return F.when(at > 0, F.substring(entry, at + 1, F.length(entry)))


def split_fields(text: Column) -> Column:
    """Fields between runs of whitespace, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda field: field != "")


def exercise_id(name: Column, prefix: str) -> Column:
    """``ej`` + the lower-case name without its prefix; null where nothing is left."""
    rest = F.when(name.startswith(prefix), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(name)
    return F.concat(F.lit("ej"), F.nullif(F.lower(rest), F.lit("")))


def template_fill(template: Column, uri: Column) -> Column:
    """Fill ``{{.URI}}``."""
    return F.replace(template, F.lit("{{.URI}}"), uri)


def placeholder_fill(template: Column, args: Column) -> Column:
    """Fill ``{0}``, ``{1}``, … from an array, in one pass; slots without an argument become blank."""
    tokens = F.split(template, r"(?<=\})|(?=\{\d+\})")
    slot = r"^\{(\d+)\}\z"

    def fill(token: Column) -> Column:
        value = F.get(args, F.regexp_extract(token, slot, 1).try_cast("int"))
        return F.when(token.rlike(slot), F.coalesce(value.cast("string"), F.lit(""))).otherwise(token)

    return F.array_join(F.transform(tokens, fill), "")


def strip_cr(text: Column, every: bool = False) -> Column:
    """Take one trailing carriage return off, or all of them.

    ``$`` would also match before a last CR, hence the strict end of input.
    """
    return F.regexp_replace(text, r"\r+\z" if every else r"\r\z", "")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def to_int(text: Column) -> Column:
    """A decimal number as INT, else null. Tested first: a failing ``try_cast`` costs an exception per row."""
    return F.when(text.rlike(r"^[+-]?\d+\z"), text).try_cast("int")


def extract_pid(text: Column) -> Column:
    """Process id of a lifecycle message, null if it names none."""
    return F.nullif(F.regexp_extract(text, r"PID (\d+)", 1), F.lit("")).try_cast("int")


def extract_exit(text: Column) -> Column:
    """Exit code of a lifecycle message, null if it names none."""
    return F.nullif(F.regexp_extract(text, r"\(exit (-?\d+)\)", 1), F.lit("")).try_cast("int")


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """Case-insensitive test for any of several substrings."""
    low = F.lower(text)
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(low, F.lit(needle))
    return found
