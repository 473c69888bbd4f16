"""Chat formatting by schema fingerprints, in DataFrame operations only.

Rows are variants (or JSON texts) in any of several layouts. A row's fingerprint is the hash of its nested field paths, of
those that any layout knows: their order, nulls, and other fields (ids, names, scores, whole objects) make no difference.
It selects the declarative mapping that turns the row into canonical turns (role, text). A layout is a list of paths, so
adding one means adding a line to ``LAYOUTS``; an empty list of messages fits its layout too, and has no turns. Rows with
an unknown fingerprint are returned as such, never dropped. ``format_rows`` writes a row that holds a whole conversation,
``format_conversations`` those whose turns are rows.

The template writes a turn as ``### role: text</turn>`` and a newline. Inside roles and texts a backslash is doubled and
control strings are broken by backslashes, so that neither ``###`` nor ``</turn>`` of a text can be taken for the
template's; taking the backslashes away gives the text back (``parse``).

Nulls: a null text is empty, a null role is empty, each row without a conversation id is a conversation of its own. Turns
are in the order of their number (null first), then role, then text; repeated turns stay. An empty table gives an empty
result; other columns are not looked at. A conversation is one text and one digest, so its turns come together by their
definition; they are formatted and escaped before, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"

# The layouts. Field paths (elements of lists are marked by [], a list without any by [0]), and how turns are
# read.
LAYOUTS: dict[str, tuple[list[str], str]] = {
    "turn row": (["role", "text"], "turn"),
    "turn row with content": (["content", "role"], "content"),
    "message": (["message", "message.content", "message.role"], "message"),
    "prompt": (["prompt", "response"], "prompt"),
    "prompt and completion": (["completion", "prompt"], "completion"),
    "instruction": (["instruction", "output"], "instruction"),
    "instruction with input": (["input", "instruction", "output"], "instruction"),
    "messages": (["messages[]", "messages[].content", "messages[].role"], "messages"),
    "no messages": (["messages[0]"], "messages"),
    "conversations": (["conversations[]", "conversations[].from", "conversations[].value"], "conversations"),
    "no conversations": (["conversations[0]"], "conversations"),
}
KNOWN = sorted({path for paths, _ in LAYOUTS.values() for path in paths})

_TURNS = "array<struct<role: string, text: string>>"


def field_paths(row: Column) -> Column:
    """The known field paths of a variant in the order of ``KNOWN``."""

    def there(path: str) -> Column:
        """Whether the row has the path: a field counts with a null too, in a list with any of its elements."""
        head, mark, rest = path.partition("[")
        if not mark:
            return F.try_variant_get(row, f"$.{path}", "variant").isNotNull()
        elements = F.try_variant_get(row, f"$.{head}", "array<variant>")
        if rest in ("]", "0]"):
            return F.size(elements) > 0 if rest == "]" else F.size(elements) == 0
        return F.exists(elements, lambda x: F.try_variant_get(x, f"$.{rest[2:]}", "variant").isNotNull())

    return F.array_compact(F.array(*[F.when(F.coalesce(there(path), F.lit(False)), path) for path in KNOWN]))


def fingerprint(row: Column) -> Column:
    return F.xxhash64(F.array_join(field_paths(row), ","))


def _known(paths: list[str]) -> str:
    """What is hashed of a row in a layout with the paths."""
    return ",".join(sorted(paths))


def turns(row: Column) -> Column:
    """Canonical turns of a variant by the mapping that its fingerprint selects; null if there is none."""

    def read(path: str) -> Column:
        return F.coalesce(F.try_variant_get(row, path, "string"), F.lit(""))

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    asked = F.when(F.length(read("$.input")) > 0, F.concat_ws("\n\n", read("$.instruction"), read("$.input")))
    called = {"human": "user", "gpt": "assistant"}
    said = F.try_variant_get(row, "$.conversations", "array<struct<`from`: string, value: string>>")
    role = F.create_map(*[F.lit(x) for pair in called.items() for x in pair])
    mappings = {
        "turn": F.array(turn(read("$.role"), read("$.text"))),
        "content": F.array(turn(read("$.role"), read("$.content"))),
        "message": F.array(turn(read("$.message.role"), read("$.message.content"))),
        "prompt": F.array(turn(F.lit("user"), read("$.prompt")), turn(F.lit("assistant"), read("$.response"))),
        "completion": F.array(turn(F.lit("user"), read("$.prompt")), turn(F.lit("assistant"), read("$.completion"))),
        "instruction": F.array(
            turn(F.lit("user"), F.coalesce(asked, read("$.instruction"))), turn(F.lit("assistant"), read("$.output"))
        ),
        "messages": F.transform(
            F.try_variant_get(row, "$.messages", "array<struct<role: string, content: string>>"),
            lambda m: turn(F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit(""))),
        ),
        "conversations": F.transform(
            said,
            lambda m: turn(F.coalesce(F.try_element_at(role, m["from"]), m["from"], F.lit("")), F.coalesce(m["value"], F.lit(""))),
        ),
    }
    mark, chosen = fingerprint(row), None
    for paths, mapping in LAYOUTS.values():
        hit = mark == F.xxhash64(F.lit(_known(paths)))
        chosen = F.when(hit, mappings[mapping]) if chosen is None else chosen.when(hit, mappings[mapping])
    return chosen.cast(_TURNS)


def canonical(rows: DataFrame, row: str = "row") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` (null: unknown) and ``turns`` to rows with a variant column."""
    name = None
    for key, (paths, _) in LAYOUTS.items():
        hit = F.col("fingerprint") == F.xxhash64(F.lit(_known(paths)))
        name = F.when(hit, key) if name is None else name.when(hit, key)
    return rows.withColumn("fingerprint", fingerprint(F.col(row))).withColumns({"layout": name, "turns": turns(F.col(row))})


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    """One turn; a colon in a role is escaped, since the first one ends it."""
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(": "), escape(text), F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    lines = F.split(formatted, END)
    head = r"(?s)^### ((?:[^:\\]|\\.)*+): "
    return F.transform(
        F.slice(lines, F.lit(1), F.size(lines) - 1),
        lambda x: F.struct(
            unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_replace(x, head, "")).alias("text")
        ),
    )


def format_rows(rows: DataFrame, row: str = "row") -> DataFrame:
    """Adds fingerprint, layout, turns and ``formatted`` (null for an unknown layout) to rows with a whole conversation each."""
    known = canonical(rows, row)
    return known.withColumn("formatted", F.array_join(F.transform("turns", lambda t: format_turn(t["role"], t["text"])), ""))


def format_conversations(turn_rows: DataFrame) -> DataFrame:
    """(conv_id, formatted) of rows (conv_id, turn, row) whose variants hold a turn each, or several that belong together.

    Rows in an unknown layout have no turns.
    """
    rows = canonical(turn_rows.select("conv_id", "turn", "row")).select("conv_id", "turn", F.explode("turns").alias("t"))
    rows = rows.select("conv_id", "turn", "t.role", "t.text").withColumn("part", format_turn(F.col("role"), F.col("text")))
    named = rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "part"))).alias("parts")
    )
    lone = rows.filter(F.col("conv_id").isNull()).select("conv_id", F.col("part").alias("formatted"))
    return named.select("conv_id", F.array_join(F.col("parts.part"), "").alias("formatted")).unionByName(lone)


def turn_variants(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as variants; nulls are empty."""
    one = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select("conv_id", "turn", F.to_variant_object(one).alias("row"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what ``formatted`` (conv_id, formatted) holds; the loss mask covers the assistant's texts."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
