"""Chat formatting, with DataFrame functions only.

Records come as JSON text in differing layouts. The nested field paths of a record are hashed to a fingerprint, and the
fingerprint selects a declarative mapping to canonical turns (role, text). The turns are then written with a template
that marks them and escapes control strings in them reversibly, and read back from the formatted text.

Rules: null or absent texts and roles are empty; an unknown fingerprint gives no turns and ``layout`` null; an empty table
gives an empty result; further columns stay. Rows of one conversation and turn are ordered by role and text, and repeated
rows are turns of their own. A conversation is one value, so it has to fit in a task, however its rows are spread, and
Spark's limit of 2 GB a value holds; up to there texts of any length come back whole, and a record that can't be read
as JSON is an error, not an empty conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: Fixed value: the length of the longest text that a JVM can hold; the JSON reader's own limit is 20 million characters.
READING = {"maxStringLen": str((1 << 31) - 1)}

#: Layouts. "list": the field with the messages and their role and text fields. "fields": (role, field) of each turn, in order.
#: Optional fields and "ignored" ones don't change what a layout means; each combination has a fingerprint of its own.
LAYOUTS = {
    "messages": {"list": ("messages", "role", "content"), "ignored": ["id"]},
    "conversations": {"list": ("conversations", "from", "value"), "ignored": ["id"], "roles": {"human": "user", "gpt": "assistant"}},
    "prompt_response": {"fields": [("user", "prompt"), ("assistant", "response")], "ignored": ["id"]},
    "prompt_completion": {"fields": [("user", "prompt"), ("assistant", "completion")], "ignored": ["id"]},
    "instruction": {"fields": [("user", "instruction"), ("assistant", "output")], "ignored": ["id"]},
    "instruction_input": {"fields": [("system", "instruction"), ("user", "input"), ("assistant", "output")], "ignored": ["id"]},
}


def paths_of(layout: dict, more: list[str] = ()) -> list[str]:
    if "list" in layout:
        top, role, text = layout["list"]
        return sorted([top, f"{top}[].{role}", f"{top}[].{text}", *more])
    return sorted([*(field for _, field in layout["fields"]), *more])


def field_paths(record: Column) -> Column:
    """The sorted distinct nested field paths of a JSON object: its fields, and those of the items of the layouts' lists ("list[]" alone
    where it or an item of it is of another kind). A text that only looks like a list is a text. A record that is no JSON object is an error."""
    none = F.array().cast("array<string>")
    top = F.when(record.isNotNull(), F.coalesce(F.json_object_keys(record), F.raise_error(F.lit("a chat record is not a JSON object")).cast("array<string>"))).otherwise(none)
    names = sorted({layout["list"][0] for layout in LAYOUTS.values() if "list" in layout})
    lists = F.from_json(record, "struct<" + ",".join(f"`{n}`:array<string>" for n in names) + ">", READING)

    def nested(n: str) -> Column:
        paths = lambda item: F.coalesce(F.transform(F.json_object_keys(item), lambda f: F.concat(F.lit(f"{n}[]."), f)), F.array(F.lit(f"{n}[]")))
        return F.when(lists[n].isNotNull(), F.flatten(F.transform(lists[n], paths))).when(F.array_contains(top, n), F.array(F.lit(f"{n}[]"))).otherwise(none)

    return F.array_sort(F.array_distinct(F.concat(top, *map(nested, names))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _registry():
    """(paths, layout name) of every known fingerprint."""
    for name, layout in LAYOUTS.items():
        for more in ([], *([x] for x in layout["ignored"])):
            yield paths_of(layout, more), name
            if "list" in layout:  # a list without items
                yield sorted([layout["list"][0], *more]), name


def _message(role: str, text: str, roles: dict[str, str]):
    """Item of a message list to canonical turn."""
    return lambda m: F.struct(F.coalesce(*[F.when(m[role] == a, b) for a, b in roles.items()], m[role], F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))


def canonical_turns(records: DataFrame, json: str = "record") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` to records with a JSON column."""
    df = records.withColumn("fingerprint", fingerprint(field_paths(F.col(json))))
    known = [(fingerprint(F.array(*map(F.lit, paths))), name) for paths, name in _registry()]
    layout = F.lit(None).cast("string")
    for code, name in known:
        layout = F.when(F.col("fingerprint") == code, name).otherwise(layout)
    df = df.withColumn("layout", layout)
    turns = F.array().cast(TURNS)
    for name, spec in LAYOUTS.items():
        if "list" in spec:
            top, role, text = spec["list"]
            parsed = F.from_json(F.col(json), f"struct<`{top}`:array<struct<`{role}`:string,`{text}`:string>>>", READING)[top]
            made = F.transform(F.coalesce(parsed, F.array()), _message(role, text, spec.get("roles", {})))
        else:
            parsed = F.from_json(F.col(json), "struct<" + ",".join(f"`{f}`:string" for _, f in spec["fields"]) + ">", READING)
            made = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(parsed[f], F.lit("")).alias("text")) for r, f in spec["fields"]])
        turns = F.when(F.col("layout") == name, made.cast(TURNS)).otherwise(turns)
    return df.withColumn("turns", turns)


def escape(text: Column) -> Column:
    """Puts one backslash more between "<" and "|", so that no text holds "<|"."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Doubled backslashes are set aside while line ends come back.
    lines = F.replace(F.regexp_replace(role, r"(\\\\)|\\n", "$1\n"), F.lit("\\\\\n"), F.lit("\\"))
    return unescape(lines)


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def read_back(text: Column) -> Column:
    """The turns in a formatted text."""
    parts = F.slice(F.split(text, r"<\|im_start\|>"), 2, 1 << 30)
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(head(p)) + 2, F.length(p) - F.length(head(p)) - 2 - len(END))
    return F.transform(parts, lambda p: F.struct(unescape_role(head(p)).alias("role"), unescape(body(p)).alias("text")))


def loss_spans(turns: Column) -> Column:
    """(start, length) of each assistant text in the formatted text, in code points from 0."""
    width = lambda t: F.length(escape_role(t["role"])) + F.length(escape(t["text"])) + F.lit(len(START) + 1 + len(END) + 1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda s, t: F.struct((s["at"] + width(t)).alias("at"), F.when(t["role"] == "assistant", F.array_append(s["spans"], F.struct((s["at"] + F.lit(len(START) + 1) + F.length(escape_role(t["role"]))).alias("start"), F.length(escape(t["text"])).alias("length")))).otherwise(s["spans"]).alias("spans"))
    return F.aggregate(turns, empty, step)["spans"]


def format_chats(records: DataFrame, json: str = "record") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` to records in any known layout."""
    df = canonical_turns(records, json)
    return df.withColumns({"formatted": formatted(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))})


def records_of_rows(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversations held as rows (id, turn, role, text) as JSON records: a user and an assistant turn in the prompt layout, with a system
    turn before them in the instruction layout, other ones with an odd number of turns as "conversations", the rest as "messages"."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), none("role").alias("role"), none("text").alias("text"))
    df = rows.select(F.col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    roles = F.array_join(F.transform("ts", lambda t: t["role"]), ",")
    text = lambda k: F.element_at(F.col("ts"), k)["text"]
    pair = F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("response")))
    three = F.to_json(F.struct(text(1).alias("instruction"), text(2).alias("input"), text(3).alias("output")))
    shared = F.to_json(F.struct(F.transform("ts", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value"))).alias("conversations")))
    other = F.to_json(F.struct(F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    plain = ~F.exists("ts", lambda t: t["role"].isin("human", "gpt"))
    record = F.when(roles == "user,assistant", F.when(F.size("ts") == 2, pair).otherwise(other)).when(roles == "system,user,assistant", F.when(F.size("ts") == 3, three).otherwise(other)).when((F.size("ts") % 2 == 1) & plain, shared).otherwise(other)
    return df.select("conv_id", record.alias("record"))
