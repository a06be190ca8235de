"""Chat formatting by schema fingerprints (native).

``fingerprint`` hashes the nested field paths of a layout. ``LAYOUTS`` maps fingerprints to
declarative mappings: which path holds the conversation, the order, the role and the text.
``canonical_turns`` looks a table's fingerprint up and rewrites it to (conv_id, turn, role, text);
``canonical_records`` does the same for JSON records of mixed layouts, each by its own field paths.
``format_turns`` renders canonical turns in a template with a loss mask, ``read_back`` parses it.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. A control string inside a role or text gets
one more ``&`` after its first character (``<|`` to ``<&|``, ``</s>`` to ``<&/s>``, and a text's own
``<&|`` to ``<&&|``), so no text can end a turn and removing one ``&`` gives it back.

The output is cut into segments of ``SEGMENT`` turn numbers, and these into parts of ``PART`` rows where
turn numbers repeat, so that a conversation of any length is many bounded rows. The loss mask is a list of code-point spans of the segment: the assistant texts.

Nulls and ties: null texts and roles are empty, a null turn comes first, a null conversation is one
of its own; rows of the same turn follow in order of role and text, repeated rows are repeated turns.
Extra columns are left out. An empty table gives no rows. A table of an unknown layout raises
``ValueError``; an unknown record raises when it is read, or is kept apart on request.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, types as T
from pyspark.sql import functions as F

from keyloom.llm.common import table

SEGMENT, PART = 256, 1024
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What other chat templates and this one treat as control strings, behind their first character.
CONTROL = r"\||/?s>|</?SYS>>|/?INST\]"
ESCAPE = rf"([<\[])(&*)({CONTROL})"
UNESCAPE = rf"([<\[])&(&*)({CONTROL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, "$1&$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths, ``messages[].role``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(names))).encode()).hexdigest()


#: name, the paths that tell the layout, and how it becomes turns: ``rows`` (a row is a turn), ``list`` (a row has all turns) or ``fields`` (a field is a turn).
_KNOWN = [
    ("rows", ["conv_id", "turn", "role", "text"], {"rows": ("turn", "role", "text")}),
    ("messages", ["conv_id", "messages[].role", "messages[].content"], {"list": ("messages", "role", "content")}),
    ("conversations", ["conv_id", "conversations[].from", "conversations[].value"], {"list": ("conversations", "from", "value")}),
    ("instruction", ["conv_id", "instruction", "input", "output"], {"fields": (("user", ("instruction", "input")), ("assistant", ("output",)))}),
    ("prompt", ["conv_id", "prompt", "completion"], {"fields": (("user", ("prompt",)), ("assistant", ("completion",)))}),
    ("prompt-response", ["conv_id", "system", "prompt", "response"], {"fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))}),
    ("question", ["conv_id", "question", "answer"], {"fields": (("user", ("question",)), ("assistant", ("answer",)))}),
]
LAYOUTS = {fingerprint(p): (name, p, how) for name, p, how in _KNOWN}
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def _role(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.lower(role)), role)


def layout_of(schema: T.StructType) -> tuple[str, list[str], dict]:
    """The layout whose fingerprint the schema has; fields that no layout knows don't count."""
    known = {p for _, ps, _ in LAYOUTS.values() for p in ps}
    have = paths(schema)
    got = LAYOUTS.get(fingerprint([p for p in have if p in known]))
    if got is None:  # a field that only other layouts know may stand beside: take the largest layout that is whole
        whole = [v for v in LAYOUTS.values() if set(v[1]) <= set(have)]
        if not whole:
            raise ValueError(f"no mapping for the layout {sorted(have)}")
        got = max(whole, key=lambda v: (len(v[1]), v[0]))
    return got


def canonical_turns(df: DataFrame) -> DataFrame:
    """A table of any known layout -> conv_id, turn, role, text."""
    _, _, how = layout_of(df.schema)
    if "rows" in how:
        turn, role, text = how["rows"]
        return df.select("conv_id", F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    if "list" in how:
        at, role, text = how["list"]
        rows = df.select("conv_id", F.posexplode(at).alias("turn", "m"))
        return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _role(F.col("m")[role]).alias("role"), F.col("m")[text].alias("text"))
    turns = F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.nullif(F.col(f), F.lit("")) for f in fs]).alias("text")) for role, fs in how["fields"]])
    kept = F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != ""))
    return df.select("conv_id", F.posexplode(kept).alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.text")


_LISTS = sorted({how["list"][0] for _, _, how in _KNOWN if "list" in how})


def _under(at: str, name: Column) -> Column:
    return F.concat(F.lit(f"{at}[]."), name)


def _turn(n: Column, role: Column, text: Column) -> Column:
    return F.struct(n.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))


def _message(role: str, text: str, m: Column, i: Column) -> Column:
    return _turn(i, _role(F.try_variant_get(m, f"$.{role}", "string")), F.try_variant_get(m, f"$.{text}", "string"))


def record_paths(record: Column) -> Column:
    """The nested field paths of a JSON record that some layout knows, sorted; none for text that isn't an object."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    found = [F.filter(top, lambda k: ~k.isin(_LISTS))]
    for at in _LISTS:
        rows = F.try_variant_get(F.try_parse_json(record), f"$.{at}", "array<variant>")
        keys = F.flatten(F.transform(rows, lambda v: F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))))
        found.append(F.transform(F.coalesce(keys, F.array().cast("array<string>")), partial(_under, at)))
    known = sorted({p for _, ps, _ in _KNOWN for p in ps})
    return F.array_sort(F.array_distinct(F.filter(F.concat(*found), lambda k: k.isin(known))))


def record_layout(paths_: Column) -> Column:
    """Name of the layout with the paths' fingerprint; where fields of another layout stand beside, the largest layout that is whole; else null."""
    named = F.create_map(*[F.lit(x) for f, (name, _, _) in LAYOUTS.items() for x in (f, name)])
    whole = [F.when(F.size(F.array_intersect(paths_, F.array(*map(F.lit, ps)))) == len(ps), F.lit(name)) for name, ps, _ in sorted(_KNOWN, key=lambda v: (len(v[1]), v[0]), reverse=True)]
    return F.coalesce(F.try_element_at(named, F.sha2(F.array_join(paths_, "\n").cast("binary"), 256)), *whole)


def with_layout(df: DataFrame, record: str = "record") -> DataFrame:
    """JSON records -> record, paths, layout; layout is null for a record of no known one."""
    rows = df.select(F.col(record).alias("record"), record_paths(F.col(record)).alias("paths"))
    return rows.withColumn("layout", record_layout(F.col("paths")))


def unknown_records(df: DataFrame, record: str = "record") -> DataFrame:
    """record, paths of the JSON records that no layout fits, torn ones too."""
    return with_layout(df, record).where("layout is null").select("record", "paths")


def canonical_records(df: DataFrame, record: str = "record", unknown: str = "raise") -> DataFrame:
    """JSON records, each of its own layout -> conv_id, turn, role, text.

    The fingerprint is made for each record from its own field paths and picks one mapping. A record
    of no known layout raises when its row is read; with ``unknown="apart"`` it gives no turns, and
    ``unknown_records`` returns it. One pass, a record is parsed once for each field that is read.
    """
    rows = with_layout(df, record)
    v = F.try_parse_json(F.col("record"))
    get = lambda at, kind="string": F.try_variant_get(v, at, kind)
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    made = F.when(F.col("layout").isNull(), F.raise_error(F.concat(F.lit("no mapping for the layout "), F.to_json("paths")))) if unknown == "raise" else F.when(F.col("layout").isNull(), none)
    for name, _, how in _KNOWN:
        if "rows" in how:
            turns = F.array(_turn(*[get(f"$.{f}", "bigint" if i == 0 else "string") for i, f in enumerate(how["rows"])]))
        elif "list" in how:
            at, role, text = how["list"]
            turns = F.transform(get(f"$.{at}", "array<variant>"), partial(_message, role, text))
        else:
            said = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.nullif(get(f"$.{f}"), F.lit("")) for f in fs]).alias("text")) for role, fs in how["fields"]]
            kept = F.filter(F.array(*said), lambda t: (t["role"] != "system") | (t["text"] != ""))
            turns = F.transform(kept, lambda t, i: _turn(i, t["role"], t["text"]))
        made = made.when(F.col("layout") == name, turns)
    return rows.select(get("$.conv_id", "bigint").alias("conv_id"), F.explode(made).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def format_turns(turns: DataFrame) -> DataFrame:
    """Canonical turns -> conv_id, segment, part, n_turns, formatted, loss (array of struct start, length in code points)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))).cast("bigint").alias("segment"),
        F.concat(F.lit(TURN), role, F.lit(TEXT)).alias("head"), text.alias("body"),
    )
    # the order within a segment is that of the first three fields
    one = F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text", "head", "body")
    place = F.row_number().over(Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.withColumn("part", F.floor((place - 1) / PART))  # the window's partitioning serves the aggregation too
    cells = rows.groupBy("conv_id", "segment", "part").agg(F.array_sort(F.collect_list(one)).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        head, body = F.char_length(x["head"]), F.char_length(x["body"])
        span = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        spans = F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + body + len(END)).alias("at"), spans.alias("spans"))

    loss = F.aggregate("t", first, step)["spans"]
    return cells.select("conv_id", "segment", "part", F.size("t").alias("n_turns"), whole.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Segments -> also turns (array of struct role, text) and loss_text, from the rendered string and the mask alone."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    turn = lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"))
    learnt = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(learnt, ""))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"),
    )
    turns = canonical_turns(table(spark, sf_dir, "conversations")).unionByName(canonical_turns(probe))
    rows = read_back(format_turns(turns))
    rows = rows.select(
        "conv_id", "segment", "part", F.size("turns").alias("n"), F.char_length("formatted").alias("chars"), "loss_text",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    # digests of a whole conversation need its string in one row; what meets here is a row per segment
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "part", "said", "loss_text"))).alias("s"), F.sum("n").cast("bigint").alias("n_turns"), F.sum("chars").cast("bigint").alias("formatted_chars"))
    loss = F.array_join("s.loss_text", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("s.said", "").cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


OP10_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(role, '{ESCAPE}', '\1&\2\3', 'g')) + length(regexp_replace(text, '{ESCAPE}', '\1&\2\3', 'g')) + {len(TURN + TEXT + END)} AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn ASC NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn ASC NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
