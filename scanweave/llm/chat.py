"""Chat formatting with typed content parts (operator 2), native DataFrame functions only.

A message is a role and an ordered list of content parts; a part has a type, a text, a reference and a
count of units. The visitor turns each part into text in order: text is escaped, an image, audio or
document part becomes a placeholder that numbers it, and its reference and expanded token count are
recorded. Turns are then marked, and the spans of assistant text are kept as a loss mask.

Template: `<turn role="R">` text `</turn>` newline. Inside roles and texts the four characters \\ < > " are
written \\b \\l \\g \\q, so no text can hold a control string, and the reading is unambiguous: replacing the
last three and then \\b undoes it, whatever the text was.

Edge cases: a null role, text or list of parts is empty; a part of unknown or null type counts as text; a null
turn sorts first; rows with equal turns are ordered by role, then by text; repeated rows are all turns; a
null conversation id is a conversation of its own; an empty table gives no rows; other columns are ignored.

A conversation is one output string and one sequential digest, so its rows meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

PART = "struct<type:string,text:string,ref:string,units:double>"
#: Tokens that a unit of each attachment stands for (an image tile, a second of audio, a page).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ('"', "\\q"))
OPEN, OPEN_END, CLOSE = '<turn role="', '">', "</turn>\n"


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def text_part(text: Column) -> Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*TOKENS_PER_UNIT), F.lit(False))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment stands for: units (1 if null) times the type's figure, rounded up."""
    figure = F.element_at(F.create_map(*(F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv)), part["type"])
    return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * figure).cast("long")


def flatten(parts: Column) -> Column:
    """The visitor: struct(body, attachments) of a list of parts. A placeholder names the type and its number in the
    message, `<image 1>`; attachments are (type, ref, tokens) in the same order."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    start = F.struct(F.lit("").alias("body"), F.array().cast("array<struct<type:string,ref:string,tokens:bigint>>").alias("attachments"))

    def visit(state: Column, part: Column) -> Column:
        place = F.concat(F.lit("<"), part["type"], F.lit(" "), (F.size(state["attachments"]) + 1).cast("string"), F.lit(">"))
        seen = F.struct(part["type"].alias("type"), part["ref"].alias("ref"), expanded_tokens(part).alias("tokens"))
        attached = F.struct(F.concat(state["body"], place).alias("body"), F.concat(state["attachments"], F.array(seen)).alias("attachments"))
        said = F.struct(F.concat(state["body"], escape(F.coalesce(part["text"], F.lit("")))).alias("body"), state["attachments"].alias("attachments"))
        return F.when(is_attachment(part), attached).otherwise(said)

    return F.aggregate(parts, start, visit)


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start from 0 and length in code points of each
    assistant message's body), attachments (turn from 0, type, ref, tokens) and attachment_tokens."""
    flat = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), flatten(F.col(parts)).alias("flat"))
    rows = flat.select("conv_id", F.struct("turn", "role", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments")).alias("m"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    heads = F.transform("ms", lambda m: F.concat(F.lit(OPEN), escape(m["role"]), F.lit(OPEN_END)))
    chats = chats.withColumn("heads", heads)
    pieces = F.transform("ms", lambda m, i: F.concat(F.get("heads", i), m["body"], F.lit(CLOSE)))
    sizes = F.transform("ms", lambda m, i: F.struct(F.char_length(F.get("heads", i)).cast("long").alias("head"), F.char_length(m["body"]).cast("long").alias("body")))
    chats = chats.withColumn("sizes", sizes).withColumn("formatted", F.array_join(pieces, ""))
    # spans by one running sum over the messages: end of the text so far, and the starts seen
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    walk = lambda s, z: F.struct((s["at"] + z["head"] + z["body"] + len(CLOSE)).alias("at"), F.concat(s["starts"], F.array(s["at"] + z["head"])).alias("starts"))
    chats = chats.withColumn("starts", F.aggregate("sizes", start, walk)["starts"])
    spans = F.transform("ms", lambda m, i: F.struct(m["role"].alias("role"), F.get("starts", i).alias("start"), F.get("sizes", i)["body"].alias("length")))
    spans = F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    seen = F.flatten(F.transform("ms", lambda m, i: F.transform(m["attachments"], lambda a: F.struct(i.alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    chats = chats.select("conv_id", F.size("ms").cast("long").alias("n_turns"), "formatted", spans.alias("loss_spans"), seen.alias("attachments"))
    return chats.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn, read from the formatted string alone; placeholders stay as they stand."""
    pieces = F.filter(F.split(formatted, CLOSE.replace("/", "\\/")), lambda p: p != "")

    def read(p: Column) -> Column:
        head = F.instr(p, OPEN_END)
        role = F.substring(p, F.lit(len(OPEN) + 1), head - (len(OPEN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, head + len(OPEN_END), F.char_length(p))).alias("text"))

    return F.transform(pieces, read)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped: assistant texts in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


PROBE = "\\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    messages = rows.unionByName(probe).withColumn("parts", text_part(F.col("text")))
    chats = format_chats(messages)
    read = chats.select("conv_id", "n_turns", "formatted", F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )


SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
coded as (
  select *, replace(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g'), '"', '\q') as body,
         replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), '"', '\q') as head from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, body) filter (role = 'assistant'), '')) as loss_sha256,
       sum(12 + length(head) + 2 + length(body) + 8)::bigint as formatted_chars
from coded group by conv_id
"""

QUERIES = {"op2_chat": op2_chat}
ORACLES = {"op2_chat": SQL}
