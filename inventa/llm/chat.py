r"""Chat formatting with typed content parts.

A message holds an array of parts (:data:`PART`).  A visitor flattens each part
in order: text is escaped and written; image, audio and document parts become
the placeholders ``<|image|>``, ``<|audio|>``, ``<|document|>`` and are recorded
in ``attachments`` (the k-th placeholder of a conversation belongs to the k-th
attachment) with the number of tokens they expand to: image tiles of
``TILE`` pixels, ``AUDIO_RATE`` a second, ``PAGE_TOKENS`` a page.

A turn is ``<|im_start|>role<|im_sep|>content<|im_end|>\n``.  Inside roles and
texts ``\`` is written ``\\`` and ``<|`` is written ``<\|``: no text can
produce a control string, and dropping one ``\`` of each pair restores it.  The
loss mask holds the content of the assistant's turns as code point spans.

All work is DataFrame operations.  Turns are joined in two steps, first blocks
of ``BLOCK`` consecutive turns and then the blocks of a conversation, so that a
very long conversation is sorted and joined by many tasks and only its finished
blocks meet.

Defined cases: null text is empty, a null role is the empty role; a part of
null or unknown type is text if it has text, else the placeholder
``<|attachment|>`` of 0 tokens; a null part or part list gives nothing; missing
sizes count as 0 (at least one token for a known attachment); turns order by
turn (null first), then role, then content, and repeated rows are repeated
turns; a null conversation id is a conversation; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm.registry import register
from inventa.session import table

PART = "type string, text string, ref string, width int, height int, seconds double, pages int"
TILE = 28
AUDIO_RATE = 25
PAGE_TOKENS = 512
BLOCK = 64
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_KNOWN = ("image", "audio", "document")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _is_text(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit(""))
    return part.isNotNull() & ((kind == "text") | (~kind.isin(*_KNOWN) & part["text"].isNotNull()))


def _visit(part: Column) -> Column:
    kind = part["type"]
    return (F.when(part.isNull(), "").when(_is_text(part), escape(F.coalesce(part["text"], F.lit(""))))
            .when(kind.isin(*_KNOWN), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise("<|attachment|>"))


def _tokens(part: Column) -> Column:
    def size(name: str) -> Column:
        return F.greatest(F.coalesce(part[name], F.lit(0)).cast("double"), F.lit(0.0))

    kind = part["type"]
    wanted = (F.when(kind == "image", F.ceil(size("width") / TILE) * F.ceil(size("height") / TILE))
              .when(kind == "audio", F.ceil(size("seconds") * AUDIO_RATE))
              .when(kind == "document", F.ceil(size("pages")) * PAGE_TOKENS))
    return F.when(kind.isin(*_KNOWN), F.greatest(wanted.cast("long"), F.lit(1))).otherwise(F.lit(0)).cast("long")


def _attachment(part: Column) -> Column:
    kind = F.when(part["type"].isin(*_KNOWN), part["type"]).otherwise("attachment")
    return F.struct(kind.alias("type"), part["ref"].alias("ref"), _tokens(part).alias("tokens"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation of ``messages`` (conv_id, turn, role, parts):
    conv_id, formatted, loss_spans (start, end), loss_text (what the spans hold,
    still escaped), attachments (type, ref, tokens), expanded_tokens."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<struct<{_ddl()}>>"))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = messages.select(
        "conv_id", F.floor(F.col("turn") / BLOCK).alias("block"),
        F.struct(
            F.col("turn"), role.alias("role"), F.array_join(F.transform(parts, _visit), "").alias("body"),
            F.concat(F.lit(START), escape(role), F.lit(SEP)).alias("head"),
            F.transform(F.filter(parts, lambda p: p.isNotNull() & ~_is_text(p)), _attachment).alias("attached"),
        ).alias("t"))
    blocks = (turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("t"))
              .select("conv_id", "block", "t", F.array_join(F.transform(
                  "t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("s"),
                  F.expr(f"""aggregate(t, struct(0L AS at, CAST(array() AS array<struct<a:bigint, b:bigint>>) AS spans),
                    (acc, x) -> struct(
                      acc.at + char_length(x.head) + char_length(x.body) + {len(END)}L AS at,
                      IF(x.role = 'assistant', concat(acc.spans, array(struct(
                        acc.at + char_length(x.head) AS a, acc.at + char_length(x.head) + char_length(x.body) AS b))),
                        acc.spans) AS spans))""").alias("m"))
              .select("conv_id", F.struct(
                  "block", "s", F.col("m.at").alias("size"), F.col("m.spans").alias("spans"),
                  F.expr("array_join(transform(m.spans, p -> substring(s, int(p.a) + 1, int(p.b - p.a))), '')").alias("loss"),
                  F.flatten(F.transform("t", lambda x: x["attached"])).alias("attached")).alias("b")))
    return (blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
            .select("conv_id", "b", F.expr("""aggregate(b, struct(0L AS at, CAST(array() AS array<bigint>) AS starts),
                (acc, x) -> struct(acc.at + x.size AS at, concat(acc.starts, array(acc.at)) AS starts)).starts""").alias("starts"))
            .select("conv_id", F.expr("array_join(transform(b, x -> x.s), '')").alias("formatted"),
                    F.expr("""flatten(zip_with(b, starts, (x, at) -> transform(x.spans,
                        p -> struct(p.a + at AS start, p.b + at AS end))))""").alias("loss_spans"),
                    F.expr("array_join(transform(b, x -> x.loss), '')").alias("loss_text"),
                    F.expr("flatten(transform(b, x -> x.attached))").alias("attachments"))
            .withColumn("expanded_tokens", F.expr("aggregate(attachments, 0L, (n, x) -> n + x.tokens)")))


def _ddl() -> str:
    return ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in PART.split(", "))


def text_parts(text: Column) -> Column:
    """A plain text as the part list of a message."""
    fields = [F.lit("text").alias("type"), text.alias("text")]
    fields += [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in PART.split(", ")[2:]]
    return F.array(F.struct(*fields))


def read_turns(formatted: Column) -> Column:
    """The (role, content) pairs of a formatted conversation, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    heads = F.filter(pieces, lambda x: x != "")
    return F.transform(heads, lambda x: F.struct(
        unescape(F.substring_index(F.replace(x, F.lit(START), F.lit("")), SEP, 1)).alias("role"),
        unescape(F.substring_index(x, SEP, -1)).alias("text")))


_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + 1
    + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@register("op3_chat_format", _SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, read back from the output."""
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(END[:-1] + START + "assistant ok").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = format_conversations(rows.withColumn("parts", text_parts(F.col("text"))))
    return (out.select("conv_id", read_turns(F.col("formatted")).alias("turns"),
                       unescape(F.col("loss_text")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(F.transform(
                        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))
