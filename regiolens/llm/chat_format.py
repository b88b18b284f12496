"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role form one block.  A conversation becomes

    <|role|>user<|text|>first<|next|>second<|end|><|role|>assistant<|text|>...<|end|>

and a list of pieces (``text``, ``loss``) whose concatenation is that string;
only the assistants' texts are under the loss mask.  Control strings (this
template's marks and those of common chat formats) inside roles and texts get a
backslash after their first character, and backslashes are doubled, so no text
can forge a mark and dropping one level of backslashes gives the text back.

Defined results: null roles and texts are empty; turns sort by (turn, role,
text), nulls first, and repeated rows stay repeated turns; rows with a null
conversation id form one conversation with a null id; a conversation is one
array in one task, so its length is bounded by memory, and many rows with a null
id make one long conversation; extra columns, whatever their names, are not
read; no rows give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolens.llm.common import table

# Control strings of common chat templates
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        c = F.replace(c, F.lit(x), F.lit(f"{x[0]}\\{x[1:]}"))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``pieces`` (array of text and loss)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("turn"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def pieces(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)["role"]
        mark = F.when(i == 0, F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT))) \
            .when(before == t["role"], F.lit(NEXT)) \
            .otherwise(F.concat(F.lit(END + ROLE), escape(t["role"]), F.lit(TEXT)))
        return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(t["text"]).alias("text"), (t["role"] == learn_role).alias("loss")))

    end = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    out = sorted_turns.select("conv_id", F.concat(F.flatten(F.transform("turns", pieces)), end).alias("pieces"))
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    parts = lambda b: F.split(b, r"<\|text\|>|<\|next\|>|<\|end\|>", -1)
    marked = F.split(formatted, r"<\|role\|>", -1)
    blocks = F.transform(F.slice(marked, F.lit(2), F.size(marked)), parts)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.slice(b, 2, F.size(b) - 2),
        lambda t: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), unescape(t).alias("text")))))


def op3_query(spark, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{planted}'), (-7L, 1L, 'assistant', '{planted}') "
                      "AS t(conv_id, turn, role, text)")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(chats).select("conv_id", "formatted", "pieces", read_back(F.col("formatted")).alias("turns"))
    learnt = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
               ).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), digest(learnt).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped_length(c: str) -> str:
    marks = ", ".join(f"'{x}'" for x in CONTROL)
    return (f"(2 * length({c}) - length(replace({c}, '\\', '')) + list_sum(list_transform([{marks}], "
            f"lambda s: (length({c}) - length(replace({c}, s, ''))) // length(s))))")


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
         {_escaped_length("role")} AS role_chars, {_escaped_length("text")} AS text_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST({len(END)} + sum(text_chars + CASE WHEN prev IS NULL THEN {len(ROLE + TEXT)} + role_chars
                                        WHEN prev = role THEN {len(NEXT)}
                                        ELSE {len(END + ROLE + TEXT)} + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
