"""Chat formatting: budgeted windows over the turns of a conversation.

Only DataFrame functions. Prefix sums of the turns' tokens cut a conversation into spans of whole turns within a budget.
The first window holds the first span; each later one repeats the system turn (a leading turn of that role) and a limited
history (up to ``HISTORY_TURNS`` turns of up to ``HISTORY`` tokens together), then its own span. Assistant texts of the own
span are under the loss mask; what is repeated is masked, so each assistant text is learned from once.

A turn is written ``<|role|>\\n text <|end|>\\n`` without the spaces. Control strings inside roles and texts, of this template
and of other common ones, are escaped by entities, and entities by ``&amp;``; ``unescape`` reverses this exactly.

Scale: conversations are grouped by id once; a window's text is made inside that group and holds at most the budget plus
one turn (and the system turn, where that alone is beyond the budget). A conversation is a unit of its own (its turns are in
order), so its turns meet in one task. A turn of more tokens than the budget gets a window of its own.

Defined results: null roles and texts count as empty, null turns come first, rows that tie on the turn follow each other
by role and text, repeated rows are turns of their own; a row of a null id is a conversation of its own. Extra columns are
ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plethora.llm.common import column, table

BUDGET, HISTORY, HISTORY_TURNS, OVERHEAD = 512, 128, 2, 4
#: A token, about: a run of ASCII letters, digits and underscores, or another character that is no white space.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]"
# Control strings start with one of these, and the entities that stand for the first character.
ESCAPES = ((r"&(amp;|lt;|gt;|#91;)", "&amp;", 1), (r"<(\||/?s>|</?SYS>>)", "&lt;", 1), (r"\|>", "|&gt;", 0), (r"\[(/?INST\])", "&#91;", 1))
END = "<|end|>\n"


def escape(c: Column) -> Column:
    for pattern, entity, group in ESCAPES:
        c = F.regexp_replace(c, pattern, entity + "$1" * group)
    return c


def unescape(c: Column) -> Column:
    for entity, char in (("&#91;", "["), ("|&gt;", "|>"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)) + OVERHEAD


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, windows: array of formatted, n_context (turns that are repeated), tokens, loss (array of start, end: code points of formatted)."""
    role, text = (F.coalesce(column(c), F.lit("")) for c in (role_col, text_col))
    head = F.concat(F.lit("<|"), escape(role), F.lit("|>\n"))
    turn = F.struct(column(turn_col).alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"), count_tokens(text).alias("tokens"))
    alone = F.when(column(conv_col).isNull(), F.monotonically_increasing_id())  # rows that name no conversation don't meet in one
    rows = turns.select(column(conv_col).alias("conv_id"), alone.alias("alone"), turn.alias("t"))
    convs = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns")).drop("alone")
    system = F.get("turns", 0)["role"] == "system"
    convs = convs.withColumns({"system": system, "room": F.greatest(F.lit(1), budget - history - F.when(system, F.get("turns", 0)["tokens"]).otherwise(0))})

    # done: prefix sum of tokens up to the turn; base: the same at the start of the span; the system turn counts apart.
    def step(s: Column, i: Column) -> Column:
        tokens = F.when((i == 0) & F.col("system"), 0).otherwise(F.get("turns", i)["tokens"])
        cut = (s["done"] + tokens - s["base"] > F.col("room")) & (s["done"] > s["base"])
        return F.struct((s["done"] + tokens).alias("done"), F.when(cut, s["done"]).otherwise(s["base"]).alias("base"), F.when(cut, F.array_append(s["starts"], i)).otherwise(s["starts"]).alias("starts"))

    first = F.struct(F.lit(0).alias("done"), F.lit(0).alias("base"), F.array(F.lit(0)).alias("starts"))
    convs = convs.withColumn("starts", F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), first, step)["starts"])

    def window(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        least = F.when(F.col("system"), 1).otherwise(0)
        back = F.size(F.filter(F.sequence(F.lit(1), F.lit(HISTORY_TURNS)), lambda h: (start - h >= least) & (F.aggregate(F.slice("turns", F.greatest(start - h, F.lit(0)) + 1, h), F.lit(0), lambda a, t: a + t["tokens"]) <= history)))
        context = F.when(k > 0, F.concat(F.slice("turns", 1, least), F.slice("turns", start - back + 1, back))).otherwise(F.slice("turns", 1, 0))
        return F.struct(context.alias("context"), F.slice("turns", start + 1, end - start).alias("own"))

    # Bounded by the budget: a window has few turns.
    def written(w: Column) -> Column:
        every = F.concat(w["context"], w["own"])
        line = lambda t: F.concat(t["head"], t["body"], F.lit(END))

        def mark(s: Column, t: Column) -> Column:
            start = s["at"] + F.char_length(t["head"])
            end = start + F.char_length(t["body"])
            found = F.array_append(s["loss"], F.struct(start.alias("start"), end.alias("end")))
            return F.struct((end + len(END)).alias("at"), F.when(t["role"] == "assistant", found).otherwise(s["loss"]).alias("loss"))

        before = F.aggregate(w["context"], F.lit(0), lambda a, t: a + F.char_length(line(t)))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct(
            F.array_join(F.transform(every, line), "").alias("formatted"),
            F.size(w["context"]).alias("n_context"),
            F.aggregate(every, F.lit(0), lambda a, t: a + t["tokens"]).alias("tokens"),
            F.aggregate(w["own"], F.struct(before.alias("at"), none.alias("loss")), mark)["loss"].alias("loss"),
        )

    return convs.select("conv_id", F.transform("starts", window).alias("spans")).select("conv_id", F.transform("spans", written).alias("windows"))


def format_chat(turns: DataFrame, **options) -> DataFrame:
    """conv_id, window_no, formatted, n_context, tokens, loss: one row per window."""
    return windows(turns, **options).select("conv_id", F.posexplode("windows").alias("window_no", "w")).select("conv_id", "window_no", "w.*")


def read_turns(w: Column) -> Column:
    """role, text of the turns of a window that aren't repeated, parsed from what is written."""
    parts = F.split(w["formatted"], r"<\|end\|>\n", -1)
    own = F.slice(parts, w["n_context"] + 1, F.size(parts) - 1 - w["n_context"])

    def parsed(part: Column) -> Column:
        role = F.substring_index(part, "|>\n", 1)
        text = F.substring(part, F.char_length(role) + 4, F.char_length(part))
        return F.struct(unescape(F.substring(role, F.lit(3), F.char_length(role))).alias("role"), unescape(text).alias("text"))

    return F.transform(own, parsed)


def read_loss(w: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(w["loss"], lambda s: unescape(F.substring(w["formatted"], s["start"] + 1, s["end"] - s["start"])))


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    made = windows(rows.unionByName(extra))
    back = made.select(
        "conv_id",
        F.flatten(F.transform("windows", read_turns)).alias("turns"),
        F.array_join(F.flatten(F.transform("windows", read_loss)), "").alias("loss"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w["formatted"])).alias("formatted_chars"),
    )
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def _sql_escape(c: str) -> str:
    for pattern, entity, group in ESCAPES:
        c = f"regexp_replace({c}, '{pattern}', '{entity}{chr(92)}1', 'g')" if group else f"replace({c}, '|>', '{entity}')"
    return c


SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
  len(regexp_extract_all(text, '{TOKEN}')) + {OVERHEAD} AS tokens, length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len("<||>") + 1 + len(END)} AS chars FROM c),
h AS (SELECT *, first_value(role = 'system') OVER o AS sys, CASE WHEN first_value(role = 'system') OVER o THEN first_value(tokens) OVER o ELSE 0 END AS sys_tokens,
  CASE WHEN first_value(role = 'system') OVER o THEN first_value(chars) OVER o ELSE 0 END AS sys_chars, lag(tokens, 1) OVER o AS t1, lag(tokens, 2) OVER o AS t2, lag(chars, 1) OVER o AS c1, lag(chars, 2) OVER o AS c2
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT conv_id, i, CASE WHEN i = 0 AND sys THEN 0 ELSE tokens END AS done, 0 AS base, FALSE AS cut FROM h WHERE i = 0
  UNION ALL SELECT h.conv_id, h.i, g.done + h.tokens, CASE WHEN x.cut THEN g.done ELSE g.base END, x.cut
  FROM g JOIN h ON h.conv_id = g.conv_id AND h.i = g.i + 1,
  LATERAL (SELECT g.done + h.tokens - g.base > greatest(1, {BUDGET - HISTORY} - h.sys_tokens) AND g.done > g.base AS cut) x),
k AS (SELECT h.*, g.cut, CASE WHEN g.cut AND i - 1 >= sys::INT AND t1 <= {HISTORY} THEN c1 ELSE 0 END AS back1,
  CASE WHEN g.cut AND i - 2 >= sys::INT AND t1 + t2 <= {HISTORY} THEN c2 ELSE 0 END AS back2 FROM h JOIN g USING (conv_id, i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + sum(CASE WHEN cut THEN sys_chars + back1 + back2 ELSE 0 END))::BIGINT AS formatted_chars
FROM k GROUP BY conv_id
"""
