"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop frequent lines, reassemble by position.

Only DataFrame functions. A line's key is the line without white space at its ends, with A-Z lower-cased. A key of at
least ``min_chars`` code points that at least ``min_docs`` documents hold loses all its lines, except in the document
with the largest id that holds it.

Scale: only the 16-byte digests of long lines are shuffled for counting (one per document and key, summed before the
shuffle), then (id, position) pairs of frequent lines, then each text once. A key that a third of all documents share is
one row per task after the map-side sum; in the join against the frequent keys, adaptive execution splits its partition.

Defined results: a null or empty text is one empty line. Every row is a document, so repeated rows count as often as they
occur; rows that tie on the largest id all keep the line. A null id is below every other id; where all holders have null
ids, all keep. Extra columns pass through unchanged, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plethora.llm.common import SPACE_CHARS, ascii_lower, column, packed, staged, table

MIN_CHARS, MIN_DOCS = 40, 5


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: row (all other columns), id, lines (array), dropped (positions, null if none)."""
    text = F.coalesce(column(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    key = lambda line: ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))
    # Shorter lines than min_chars can't have a long key; this cheap test comes before the key is made.
    digest = lambda line: F.when(F.char_length(line) >= min_chars, F.when(F.char_length(key(line)) >= min_chars, F.unhex(F.md5(key(line)))))
    me = [column(id_col).alias("id"), F.xxhash64(text).alias("th")]
    digests = docs.select(*me, F.transform(lines, digest).alias("digests"))

    frequent = (
        digests.select("id", F.explode(F.array_distinct(F.filter("digests", lambda d: d.isNotNull()))).alias("digest"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("digest", "last")
    )
    # As a table of its own it is dealt out anew for the join, so that adaptive execution can split a hot key's partition.
    frequent = staged(frequent, "frequent")
    dropped = (
        digests.select("id", "th", F.posexplode("digests").alias("pos", "digest"))
        .where(F.col("digest").isNotNull())
        .join(frequent, "digest")
        .where(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("id", "th")
        .agg(F.array_distinct(F.collect_list("pos")).alias("dropped"))
        .withColumnsRenamed({"id": "d_id", "th": "d_th"})
    )
    # The lines, not the text, go through the join, so that no expression splits the text once a line.
    whole = docs.select(packed(docs, text_col).alias("row"), *me, lines.alias("lines"))
    return whole.join(dropped, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th")), "left").select("row", "id", "lines", "dropped")


def kept_text(lines: str = "lines", dropped: str = "dropped"):
    """The lines that stay, in their order."""
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    some = F.transform(at, lambda i: F.get(F.col(lines), i))
    return F.when(F.col(dropped).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(some, "\n"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines gone from the text; the columns and their order stay. A null text stays null."""
    flagged = docs.select(packed(docs, text_col).alias("row"), column(id_col).alias("id"), column(text_col).alias("text"))
    flagged = flagged.withColumn("null_text", F.col("text").isNull())
    marked = mark_lines(flagged, "id", "text", min_chars, min_docs)
    text = F.when(~F.col("row.null_text"), kept_text())
    return marked.select(*[text.alias(c) if c == text_col else F.col("row.row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_lines(docs).select(
        F.col("id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
