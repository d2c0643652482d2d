"""Secret scans: corpus-wide ownership frequency of candidate hashes.

Only DataFrame functions. Candidates of four kinds are cut from every whole text: ``assign`` (a keyword, a separator and a
value), ``access`` (AKIA keys), ``hex`` (long hexadecimal runs) and ``live`` (opaque mixed tokens). The hash of each
candidate's value is then counted over the corpus by distinct repositories and distinct owners. A value that several
owners hold is a widely copied example; a value of one owner looks live. Base spans (the first three kinds) always stay
and are only classed, and so do opaque tokens that overlap no base span (kind ``live``). ``query`` lists an opaque token
only where its value belongs to one owner alone, as its SQL does.

Scale: one scan cuts the matches; only they (lengths and a 16-byte hash) are written to the shared folder and shuffled,
never a text. Places and overlaps come from running sums and extremes, linear in a text's matches. Frequencies are summed per
hash, owner and repository before the shuffle. They are a table of their own when they are joined back, so that adaptive
execution splits the partition of an example key that a third of all documents hold.

Defined results: a null or empty text has no candidates. A null owner or repository counts as one owner or repository of
its own. Every row is judged by itself, repeated rows and null ids too. Offsets are code points, end exclusive. Extra
columns are ignored, whatever their names (``keep`` names what passes through, other than rid, repo, owner, pieces). An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plethora.llm.common import column, staged, table

# What the contract's patterns match.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
#: kind: pattern, group that holds the value, code points that the value has at least.
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24), "live": (OPAQUE, 0, 20)}
BASE = ("assign", "access", "hex")
#: A value that at most so many owners hold looks live.
MAX_OWNERS = 1


def _pieces(text: Column, kind: str) -> Column:
    """The leftmost non-overlapping matches as array of gap (code points since the match before), hit (its code points), good (whether it counts), hash (of its value)."""
    pattern, group, least = KINDS[kind]
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def piece(part: Column) -> Column:
        value = part["value"]
        good = F.char_length(value) >= least
        if kind == "live":  # an opaque token mixes capitals, small letters and digits
            good = good & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
        return F.struct(F.char_length(part["gap"]).alias("gap"), F.char_length(part["hit"]).alias("hit"), good.alias("good"), F.unhex(F.md5(value)).alias("hash"))

    found = F.transform(F.filter(parts, lambda part: part["hit"].isNotNull()), piece)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<gap:int,hit:int,good:boolean,hash:binary>>"))


def cuts(docs: DataFrame, text_col: str, repo: Column, owner: Column, *keep: Column) -> DataFrame:
    """One row per document in the shared folder: rid, keep..., repo, owner, pieces (array of rank, pieces of that kind). No text is in it."""
    text = F.coalesce(column(text_col), F.lit(""))
    every = F.array(*[F.struct(F.lit(i).alias("rank"), _pieces(text, kind).alias("found")) for i, kind in enumerate(KINDS)])
    some = F.filter(every, lambda kind: F.exists(kind["found"], lambda x: x["good"]))
    return staged(docs.select(F.monotonically_increasing_id().alias("rid"), *keep, repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), some.alias("pieces")), "cuts")


def candidates(cut: DataFrame) -> DataFrame:
    """One row per span in the shared folder: rid, repo, owner, rank, start, end, hash. Opaque tokens that overlap a base span are left out.

    Places are running sums over a document's matches, and overlaps are told by the furthest end before and the next start after
    a token, so the work grows with the number of matches alone.
    """
    rows = cut.where(F.size("pieces") > 0).select("rid", "repo", "owner", F.explode("pieces").alias("kind"))
    rows = rows.select("rid", "repo", "owner", "kind.rank", F.posexplode("kind.found").alias("pos", "x")).select("rid", "repo", "owner", "rank", "pos", "x.*")
    rows = rows.repartition("rid")  # one shuffle for all three windows
    upto = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("rid", "rank").orderBy("pos")).cast("int")
    placed = rows.withColumn("end", upto).where("good").select("rid", "repo", "owner", "rank", (F.col("end") - F.col("hit")).alias("start"), "end", "hash")
    base, sofar = F.col("rank") < len(BASE), (Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("rid").orderBy("start").rangeBetween(*sofar))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("rid").orderBy(F.desc("start")).rangeBetween(*sofar))  # backwards: a frame that ends at the last row would be read anew for each row
    marked = placed.withColumns({"before": before, "after": after})
    apart = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    return staged(marked.where(base | apart).drop("before", "after"), "candidates")


def ownership(cands: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos: by how many distinct owners and repositories each candidate value is held."""
    nullable = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    by_repo = cands.groupBy("hash", nullable("owner").alias("owner"), nullable("repo").alias("repo")).agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"))


def scan(docs: DataFrame, text_col: str, repo: Column, owner: Column, *keep: Column, max_owners: int = MAX_OWNERS) -> DataFrame:
    """keep... and spans: array of start, rank, kind, end, n_owners, n_repos, live; every candidate of every kind, classed."""
    cut = cuts(docs, text_col, repo, owner, *keep)
    cands = candidates(cut)
    known = staged(ownership(cands), "ownership")
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("rank"))
    classed = (
        cands.join(known, "hash")
        .select("rid", F.struct("start", "rank", kind.alias("kind"), "end", "n_owners", "n_repos", (F.col("n_owners") <= max_owners).alias("live")).alias("c"))
        .groupBy("rid").agg(F.array_sort(F.collect_list("c")).alias("spans"))
        .withColumnRenamed("rid", "s_rid")
    )
    empty = F.array().cast(classed.schema["spans"].dataType)
    names = [c for c in cut.columns if c not in ("rid", "repo", "owner", "pieces")]
    return cut.join(classed, F.col("rid") == F.col("s_rid"), "left").select(*names, F.coalesce("spans", empty).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """A document is a repository, its source the owner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan(docs, "text", F.col("doc_id"), F.col("source"), F.col("doc_id"))
    # The contract's SQL lists an opaque token only where one owner holds it.
    found = found.withColumn("spans", F.filter("spans", lambda x: (x["kind"] != "live") | x["live"]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "live")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.size(F.filter(base, lambda x: x["live"])).cast("long").alias("n_owner_specific"),
        F.size(F.filter(base, lambda x: ~x["live"])).cast("long").alias("n_widely_copied"),
    )


def _sql_kind(kind: str) -> str:
    pattern, group, least = KINDS[kind]
    quoted = pattern.replace("'", "''")
    mixed = " AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')" if kind == "live" else ""
    return f"""
SELECT doc_id, source, {list(KINDS).index(kind)} AS rank, '{kind}' AS kind, before + length(gap) AS start, before + length(gap) + length(hit) AS stop, value FROM (
  SELECT doc_id, source, gap, hit, value, coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT doc_id, source, unnest(string_split_regex(text, '{quoted}')) AS gap, unnest(regexp_extract_all(text, '{quoted}')) AS hit,
           unnest(regexp_extract_all(text, '{quoted}', {group})) AS value, generate_subscripts(string_split_regex(text, '{quoted}'), 1) AS i
    FROM documents WHERE regexp_matches(text, '{quoted}')))
WHERE hit IS NOT NULL AND length(value) >= {least}{mixed}"""


SQL = f"""
WITH base AS ({" UNION ALL ".join(map(_sql_kind, BASE))}),
opaque AS ({_sql_kind("live")}),
c AS (SELECT * FROM base UNION ALL SELECT * FROM opaque o WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start < o.stop AND o.start < b.stop)),
f AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS n_owners FROM c GROUP BY value),
s AS (SELECT c.*, n_owners <= {MAX_OWNERS} AS live FROM c JOIN f ON c.value = f.value WHERE kind <> 'live' OR n_owners <= {MAX_OWNERS}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (kind <> 'live') AS base_spans,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (kind <> 'live' AND live) AS n_owner_specific, count(*) FILTER (kind <> 'live' AND NOT live) AS n_widely_copied
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_widely_copied, 0) AS n_widely_copied
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
