"""Mixing sources to target weights: Poisson replication.

Only DataFrame functions. A source's mean repetition rate is its target share of the mix over its share of the corpus (in
code points). Each document's count is the inverse of the Poisson distribution with that mean at a uniform number hashed
from the seed and its id; the document is exploded into so many copies, and the copies are shuffled globally: a hashed
key decides both the partition and the place within it, so all copies are in the order of ``mix_key``.

Scale: one sum per source (map side first) gives the rates, a table of a row per source that is broadcast only while it
has at most ``BROADCAST`` rows; beyond that it is joined, and adaptive execution splits the partition of a hot source.
Texts are shuffled once, by a uniform key, so a source with a third of all rows spreads evenly.

Defined results: a null source is a source of its own. Without given weights a source's target is the power
``TEMPERATURE`` of its size. A source that the given weights don't name gets no copies; one without any text keeps each
document once. Rows with equal ids get equal counts; of a null id the text is hashed instead. Texts of any length only add to their
source's sum and pass through, as do extra columns, whatever their names. An empty table stays empty. Copies of rows with one id (or
with no id and one text) lie in one task, beside each other in the order of ``mix_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plethora.llm.common import column, packed, shuffle_parts, staged, table

TEMPERATURE, EPOCHS, SEED = 0.5, 1.0, "mix"
BROADCAST = 100_000
#: Larger means are split into as many draws of at most this mean, so that exp(-mean) stays a normal number.
LARGEST = 500.0


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """source, rate: the mean number of copies of each of its documents, for a mix of epochs times the corpus."""
    size = F.sum(F.coalesce(F.char_length(column(text_col)), F.lit(0))).cast("double")
    sizes = docs.groupBy(column(source_col).cast("string").alias("source")).agg(size.alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, w double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "size", F.coalesce("w", F.lit(0.0)).alias("weight"))
    whole = sizes.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.lit(epochs) * (F.col("weight") / F.col("all_weight")) * F.col("all_size") / F.col("size")
    return sizes.crossJoin(F.broadcast(whole)).select("source", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))  # whole is one row


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _uniform(hashed: Column) -> Column:
    """52 bits of a hash as a number between 0 and 1, ends excluded."""
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _inverse(mean: Column, u: Column) -> Column:
    """The least k at which the Poisson distribution function of this mean reaches u."""
    most = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.when(state["c"] < u, F.struct(k.alias("k"), p.alias("p"), (state["c"] + p).alias("c"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["k"]


def poisson(mean: Column, seed: str, key: Column) -> Column:
    """A Poisson number of this mean, hashed from the seed and the key."""
    parts = F.ceil(mean / LARGEST).cast("int")
    draw = lambda i: _inverse(mean / parts, _uniform(_hash(seed, key, i.cast("string"))))
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda total, i: total + draw(i))
    return F.when(mean <= 0, 0).when(mean <= LARGEST, _inverse(mean, _uniform(_hash(seed, key, "1")))).otherwise(many)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """row (all columns), n_copies, copy_no (from 1), mix_key; in the order of mix_key."""
    known = staged(rates(docs, source_col, text_col, weights, temperature, epochs), "rates").select(F.col("source").alias("r_source"), "rate")
    known = F.broadcast(known) if known.count() <= BROADCAST else known
    key = F.coalesce(column(id_col).cast("string"), F.md5(F.coalesce(column(text_col), F.lit(""))))
    rows = docs.select(packed(docs).alias("row"), key.alias("key"), column(source_col).cast("string").alias("source"))
    drawn = rows.join(known, F.col("source").eqNullSafe(F.col("r_source"))).select("row", "key", poisson(F.col("rate"), seed, F.col("key")).alias("n_copies"))
    copies = drawn.where("n_copies > 0").select("row", "key", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    place = F.conv(F.substring(_hash(seed, "place", F.col("key"), F.col("copy_no").cast("string")), 1, 15), 16, 10).cast("long")
    parts = shuffle_parts(docs.sparkSession)
    part = F.floor(F.col("mix_key") / F.lit(float(1 << 60)) * parts).cast("int")
    return copies.select("row", "n_copies", "copy_no", place.alias("mix_key")).repartitionById(parts, part).sortWithinPartitions("mix_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of docs alone."""
    return mix(docs, **options).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(*[F.col(f"row.{c}").alias(c) for c in docs.columns], "n_copies", "copy_no", "mix_key")


SQL = f"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
w AS (SELECT sum(size) AS all_size, sum(pow(size, {TEMPERATURE})) AS all_weight FROM s WHERE size > 0),
r AS (SELECT source, CASE WHEN size > 0 THEN {EPOCHS} * (pow(size, {TEMPERATURE}) / all_weight) * all_size / size ELSE 1.0 END::DOUBLE AS rate FROM s, w),
c AS (SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM r, range(0, 400) AS t(k)),
d AS (SELECT doc_id, source, text, (('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT doc_id, d.source, any_value(d.text) AS text, count(*) FILTER (c < u) AS n_copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY doc_id, d.source),
x AS (SELECT doc_id, source, text, n_copies::INT AS n_copies, unnest(range(1, n_copies + 1))::INT AS copy_no FROM n)
SELECT *, ('0x' || substr(md5('{SEED}:place:' || doc_id || ':' || copy_no), 1, 15))::BIGINT AS mix_key FROM x
"""
