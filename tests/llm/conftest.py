import pytest

#: Names that the operators use themselves, or that need quoting.
CLASHING = {"row": "r", "id": "i", "lines": "l", "digest": "d", "key": "k", "spans": "s", "rid": 1, "node": "n", "text.x": "t", "g_id": 5, "letter": True, "source key": "sk"}


@pytest.fixture(scope="session")
def odd(spark):
    """doc_id, text, lang, source and columns of clashing names: nulls, empty and long texts, ties, repeated rows."""
    from pyspark.sql import functions as F

    long_text = "the quick brown fox jumps over it again and again " * 6000 + "x" * 70000
    rows = [
        (1, "a shared line that is longer than forty characters\nown line one", "en", "s1"), (2, "A Shared line that is longer than forty characters \nown two", "en", "s1"),
        (3, "a shared line that is longer than forty characters", "de", None), (4, "a shared line that is longer than forty characters\n\n", None, "s2"),
        (5, "\ta shared line that is longer than forty characters\nx", "en", "s1"), (5, "\ta shared line that is longer than forty characters\nx", "en", "s1"),
        (6, None, "en", "s1"), (7, "", "fr", "s1"), (8, "   \n\t ", "fr", "s2"), (9, long_text, "en", "s1"), (10, long_text + " end", "en", "s1"),
        (None, "no id here", "en", "s1"), (None, "no id here", "en", "s1"), (11, "no id  here", None, None), (12, "!!! 123 ???", "en", "s1"), (12, "another text with the same id", "en", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name, value in CLASHING.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture
def skewed(spark):
    """Settings under which adaptive execution splits the hot keys of small tables; counts the splits of a frame's plan once it has run."""
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1kb", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2kb",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.maxPartitionBytes": "50kb"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)

    def splits(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("skew=true")

    yield splits
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
