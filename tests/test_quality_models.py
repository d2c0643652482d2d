"""The feature table under every method, out of fold, against plain versions of scores and areas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plethora.operators import models as mo
from plethora.plans import QUERIES, kernel_queries as kq
from tests.conftest import SF

WIDE = SF.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def windows(spark):
    return kq._feature_windows(spark, WIDE)


def test_windows_hold_true_references(spark, windows):
    got = windows.toPandas()
    assert len(got) > 50 and got["id"].is_unique and set(got["subject"]) == set(range(5)) and (got["ae"] > kq.GOOD_MS).any()
    events = spark.read.parquet(f"{WIDE}/events.parquet").select("user_id", "ts", "event_id", "value").toPandas().sort_values(["user_id", "ts", "event_id"])
    for r in got.head(12).itertuples():
        rr = 900 + 6 * events.loc[events["user_id"] == r.rec, "value"].to_numpy()
        t = np.cumsum(rr) / 1000
        own = rr[(t >= 10 + 60 * r.win) & (t < 70 + 60 * r.win)]
        assert np.isclose(r.ref, np.sqrt(np.mean(np.diff(own) ** 2)))


def test_every_window_has_a_score_of_every_method(spark, windows):
    features = list(kq.re.FEATURES)
    s = mo.method_scores(kq._folds(spark, windows), features, "ae", F.col("ae") <= kq.GOOD_MS, {"gbm_no_rmssd": features[:-1]}, trees=3, alone=kq.ALONE)
    got = s.select("id", "subject", "method", "score").toPandas()
    methods = {*kq.ALONE, "logistic", "gbm", "gbm_no_rmssd", "oracle"}
    n = windows.count()
    assert set(got["method"]) == methods and len(got) == n * len(methods) and got.loc[got["method"] != "oracle", "score"].notna().all()
    # A single feature's sign comes from the rank correlation over the other subjects' labelled windows; gaps are worst.
    d = windows.toPandas()
    rank = lambda x: x.rank()
    for subject in range(5):
        tr = d[(d["subject"] != subject) & d["ae"].notna() & d["spec_purity"].notna()]
        sign = 1.0 if np.corrcoef(rank(tr["spec_purity"]), rank(tr["ae"]))[0, 1] <= 0 else -1.0
        te = d[d["subject"] == subject].set_index("id")["spec_purity"] * sign
        te = te.fillna(te.min() - 1)
        own = got[(got["method"] == "spec_purity") & (got["subject"] == subject)].set_index("id")["score"]
        assert np.allclose(own.sort_index(), te.sort_index())


def test_oracle_is_the_best_ranking(spark):
    got = {r["method"]: r for r in QUERIES["quality_models"].run(spark, WIDE).collect()}
    assert len(got) == 12 and all(got["oracle"]["aurc"] <= r["aurc"] + 1e-9 for r in got.values()) and got["oracle"]["gap_closed"] == 1
    assert max(got[m]["gap_closed"] for m in ("logistic", "gbm", "gbm_no_rmssd", "tmpl_corr_mean")) > 0.3
