from plethora.plans import QUERIES
from tests.conftest import SF


def test_as_many_draws_as_the_reference(spark):
    assert QUERIES["bootstrap_median_ci"].run(spark, SF).first()["reps"] == 1000
    assert [r["rep"] for r in QUERIES["bootstrap_kappa"].run(spark, SF).select("rep").orderBy("rep").collect()] == list(range(1000))
    assert QUERIES["tracking_bootstrap"].run(spark, SF).count() == 1000
    assert QUERIES["half_split_calibration"].run(spark, SF).count() == 200
