from dataclasses import replace

import pytest

from gleanery.params import RANKING, Gate, Ranking
from gleanery.plans import curation


def test_the_defaults_hold_and_can_not_be_changed():
    assert Ranking().problems() == []
    assert sum(RANKING.preliminary.values()) == pytest.approx(1) and sum(RANKING.utility.values()) == pytest.approx(1)
    with pytest.raises(AttributeError):
        RANKING.deep_keep = 3
    with pytest.raises(TypeError):
        RANKING.utility["knn"] = 1


@pytest.mark.parametrize(
    "change",
    [
        {"deep_keep": 59}, {"shortlist_keep": 19}, {"hard_most": 19}, {"knn_gate": Gate(8, 8)}, {"feed_gate": Gate(-1, 4)}, {"affinity_gate": Gate(9, 4)}, {"slop_author_penalty": 1.1}, {"cluster_threshold": -0.1},
        {"per_cluster": 0}, {"half_life_days": 0.0}, {"half_life_days": float("nan")}, {"preliminary": {"knn": float("inf")}}, {"utility": {"knn": -0.1}}, {"knn_quota": -1}, {"target": 0},
    ],
)
def test_a_set_that_can_not_work_is_refused(change):
    with pytest.raises(ValueError):
        replace(RANKING, **change).validate()


def test_the_sql_has_the_same_numbers_written_out():
    assert {k: float(v) for k, v in curation.SQL_BLEND.items()} == dict(RANKING.preliminary)
    assert {k: float(v) for k, v in curation.SQL_UTILITY.items()} == dict(RANKING.utility)


def test_affinity_leaves_unrated_interests_out(spark):
    matches = spark.createDataFrame([(1, 10, 3.0), (1, 11, 1.5), (1, 12, 2.0), (2, 12, 2.0), (3, 10, -1.0), (4, 10, 9.0)], "left_id long, right_id long, z double")
    rates = spark.createDataFrame([(10, 4, 0.8), (11, 2, 0.2), (12, 0, 0.5)], "right_id long, n long, rate double")
    got = {r.article_id: r.affinity for r in curation.affinities(matches, rates).collect()}
    assert got == {1: pytest.approx((0.3 - 0.5 * 0.3) / 1.5), 4: pytest.approx(0.3)}


def test_a_reported_author_costs_three_quarters_and_closed_gates_leave_signals_out(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0.5, 1.0, 0.0, False), (2, 0.5, 1.0, 1.0, False), (3, 0.5, 1.0, 1.0, True), (4, None, None, 1.0, False)], "id long, interest double, knn double, knn_gate double, slop boolean")
    mean = curation.gated_mean({"interest": 0.3, "knn": 0.25}, {"interest": F.col("interest"), "knn": F.col("knn")}, RANKING.slop_author_penalty)
    got = {r.id: r.m for r in rows.select("id", mean.alias("m")).collect()}
    assert got == {1: pytest.approx(50), 2: pytest.approx(100 * 0.4 / 0.55), 3: pytest.approx(25 * 0.4 / 0.55), 4: None}
