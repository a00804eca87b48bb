import math

import pytest

from placeworks.operators import enrolment


def test_pupils_are_conserved_and_told_by_hand(spark):
    fragments = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.5), (2, 0, 1.0), (3, 0, 1.0)], "bg long, home long, weight double")
    groups = spark.createDataFrame(
        [(1, 10.0, 4.0, 3, 1, 4, 100.0), (2, 20.0, 6.0, 1, 1, 2, 300.0), (3, 50.0, 50.0, 0, 0, 0, -666666666.0)], "bg long, old double, young double, white long, other long, everyone long, income double"
    )
    rows = enrolment.features(fragments, groups, ("white", "other"), "income")
    told = {(r.bg, r.home, r.race): r for r in rows.collect()}
    assert told[1, 3, "white"].old == pytest.approx(10 * 0.5 * 0.75) and told[1, 0, "white"].z == -1 and told[2, 0, "other"].z == 1
    assert told[3, 0, "white"].old == 0 and told[3, 0, "white"].z == 0  # nobody's race is known, no income either

    candidates = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0), (1, 2.0, 0.5, 1.0, 0.3), (2, 500.0, 0.0, 0.0, 4.0)], "candidate long, white_weight double, mu double, income_pull double, income_weight double")
    pulls = spark.createDataFrame([(c, r, 3, 0.5, True) for c in range(3) for r in ("white", "other")], "candidate long, race string, site long, pull double, by_income boolean")
    pool = enrolment.pooled(rows, candidates, 300.0, "white")
    moved = enrolment.flows(pool, pulls)
    for r in moved.groupBy("candidate").sum("flow").collect():
        assert r[1] == pytest.approx(270)
    # All weights 1: a tenth of each is lost, and the magnet draws e^0.5 to 1 from other zones, nothing from its own.
    got = {(r.bg, r.home, r.race, r.site): r.flow for r in moved.where("candidate = 0").collect()}
    stay = 300 * 20 * 0.5 / 30 * 0.9
    assert got[2, 0, "other", 3] == pytest.approx(stay * math.exp(0.5) / (1 + math.exp(0.5))) and got[1, 3, "white", 3] == pytest.approx(300 * 3.75 / 30 * 0.9)

    actual = spark.createDataFrame([(0, 100.0), (3, 170.0), (9, 5.0)], "site long, students double")
    # Nearly all who are lost are the white third of the rich group: 30 of 100. Four times that is more than there are.
    assert pool.where("candidate = 2").agg({"rate": "max"}).first()[0] == pytest.approx(0.3, abs=1e-3)
    scores = {r.candidate: r for r in enrolment.objective(pool, moved, actual).collect()}
    raised = {r.candidate: r for r in enrolment.objective(pool.selectExpr("candidate", "if(candidate = 2, 4, 1) * rate AS rate"), moved, actual).collect()}
    assert all(r.feasible and r.mae < 1e5 for r in scores.values()) and [raised[c].feasible for c in range(3)] == [True, True, False]
    assert raised[2].mae == pytest.approx(scores[2].mae + 1e5) and raised[2].rmse == pytest.approx(scores[2].rmse + 1e5)
