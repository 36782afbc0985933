"""Features of rankers are made once, with the same folds as everywhere."""

from rankloom.operators import split
from rankloom.plans import learned
from rankloom.plans.base import Base


def test_features_are_read_and_not_made_anew(spark):
    b = Base(spark, "/root/testdata/sf0.001")
    rows = learned.features(b)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    folds = {r.u: r.fold for r in split.folds(rows.select("u").distinct(), 2).collect()}
    found = rows.select("u", "fold", "id").collect()
    assert found and all(folds[r.u] == r.fold for r in found)
    assert len(found) == b.candidates().count()
