"""The comparison with folds has every model."""

from helixmart.operators import ml
from helixmart.plans import queries


def test_boosted_trees_are_cross_validated(spark, tiny, monkeypatch):
    small = ml.classifiers(trees=6, rounds=4)
    monkeypatch.setattr(ml, "classifiers", lambda *_: small)
    board = {r["model"]: r for r in queries()["k18_cross_validated"](spark, tiny).collect()}
    assert set(board) == {"logistic", "random_forest", "boosted_trees"}
    assert all(0 < r["cv_mean"] <= 1 and r["cv_std"] is not None for r in board.values())
