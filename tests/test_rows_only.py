"""Queries without an SQL oracle (fits, selection, search, curves) run end to end on sf0.001."""

import sys

import pytest

sys.path.insert(0, ".")

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert len(rows) > 0
    assert len(df.columns) == len(set(df.columns))


def test_nested_cv_invariants(spark):
    from earlywarn.operators.models import GRIDS
    from earlywarn.plans import q_models as qm

    models = {m: GRIDS[m] for m in ("Dummy Baseline", "Logistic Regression", "Decision Tree")}
    oof, fm, chosen = qm._ncv(spark, SF, models)
    n = qm._learners(spark, SF).count()
    per_model = {r.model: r["count"] for r in oof.groupBy("model").count().collect()}
    assert set(per_model.values()) == {n}  # one OOF row per (row, model)
    assert oof.select("model", "row_id").distinct().count() == oof.count()
    assert fm.count() == 3 * 5 and chosen.count() == 3 * 5


def test_selection_queries_run_the_whole_grid(spark, monkeypatch):
    """Families, candidates, folds and trials handed to the operators."""
    from earlywarn.operators.models import GRIDS
    from earlywarn.plans import q_models as qm

    class Stop(Exception):
        pass

    calls = []

    def stub(*args, **kwargs):
        calls.append((args, kwargs))
        raise Stop

    for name in ("nested_cv", "nested_cv_folds", "grid_search", "random_search", "fit_final"):
        monkeypatch.setattr(qm.va, name if name != "nested_cv_folds" else "nested_cv", stub)
        for _ in range(2):  # a second call does its own work
            with pytest.raises(Stop):
                getattr(qm, name)(spark, SF)
    assert len(calls) == 10 and sum(map(len, GRIDS.values())) == 43
    nested, folds, grid, trials, final = calls[::2]
    for call in (nested, folds):
        assert call[0][1] == GRIDS and call[1] == {"outer": 5, "inner": 5}
    assert grid[0][1:] == ("Logistic Regression", GRIDS["Logistic Regression"])
    assert grid[0][0].select("fold").distinct().count() == 5
    assert trials[1] == {"n_trials": 30, "folds": 5}
    assert final[0][2] == GRIDS["Logistic Regression"] and final[1] == {"folds": 5}
