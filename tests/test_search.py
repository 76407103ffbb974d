"""The raced search against the full one: same winner, fewer fits."""

import threading
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tabloom.plans import registry
from tabloom.plans.heuristics import ProblemType as P
from tabloom.plans.search import Trial, search, winner


class Guess:
    """Right on a share of the rows that the parameters name for each fold; counts fits and threads at work."""

    fits, at_work, most = 0, 0, 0
    lock = threading.Lock()

    def __init__(self, params, context):
        self.params = params

    def fit(self, df):
        with Guess.lock:
            Guess.fits += 1
            Guess.at_work += 1
            Guess.most = max(Guess.most, Guess.at_work)
        time.sleep(0.05)
        with Guess.lock:
            Guess.at_work -= 1
        if self.params.get("breaks") == df.first().fold:
            raise ValueError("broken")
        return self

    def transform(self, df):
        rights = F.array(*[F.lit(x) for x in self.params["right"]])
        hit = F.col("row") % 100 < F.element_at(rights, F.col("fold") + 1)
        off = F.when(hit, F.col("label")).otherwise(1 - F.col("label"))
        if self.params["kind"] is P.REGRESSION:
            off = F.when(hit, F.col("label")).otherwise(F.col("label") + 2)
        return df.withColumn("prediction", off)


def settle(spark, kind, rights, racing, breaks=None, parallel=4):
    spec = registry.Candidate("Guess", kind, Guess)
    other = registry.Candidate("Other", kind, Guess)
    trials = {
        "Guess": [Trial(spec, {"right": r, "kind": kind, "breaks": (breaks or {}).get(i)}) for i, r in enumerate(rights)],
        "Other": [Trial(other, {"right": [50] * 5, "kind": kind})],
    }
    rows = spark.range(200).select(
        F.col("id").alias("row"), (F.floor(F.col("id") / 100) % 2).cast("double").alias("label")
    )

    @contextmanager
    def fold(j):
        one = rows.withColumn("fold", F.lit(j))
        yield one, one

    Guess.fits = Guess.at_work = Guess.most = 0
    search(trials, fold, 5, registry.Context(200, 1), parallel, racing)
    return trials, Guess.fits


RIGHTS = [[60] * 5, [90] * 5, [30] * 5, [95, 92, 91, 90, 90], [10] * 5, [20, 100, 100, 100, 100]]


@pytest.mark.parametrize("kind", [P.CLASSIFICATION, P.REGRESSION])
def test_race_finds_the_winner_of_the_full_search_with_fewer_fits(spark, kind):
    full, all_fits = settle(spark, kind, RIGHTS, racing=False)
    raced, fits = settle(spark, kind, RIGHTS, racing=True)
    assert all_fits == 5 * (len(RIGHTS) + 1)
    assert fits <= all_fits * 0.8
    for name in full:
        assert winner(raced[name]).params == winner(full[name]).params
        assert winner(raced[name]).scores == winner(full[name]).scores
    best = winner(raced["Guess"]).mean
    for quick, slow in zip(raced["Guess"], full["Guess"]):
        assert quick.scores == slow.scores[: len(quick.scores)]
        assert quick.stopped == (len(quick.scores) < 5)
        assert not quick.stopped or slow.mean < best


def test_ties_go_to_the_first(spark):
    raced, _ = settle(spark, P.CLASSIFICATION, [[50, 90, 90, 90, 90], [90, 90, 90, 90, 50]], racing=True)
    # Both orders have the same mean; the second leads after the first fold, and the first is not stopped.
    assert not raced["Guess"][0].stopped
    assert winner(raced["Guess"]) is raced["Guess"][0]


def test_trial_that_fails_sets_no_bound(spark):
    raced, _ = settle(spark, P.CLASSIFICATION, [[50] * 5, [99] * 5, [60] * 5], racing=True, breaks={1: 3})
    assert raced["Guess"][1].failed is not None
    assert winner(raced["Guess"]) is raced["Guess"][2]
    raced, _ = settle(spark, P.CLASSIFICATION, [[50] * 5], racing=True, breaks={0: 0})
    with pytest.raises(ValueError, match="broken"):
        winner(raced["Guess"])
    assert winner(raced["Other"]).mean > 0


def test_trials_run_side_by_side_within_the_limit(spark):
    settle(spark, P.CLASSIFICATION, RIGHTS, racing=False, parallel=3)
    assert 1 < Guess.most <= 3
    settle(spark, P.CLASSIFICATION, RIGHTS[:2], racing=False, parallel=1)
    assert Guess.most == 1
