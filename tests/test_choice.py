"""Candidates are run as a whole before one is chosen."""

from types import SimpleNamespace

from askweave.plans.engine import Engine
from askweave.plans.selection import PLACEHOLDER, choose
from askweave.sources.catalog import Catalog


def _engine(spark, frames):
    return SimpleNamespace(spark=spark, catalog=Catalog({}), sql=lambda text: frames[text])


def test_candidate_that_fails_on_a_later_row_is_passed_over(spark):
    frames = {"bad": spark.range(0, 1000, 1, 1).selectExpr("if(id = 999, raise_error('late'), id) as x"), "good": spark.range(3)}
    assert choose(_engine(spark, frames), ["bad", "good"], shorthand=False) == (1, "good")
    assert choose(_engine(spark, frames), ["bad"], shorthand=False) == (-1, PLACEHOLDER)


def test_candidate_that_is_slow_after_its_first_row_is_passed_over(spark):
    slow = spark.range(0, 20_000_000_000, 1, 2).selectExpr("sqrt(id) * sin(id) * cos(id) as s")
    assert choose(_engine(spark, {"slow": slow, "good": spark.range(3)}), ["slow", "good"], shorthand=False, seconds=3) == (1, "good")


def test_equal_names_and_empty_results_are_fine(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    assert choose(engine, ["select n_name, n_name, null from nation"], shorthand=False)[0] == 0
    assert choose(engine, ["select n_name from nation where n_nationkey < 0"], shorthand=False)[0] == 0
