"""The comparison with SQL must notice what is easily mistaken."""

import ast
import inspect

import pytest
from pyspark.sql import functions as F

import footfall as ff
from catalog import adapter, expected, oracle, queries
from footfall import vocabulary as v
from footfall.plans import extracts as x
from tests.compare import differences
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.01"


def differs(spark, duck, name, frame=None):
    frame = queries.queries()[name](spark, SF) if frame is None else frame
    return differences(frame, duck("sf0.01").execute(oracle.oracle_sql()[name])) != ""


def test_the_sql_takes_nothing_from_the_library():
    for module in (oracle, expected):
        imports = [n for n in ast.walk(ast.parse(inspect.getsource(module))) if isinstance(n, (ast.Import, ast.ImportFrom))]
        names = {getattr(n, "module", None) or n.names[0].name for n in imports}
        assert not any(name.startswith(("footfall", "catalog.adapter", "catalog.queries")) for name in names)


@pytest.mark.parametrize("wrong, right, name", [
    ("logged_in_by_param", "logged_in_by_property", "report_explore"),
    ("logged_in_by_property", "logged_in_by_param", "report_sources"),
])
def test_the_other_user_id_is_noticed(spark, duck, monkeypatch, wrong, right, name):
    assert not differs(spark, duck, name)
    monkeypatch.setattr(x, right, getattr(x, wrong))
    assert differs(spark, duck, name)


def test_filters_of_steps_on_installs_are_noticed(spark, duck):
    spec = queries.NEW_FILTERED
    t = adapter.tables(spark, SF)
    kept = t.events.where(F.col("app_info.version").isin(list(spec.app_version)))
    others = ff.FilterSpec(start=spec.start, end=spec.end, install_type=spec.install_type, country=spec.country)
    assert differs(spark, duck, "report_new_user_filtered", ff.new_user_onboarding(kept, others))


@pytest.mark.parametrize("name, listed", [("filter_screen_in", "ONBOARDING_SCREENS"), ("filter_web_events", "WEB_EVENTS")])
def test_a_wrong_name_is_noticed(spark, duck, monkeypatch, name, listed):
    monkeypatch.setattr(v, listed, (*getattr(v, listed)[:-1], "misspelt"))
    assert differs(spark, duck, name)
