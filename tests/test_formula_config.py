import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spreadwatch.functions.formula import FormulaError, compile_formula, names_in, number, undeclared
from spreadwatch.sources.config import AlertRule, Catalogue, ConfigError, Linkage, Pair, Universe, dump_universe, load_catalogue, load_universe, load_universes

LEGS = {"a": ("A", "t"), "b": ("B", "t")}


def link(**more):
    return Linkage(**{"id": "x", "description": "", "category": "validation", "legs": LEGS, "fair_value": "b * k", "reference": "a", "params": {"k": 2.0}} | more)


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "a[0]", "f(a)", "a if b else c", "lambda: 1", "a < b", "'x'", "True", "[1]", "a; b", "", "a @ b", "a // b", "a % b", "x := 1"])
def test_refuses_everything_but_arithmetic(text):
    with pytest.raises(FormulaError):
        names_in(text)


def test_names_and_undeclared():
    assert names_in("spot * fx / 31.1035 * (1 + duty) ** -2") == {"spot", "fx", "duty"}
    assert undeclared("a * q", ["a"]) == {"q"}
    with pytest.raises(FormulaError):
        compile_formula("q", {})


def test_number_is_exact_and_refuses_bool():
    assert number(0.1) == Decimal("0.1")
    for bad in (True, "1", None):
        with pytest.raises(FormulaError):
            number(bad)


def test_compiles_to_columns(spark):
    df = spark.createDataFrame([(10.0, 4.0), (1.0, 0.0)], "a double, b double")
    out = df.select(
        compile_formula("-a + b ** 2 * k", {"a": F.col("a"), "b": F.col("b")}, {"k": 0.5}).alias("x"),
        compile_formula("a / b", {"a": F.col("a"), "b": F.col("b")}).alias("y"),
        compile_formula("a + 0.1 + 0.2", {"a": F.col("a")}, decimal=(18, 6)).alias("z"),
    ).collect()
    assert [(r.x, r.y, r.z) for r in out] == [(-2.0, 2.5, Decimal("10.300000")), (-1.0, None, Decimal("1.300000"))]


def test_linkage_checks():
    assert link(friction_bps={"x": 1.5, "y": 2.0}).total_friction == 3.5
    for bad in ({"legs": {"a": ("A", "t")}}, {"reference": "q"}, {"category": "odd"}, {"fair_value": "b * typo"}):
        with pytest.raises(ConfigError):
            link(**bad)
    for bad in ({"warn_z": 3.0}, {"min_net_edge_bps": -1.0}, {"cooldown_minutes": 0}):
        with pytest.raises(ConfigError):
            AlertRule(**bad)


def test_fingerprint_follows_meaning_only():
    base = link().fingerprint
    assert len(base) == 16
    assert link(friction_bps={"x": 9.0}, alert=AlertRule(1.0, 2.0)).fingerprint == base
    assert link(params={"k": 2.1}).fingerprint != base
    assert link(kalman_delta=1e-10).fingerprint != base


def test_universe_and_files(tmp_path):
    u = Universe((link(), link(id="y", legs=LEGS | {"c": ("C", "other")})))
    assert u.symbols_for("t") == ["A", "B"] and u.providers() == {"t", "other"} and u.by_id("y").id == "y"
    with pytest.raises(ConfigError):
        u.merged(Universe((link(),)))
    one, two = tmp_path / "u.json", tmp_path / "v.yaml"
    one.write_text(dump_universe(u))
    two.write_text("anything: 1\nlinkages:\n")
    assert load_universe(one) == u and load_universes([one, two]) == u
    assert "nothing" in json.loads(dump_universe(Universe()))["note"]


def test_catalogue(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("pairs:\n  - {id: p, group: fx, a: X, b: Y, access: full}\n")
    assert load_catalogue(path).symbols() == ["X", "Y"]
    with pytest.raises(ConfigError):
        Pair("p", "fx", "X", "X", "full")
    with pytest.raises(ConfigError):
        Catalogue((Pair("p", "g", "X", "Y", "none"), Pair("p", "g", "X", "Z", "none")))


def test_fingerprints_in_columns_are_those_of_declarations(spark):
    from pyspark.sql import functions as F

    from spreadwatch.sources.config import fingerprint_of

    links = [Linkage(f"l{i}", "", "validation", {"b": ("B", "u"), "a": ('A"', "t")}, "b * k + z", "a", {"z": 0.5, "k": 1234.25 + i}, kalman_delta=delta) for i, delta in enumerate((None, 0.25))]
    frame = Universe(tuple(links)).frame(spark)
    got = frame.select("linkage_id", fingerprint_of(*[F.col(c) for c in ("fair_value", "legs", "params", "reference", "kalman_delta")]).alias("f")).collect()
    assert {r.linkage_id: r.f for r in got} == {x.id: x.fingerprint for x in links}
