"""Checks, reports and runners over planted claims."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import frame

from gristmill.operators import taxonomy
from gristmill.plans import process, scaffold
from gristmill.plans.battery import Study, boundary, power, run, run_increment
from gristmill.plans.process import Prereg, SealError, SealedSplit
from gristmill.plans.verdict import FAIL, INCONCLUSIVE, NA, PASS, REJECTED, SURVIVES, Check, Report
from gristmill.sources import priors


def check(outcome, blocking=True, id_="S4"):
    return Check(id_, "statistical", "x", outcome, blocking)


@pytest.mark.parametrize(("checks", "verdict"), [([], INCONCLUSIVE), ([check(PASS)], SURVIVES), ([check(PASS, False)], INCONCLUSIVE), ([check(PASS), check(FAIL, False)], SURVIVES), ([check(PASS), check(INCONCLUSIVE)], INCONCLUSIVE), ([check(INCONCLUSIVE), check(FAIL)], REJECTED)])
def test_fold(checks, verdict):
    r = Report("c").add(*checks)
    assert r.outcome == verdict and json.loads(r.to_json())["outcome"] == verdict and verdict in r.render()


def test_unknown_outcome_is_refused():
    with pytest.raises(ValueError):
        check("MAYBE")


def test_prereg_is_frozen_once(tmp_path):
    p = Prereg("a claim", implications=["x"])
    path = str(tmp_path / "p.json")
    p.freeze(path)
    assert Prereg.load(path).id == p.id
    with pytest.raises(FileExistsError):
        p.freeze(path)
    body = json.loads(open(path).read()) | {"cost_bp": 9.0}
    open(path, "w").write(json.dumps(body))
    with pytest.raises(ValueError):
        Prereg.load(path)


def test_declarations():
    assert process.p4_fill_convention("next-open").outcome == PASS and process.p4_fill_convention("same-close").outcome == FAIL
    assert process.p4_fill_convention("x").outcome == INCONCLUSIVE and process.p4_fill_convention(None).outcome == NA
    assert process.p5_external_facts([{"what": "n", "expected": 100.0, "observed": 101.0, "tol": 0.02}]).outcome == PASS
    assert process.p5_external_facts([{"what": "n", "expected": "a", "observed": "b"}]).outcome == FAIL
    assert process.p6_implications(["a", "b"], {"a": True, "b": False}).outcome == FAIL and process.p6_implications(["a"], {}).outcome == INCONCLUSIVE
    assert process.e4_cost_convention("touch", ["spread"]).outcome == FAIL and process.e4_cost_convention("mid", ["fee"]).outcome == FAIL
    assert process.e4_cost_convention("mid", ["fee", "spread"]).outcome == PASS


def test_hindsight():
    controls = [{"question": f"c{i}", "answer": "yes"} for i in range(4)]
    probes = [{"question": f"p{i}", "answer": "yes", "chance": 0.1} for i in range(5)]
    assert process.p8_hindsight(lambda q: "yes", probes, controls).outcome == FAIL
    assert process.p8_hindsight(lambda q: "yes" if q[0] == "c" else "no idea", probes, controls).outcome == PASS
    assert process.p8_hindsight(lambda q: "", probes, controls).outcome == INCONCLUSIVE
    assert process.p4_fill_convention(None, True).outcome == FAIL and process.p4_fill_convention("x", True).outcome == INCONCLUSIVE and process.p4_fill_convention(None, False).outcome == PASS
    assert process.p5_external_facts([{"what": "n", "expected": "3000", "observed": 3000}]).outcome == PASS
    assert process.p5_external_facts([{"what": "n", "expected": 1}]).outcome == INCONCLUSIVE
    lucky = process.p8_hindsight(lambda q: "yes", [{"question": "q", "answer": "yes", "chance": 0.5}], [])
    assert (lucky.outcome, lucky.blocking) == (INCONCLUSIVE, False)
    assert process.p8_hindsight(lambda q: 1 / 0, probes, []).outcome == PASS


def test_validator_control(spark):
    good = spark.createDataFrame([(1,), (2,)], "x int")
    broken = {"null": lambda d: d.withColumn("x", F.lit(None).cast("int"))}
    assert process.p7_validator_control(lambda d: d.where("x is null").isEmpty(), broken, good).outcome == PASS
    assert process.p7_validator_control(lambda d: True, broken, good).outcome == FAIL


def test_seal(spark, tmp_path):
    df = frame(spark, np.ones((6, 2)))
    from datetime import date

    seal = SealedSplit(date(2020, 1, 2), date(2020, 1, 4), str(tmp_path / "seal.json"))
    assert process.p9_seal_respected(df, ["ret"], seal).outcome == FAIL
    assert process.p9_seal_respected(seal.redact(df, ["ret", "mask"]), ["ret", "mask"], seal).outcome == PASS
    with pytest.raises(SealError):
        seal.part(df, "test")
    with pytest.raises(SealError):
        seal.assert_clean(df, ["ret"])
    seal.unseal({"a": 1}, "final")
    assert seal.part(df, "test").count() == 4 and seal.unseal({"a": 1}, "again")["reads"] == 2
    with pytest.raises(SealError):
        seal.unseal({"a": 2}, "tuned")


@pytest.mark.parametrize("at", [-2, -1, 0])
def test_boundary_names_the_step(at):
    sizes = {k: 0.01 + 0.0003 * k for k in range(-4, 2)} | {k: 0.3 + 0.1 * k for k in range(at + 1, 2)}
    got = boundary(sorted(sizes.items()), 0.001)
    assert got.statistic == at and (got.outcome == PASS) == (at == 0)
    assert power(sorted(sizes.items()), 0.001).outcome == PASS and power(sorted(sizes.items()), 10.0).outcome == INCONCLUSIVE


def planted(spark, noise, size=160, days=120):
    g = np.random.default_rng(5)
    state, ret, states = g.normal(size=size), np.zeros((days, size)), np.zeros((days, size))
    for t in range(days):
        ret[t] = 0.004 * state + 0.018 * g.normal(size=size)
        state = 0.88 * state + np.sqrt(1 - 0.88**2) * g.normal(size=size)
        states[t] = state
    signal = g.normal(size=(days, size)) if noise else states + 0.5 * g.normal(size=(days, size))
    return frame(spark, ret, signal=signal)


def test_noise_is_rejected_by_the_harness(spark):
    r = run(Study("noise", planted(spark, True), min_n=30), Prereg("noise", "none"), n_draws=40)
    assert r.outcome in (REJECTED, INCONCLUSIVE) and not any(c.id == "E1" for c in r.checks)


def test_honest_signal_runs_the_whole_battery(spark):
    df = planted(spark, False).withColumn("vol", F.abs("ret")).withColumn("volume", F.lit(1e6) + F.col("asset")).withColumn("trigger", F.coalesce(F.col("signal") > 2.0, F.lit(False)))
    df = df.withColumn("noise", F.rand(3)).withColumn("grp", (F.col("asset") % 3).cast("int"))
    s = Study(
        "states persist", df, horizon=3, covariates=["vol"], controls=["noise"], naive="vol", dollar_volume="volume", capital=1e5, trigger="trigger", group="grp", tradable_ret="ret", cost_bp=1.0,
        price_basis="mid", cost_components=["fee", "spread"], positive_control="signal", price_limit=0.06, fill_convention="next-open", retrained=False, claimed_strides=(2,), universe="csi_300",
        seed_metric=lambda i: 1.0 + 0.1 * (i % 5), reported_metric=1.0, knob_metric=lambda k, seg: k if seg == "train" else 1.0, knob_params=(1, 2, 3, 4), fit_from_start=lambda x: {"a": 1.0}, starts=[{"a": 0.0}, {"a": 1.0}, {"a": 2.0}],
        implication_results={"decays": True},
    )
    r = run(s, Prereg("states persist", "persistence", ["decays"]), n_draws=40)
    assert {c.id for c in r.checks} >= {"P0", "P9", "S7", "M6", "M5", "M0", "S6", "A0", "A1", "A2", "A3", "A4", "S4", "S5", "S8", "S9", "S10"}
    assert not r.killers or {c.id for c in r.killers} <= {"A2", "M10", "M11"}, r.render()
    got = {c.id: c.outcome for c in r.checks}
    assert got["M0"] == got["S6"] == got["S4"] == PASS
    if not r.killers:
        assert {c.id for c in r.checks} >= {"M1", "M2", "M3", "M4", "M7", "M8", "M9", "M10", "M11", "M12", "M13", "M14", "E1", "E2", "E3", "E4", "E5", "E6"}
    assert r.to_frame(spark).count() == len(r.checks)


def test_books_against_their_nulls(spark):
    from gristmill.plans.battery import StrategyStudy, run_strategy

    df = planted(spark, False, 60, 80).withColumn("sel", F.coalesce(F.col("signal") > 1.2, F.lit(False)))
    r = run_strategy(StrategyStudy("picks winners", df, df.select("t").distinct().withColumn("benchmark", F.lit(0.0001)), 1.0), Prereg("picks winners"), n_draws=30)
    assert {c.id: c.outcome for c in r.checks} == {"P0": PASS, "SE1": PASS, "SM0": PASS, "SM1": PASS, "SE2": PASS} and r.outcome == SURVIVES


def test_missing_column_is_refused(spark):
    with pytest.raises(ValueError):
        Study("x", frame(spark, np.ones((2, 2))))


def test_increment(spark):
    from datetime import date

    g = np.random.default_rng(0)
    rows = [(t, date(2015 + t // 12, 1 + t % 12, 1), b := float(0.02 * g.normal()), b + 0.004 + float(0.001 * g.normal()), 0.0) for t in range(60)]
    books = spark.createDataFrame(rows, "t int, date date, baseline double, combined double, benchmark double")
    assert run_increment("adds", books, prereg=Prereg("adds"), periods_per_year=12).outcome == SURVIVES
    worse = books.withColumn("combined", F.col("baseline") - 0.001)
    assert run_increment("takes", worse, prereg=Prereg("takes"), periods_per_year=12).outcome == REJECTED


def test_priors_round_trip(spark, tmp_path):
    record = {"id": "r1", "claim": "rotation wins", "verdict": "REJECTED", "killed_by": ["cost-eats-it"], "evidence": "the net return was below zero", "lesson": "price the turnover before believing it"}
    dry = priors.append(spark, record, str(tmp_path), dry_run=True)
    assert not dry["written"] and (dry["records"], dry["projects"]) == (0, 1) and "dry run" in priors.render_append(dry)
    first = priors.append(spark, record, str(tmp_path))
    assert first["after"] == ["cost-eats-it"] and first["changed"] and first["new_project"] and first["records"] == 1
    assert "1 records of 1 projects, the first of its project" in priors.render_append(first)
    with open(tmp_path / "records.jsonl", "a") as f:
        f.write("\n// a comment\n")
    assert priors.load(spark, str(tmp_path)).count() == 1
    for bad in (record, record | {"id": "r2", "killed_by": ["nonsense"]}, record | {"id": "r3", "lesson": "short"}):
        with pytest.raises(ValueError):
            priors.append(spark, bad, str(tmp_path))
    assert "price the turnover" in priors.render(priors.load(spark, str(tmp_path)))
    again = priors.append(spark, record | {"id": "r4"}, str(tmp_path))
    assert not again["changed"] and not again["new_project"] and (again["records"], again["projects"]) == (2, 1)


def test_taxonomy_and_scaffold(spark, tmp_path):
    assert len(taxonomy.MODES) == 79 and taxonomy.uncovered(spark).count() == 6
    assert "cost-eats-it" in taxonomy.render_checklist(spark)
    files = scaffold.create(str(tmp_path / "study"), "name")
    assert "judge.py" in files
    with pytest.raises(FileExistsError):
        scaffold.create(str(tmp_path / "study"), "name")


def test_streaming_freshness(spark, tmp_path):
    from gristmill.streaming.freshness import CELL_SCHEMA, live_counts, stale_windows

    spark.sql("select timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,id) as ts, id as asset, 'a' as input, case when id < 2 then 1.0d + id end as value from range(4)").write.parquet(str(tmp_path / "in"))
    cells = spark.readStream.schema(CELL_SCHEMA).parquet(str(tmp_path / "in"))
    q = live_counts(cells).writeStream.format("memory").queryName("fresh").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("fresh")
    assert got.agg(F.sum("n")).first()[0] == 2 and stale_windows(got).count() == 2
