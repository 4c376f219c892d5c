"""The ways a claim can be wrong: mode, family, and the checks that catch it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: keys that records of verdicts use, in their order
MODES = (
    ("null-turnover-unmatched", "null", "SM1"),
    ("null-exposure-unmatched", "null", "SM1 M1"),
    ("null-dimension-unmatched", "null", "M1"),
    ("null-percentile-hides-the-effect-size", "null", "M1"),
    ("null-random-structure-wins", "null", "M4"),
    ("null-selection-unaware", "null", "S4"),
    ("null-absent", "null", "M0 M1 SM1"),
    ("shift-audit-blind-on-smoothed-signals", "pit", "A4"),
    ("leak-alignment-offset", "pit", "A2"),
    ("leak-label-in-feature", "pit", "A2 A0"),
    ("leak-future-filtered-events", "pit", "M7"),
    ("leak-full-sample-statistic", "pit", "A0 A1"),
    ("leak-cumulative-state-gate", "pit", "A0"),
    ("leak-same-day-survivorship", "pit", "A0"),
    ("leak-weights-at-close", "pit", "A0"),
    ("leak-backtester-gives-today", "pit", "P4"),
    ("cost-eats-it", "cost", "E1"),
    ("cost-two-legs-do-not-net", "cost", "E1"),
    ("cost-spread-not-fee", "cost", "E1 E3"),
    ("cost-double-counted", "cost", "E4"),
    ("cost-capacity-ceiling", "cost", "E5"),
    ("multiple-testing-unadjusted", "stat", "S4"),
    ("conservative-correction-misapplied", "stat", ""),
    ("overlap-inflated-t", "stat", "S4 A3"),
    ("icir-inflated-by-autocorrelation", "stat", "S9"),
    ("seed-instability", "stat", "S5"),
    ("single-period-driven", "stat", "E2 SE2"),
    ("sample-too-thin", "stat", "S4"),
    ("power-not-verified", "stat", "S6"),
    ("train-up-valid-down", "stat", "S8"),
    ("panel-includes-the-sealed-period", "proc", "P9"),
    ("test-set-consumed", "stat", "P2"),
    ("metric-depends-on-the-base-rate", "stat", "P5"),
    ("decision-space-degenerate", "mech", ""),
    ("negative-without-a-reproduced-baseline", "proc", "S6"),
    ("relative-metric-without-absolute", "stat", "E1"),
    ("signal-is-self-reversal", "mech", "M1 M3 M4"),
    ("signal-is-exposure", "mech", "M1 M3"),
    ("signal-is-market-not-cross-section", "mech", "M0 M9"),
    ("signal-duplicates-existing", "mech", "M3 M4"),
    ("screen-control-narrower-than-deployment", "null", "M3"),
    ("baseline-sees-fewer-inputs", "mech", "M4 M3"),
    ("complexity-no-increment", "mech", "M4"),
    ("stale-price-artifact", "mech", "E3"),
    ("absurd-number-is-a-data-question", "mech", "M13"),
    ("universe-predates-the-index", "mech", "M14"),
    ("synthetic-data-badprints", "mech", "M5"),
    ("benchmark-wrong-basis", "mech", "SE1"),
    ("data-frozen-silently", "mech", "S7"),
    ("data-encoding-changed", "mech", "S7"),
    ("mechanism-true-but-untradable", "mech", "E1 E2"),
    ("alt-channel-no-earlier-than-price", "mech", ""),
    ("threshold-effect-diluted", "mech", "M8"),
    ("mechanism-stated-but-not-the-one-working", "mech", "P6"),
    ("non-stationary-needs-retraining", "mech", "M10"),
    ("mechanism-not-established", "proc", "P6"),
    ("control-contains-the-target", "mech", "M12 M3"),
    ("entry-blocked-at-the-limit", "cost", "E6"),
    ("filtered-away-the-exposure", "mech", "M4 I1"),
    ("improvement-outside-the-traded-set", "cost", "I1 I2"),
    ("ic-not-tradable", "cost", "M8 E1"),
    ("criterion-mismatched-to-the-rule", "proc", "M8 E1"),
    ("breadth-too-narrow-for-the-ic", "cost", "E1"),
    ("rule-degenerates-to-the-benchmark", "stat", ""),
    ("validated-on-substitute-data", "mech", "M0"),
    ("conclusion-does-not-transfer-across-frequency", "mech", "M11"),
    ("increment-is-the-act-not-the-thing", "null", "I2"),
    ("composite-dilutes-the-good-component", "null", "I2 M4"),
    ("increment-buys-good-years-with-bad", "cost", "I1"),
    ("frozen-config-not-enforced", "proc", "P3"),
    ("recompute-vs-rerun", "proc", "M6"),
    ("estimator-not-identified", "stat", "S10"),
    ("hypothesis-contaminated-by-hindsight", "proc", "P8"),
    ("check-structurally-cannot-fire", "proc", "P7"),
    ("cache-indexed-by-position", "proc", ""),
    ("fields-from-inconsistent-sources", "mech", ""),
    ("assumption-measurable-and-wrong", "proc", "P5"),
    ("internal-consistency-not-enough", "proc", "P5"),
    ("mechanism-filter-inverts-the-sign", "mech", "P6"),
)
FAMILIES = ("null", "pit", "cost", "stat", "mech", "proc")


def modes(spark: SparkSession) -> DataFrame:
    """(seq, id, family, name, caught_by array)."""
    rows = [(i, a, b, a.replace("-", " "), c.split()) for i, (a, b, c) in enumerate(MODES)]
    return spark.createDataFrame(rows, "seq int, id string, family string, name string, caught_by array<string>")


def by_family(spark: SparkSession, family: str) -> DataFrame:
    return modes(spark).where(F.col("family") == family)


def uncovered(spark: SparkSession) -> DataFrame:
    """Modes that no check catches: (id, family)."""
    return modes(spark).where(F.size("caught_by") == 0).select("id", "family")


def coverage(spark: SparkSession) -> DataFrame:
    """(family, n_modes, n_covered)."""
    return modes(spark).groupBy("family").agg(F.count(F.lit(1)).alias("n_modes"), F.count_if(F.size("caught_by") > 0).alias("n_covered"))


def render_checklist(spark: SparkSession) -> str:
    """The modes as text, a heading a family."""
    rows = modes(spark).orderBy("seq").collect()  # the fixed list
    out = []
    for family in FAMILIES:
        out.append(f"[{family}]")
        out += [f"  {r.id}: " + (", ".join(r.caught_by) or "no check") for r in rows if r.family == family]
    return "\n".join(out)
