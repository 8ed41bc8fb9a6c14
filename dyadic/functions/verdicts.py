"""Threshold rules turned into labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def separation_gate(p: Column, max_d: Column) -> Column:
    """PASS on p < .05 with effect >= .3; MARGINAL on p < .15."""
    return F.when((p < 0.05) & (max_d >= 0.3), "PASS").when(p < 0.15, "MARGINAL").otherwise("FAIL")


def fraction_gate(sd_a: Column, sd_b: Column, r: Column, min_sd: float = 0.02, min_r: float = 0.30) -> Column:
    spread = (sd_a >= min_sd) & (sd_b >= min_sd)
    return F.when(spread & (F.abs(r) >= min_r), "PASS").when(spread, "MARGINAL").otherwise("FAIL")


def shift_gate(auc: Column) -> Column:
    return F.when(auc < 0.75, "PASS").when(auc <= 0.85, "MARGINAL").otherwise("FAIL")


def direction_gate(p: Column, direction_ok: Column) -> Column:
    return F.when(~direction_ok, "FAIL").when(p < 0.05, "PASS").when(p < 0.15, "MARGINAL").otherwise("FAIL")


def proximity_gate(p: Column, d: Column) -> Column:
    """Both bounds are strict: p at .05 or d at .3 fails."""
    return F.when((p < 0.05) & (d > 0.3), "PASS").otherwise("FAIL")


def rescue_gate(p: Column, max_d: Column) -> Column:
    return F.when((p < 0.05) & (max_d > 0.30), "RESCUE_PASS").when(p < 0.15, "MARGINAL").otherwise("FAIL")


def rescue_direction_gate(p: Column, diff: Column) -> Column:
    return (
        F.when((p < 0.05) & (diff < 0), "RESCUE_PASS").when((p < 0.15) & (diff < 0), "MARGINAL").otherwise("FAIL")
    )


def replication_gate(percent: Column) -> Column:
    return F.when(percent >= 40.0, "PASS").otherwise("FAIL")


def concordance_gate(sign: Column, pi1: Column, rho: Column) -> Column:
    return (
        F.when((sign >= 0.55) & (pi1 >= 0.30) & (rho >= 0.15), "REPLICATES")
        .when((sign >= 0.50) & (pi1 >= 0.20), "MARGINAL")
        .otherwise("DOES_NOT_REPLICATE")
    )


def icc_class(icc: Column, trait: float = 0.85, state: float = 0.65) -> Column:
    return F.when(icc > trait, "trait").when(icc < state, "state").otherwise("mixed")


def trait_state_pass(n_trait: Column, n_state: Column, rho: Column, ci_high: Column) -> Column:
    return (n_trait >= 3) & (n_state >= 3) & (rho < 0.30) & (ci_high < 0.50)


def activity_pass(min_non_null: Column, n_hits: Column, min_sources: int = 1000) -> Column:
    return (min_non_null >= min_sources) & (n_hits > 0)
