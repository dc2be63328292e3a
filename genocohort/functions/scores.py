"""Percentile, gate, band and confidence expressions for weighted scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz-Stegun 7.1.26 (absolute error of erf below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Spark has no erf; one polynomial expression stays in generated code."""
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_percent(z: Column) -> Column:
    return 50.0 * (1.0 + erf(z / F.sqrt(F.lit(2.0))))


def comparable_score(avg: Column, total: Column, mean: Column) -> Column:
    """Use the SUM scale when the reference mean is plainly on it."""
    mismatch = total.isNotNull() & (F.abs(mean) > 1) & (F.abs(avg) < F.abs(mean) * 0.001)
    return F.when(mismatch, total).otherwise(avg)


def percentile_columns(avg: Column, total: Column, mean: Column, std: Column, expected_std: Column) -> dict[str, Column]:
    """z, percentile (null when gated), capped flag, reason and gate names, in the order the gates apply."""
    usable = F.coalesce(std > 0, F.lit(False))
    score = comparable_score(avg, total, mean)
    z = F.when(usable, (score - mean) / std)
    raw = normal_percent(z)
    extreme = F.abs(z) > 6
    collapsed = F.coalesce((expected_std > 0) & (std < expected_std * 0.1), F.lit(False))
    reason = (
        F.when(mean.isNull() | std.isNull(), "no_reference_stats")
        .when(~usable, "ref_std_zero")
        .when(extreme, "z_score_extreme")
        .when(collapsed, "distribution_collapsed")
    )
    kept = usable & ~extreme & ~collapsed
    capped = kept & ((raw < 0.5) | (raw > 99.5))
    gates = F.filter(
        F.array(
            F.when(extreme, "z_over_6"),
            F.when(~extreme & (F.abs(z) > 4), "z_over_4"),
            F.when(usable & ~extreme & collapsed, "ref_std_collapsed"),
            F.when(capped, "percentile_capped"),
        ),
        lambda g: g.isNotNull(),
    )
    return {
        "z": z,
        "z_score": F.round(z, 3),
        "percentile": F.when(kept, F.round(F.least(F.greatest(raw, F.lit(0.5)), F.lit(99.5)), 1)),
        "percentile_capped": F.coalesce(capped, F.lit(False)),
        "reason": reason,
        "gates": gates,
        "scale_correction": F.coalesce(usable & (score != avg), F.lit(False)),
    }


def status_band(matched: Column, rate: Column) -> Column:
    return (
        F.when((matched == 0) | (rate < 60), "failed")
        .when(rate < 85, "warning")
        .otherwise("passed")
    )


def confidence_reasons(method: Column, rate: Column, build_status: Column, gates: Column) -> Column:
    return F.filter(
        F.array(
            F.when(~method.eqNullSafe(F.lit("precomputed_stats")), "no_precomputed_stats"),
            F.when(F.coalesce(rate, F.lit(0.0)) < 95, "match_rate_below_95pct"),
            F.when(~build_status.eqNullSafe(F.lit("PASS")), "build_validation_not_passed"),
            F.when(F.coalesce(F.size(gates), F.lit(0)) > 0, "sanity_gates_tripped"),
        ),
        lambda r: r.isNotNull(),
    )


def ordered_shares(shares: Column) -> Column:
    """map(population -> share) as an array, largest first, ties by name."""
    return F.array_sort(
        F.transform(
            F.map_entries(shares), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("population"))
        )
    )


def reference_choice(shares: Column) -> Column:
    """struct(primary, secondary[]) from a population -> fraction map."""
    ranked = F.transform(ordered_shares(shares), lambda e: e["population"])
    top = -F.get(ordered_shares(shares), F.lit(0))["neg"]
    none = shares.isNull() | (F.size(shares) == 0)
    primary = F.when(none, "EUR").when(top >= 0.80, F.get(ranked, F.lit(0))).otherwise("MIX")
    secondary = (
        F.when(none, F.array(F.lit("MIX")))
        .when(top >= 0.80, F.slice(ranked, 2, 2))
        .otherwise(F.slice(ranked, 1, 2))
    )
    return F.struct(primary.alias("primary"), secondary.alias("secondary"))
