"""Failure breakdown of one evaluated run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sightline.operators import strata


def breakdown(per_frame: DataFrame, tolerance: float = 3.0) -> dict[str, DataFrame]:
    """All tables of the failure report, from one enriched frame.

    Persist or write ``enriched`` before collecting several of them.
    """
    pos = strata.enrich(per_frame, tolerance)
    per_dive = strata.per_dive_failures(pos)
    return {
        "enriched": pos,
        "axes": strata.summarize_axes(pos, strata.AXES),
        "rig_priors": strata.rig_priors(pos),
        "per_dive": strata.most_failures_first(per_dive),
        "concentration": strata.concentration(per_dive),
        "residuals": strata.residual_stats(pos),
        "residual_bias": strata.residual_bias(pos),
        "colour_x_line": strata.failure_rates(pos),
        "hit_histogram": strata.linear_histogram(strata.hits(pos), "err", 0.0, 3.0, 30),
    }
