"""Experiment records, as the command line writes and reads them."""

from __future__ import annotations

import time
from collections.abc import Callable

from .operators.influence import Result


def timed(run: Callable[[], Result]) -> tuple[Result, float]:
    start = time.perf_counter()
    got = run()
    return got, (time.perf_counter() - start) * 1000


def record(algorithm: str, source: str, output: str, model: str, k: int, seeds: list[int], total_ms: float, result: Result, **more) -> dict:
    """Keys of an experiment; seeds are original ids, times milliseconds."""
    out = {"Algorithm": algorithm, "Input": source, "Output": output, "DiffusionModel": model, "K": k, "L": 1, "Total": total_ms, "Seeds": seeds}
    if algorithm in ("IMM", "OPIMC", "TIM"):
        out |= {"Theta": result.sets, "RRRSetsGenerated": result.sets, "CoveredFraction": result.fraction, "Spread": result.spread, "Guaranteed": result.guaranteed}
        out |= {k: result.details[k] for k in ("GenerateRRRSets", "FindMostInfluentialSet", "Counting", "Pivoting", "Iterations", "RRRSetSizeBytes", "ThetaEstimation", "ThetaEstimationGenerateRRR", "ThetaEstimationMostInfluential") if k in result.details}
    if algorithm == "HillClimbing":
        out |= {"Samples": result.sets, "Spread": result.spread, **{k: result.details[k] for k in ("Evaluated", "Sampling", "SeedSelection")}}
    if algorithm == "IMM":
        out["ThetaPrimes"] = result.details.get("theta_primes", [])
    if algorithm == "OPIMC":
        out |= {"ThetaZero": result.details["theta_zero"], "ThetaMax": result.details["theta_max"], "Alpha": result.details["alpha"]}
    if algorithm == "TIM":
        out |= {"KptEstimation": result.details["kpt"], "KptRefinement": result.details["kpt_refined"]}
    return out | more
