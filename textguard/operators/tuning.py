"""Seeded search over the hyper-parameter spaces, scored by cross-validated F1: all trials in full, or by halving."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.errors import UnknownMethodError
from textguard.operators.ensemble import fold_scores, folded_scores
from textguard.operators.models import SEED, resolve_params
from textguard.operators.sampling import assign_folds

Space = Callable[[np.random.Generator], dict[str, Any]]


def _log(rng: np.random.Generator, low: float, high: float) -> float:
    return float(np.exp(rng.uniform(np.log(low), np.log(high))))


def _step(rng: np.random.Generator, low: int, high: int, step: int = 1) -> int:
    return int(rng.choice(np.arange(low, high + 1, step)))


# Ranges follow the usual spaces of each model, restricted to parameters that exist here.
SPACES: dict[str, Space] = {
    "logistic_regression": lambda r: {"C": _log(r, 1e-3, 100.0), "max_iter": _step(r, 100, 2000, 100)},
    "random_forest": lambda r: {
        "n_estimators": _step(r, 50, 500, 50),
        "max_depth": _step(r, 5, 30, 5),
        "min_samples_leaf": _step(r, 1, 10),
        "max_features": str(r.choice(["sqrt", "log2"])),
    },
    "svm": lambda r: {
        "C": _log(r, 0.01, 100.0),
        "kernel": str(r.choice(["linear", "rbf", "poly"])),
        "gamma": str(r.choice(["scale", "auto"])),
    },
    "lightgbm": lambda r: {
        "n_estimators": _step(r, 50, 500, 50),
        "learning_rate": _log(r, 1e-3, 0.3),
        "max_depth": _step(r, 3, 15),
        "min_child_samples": _step(r, 5, 50),
        "subsample": float(r.uniform(0.5, 1.0)),
    },
    "mlp": lambda r: {
        "hidden_layer_sizes": tuple(_step(r, 32, 256, 32) for _ in range(_step(r, 1, 3))),
        "max_iter": 500,
    },
}
DEFAULT_TRIALS = {"mlp": 30}
# What a rung of successive halving gives in growing shares.
BUDGETS = {"logistic_regression": "max_iter", "random_forest": "n_estimators", "svm": "max_iter", "lightgbm": "n_estimators", "mlp": "max_iter"}
SVM_ITERATIONS = 100
# What unusable parameters raise; a lost cluster or a failed job is not a failed trial.
BAD_TRIAL = (ValueError, ArithmeticError, IllegalArgumentException)


@dataclass
class TuneResult:
    best_params: dict[str, Any]
    best_score: float
    history: DataFrame


def tune(
    df: DataFrame,
    model: str,
    n_trials: int | None = None,
    cv: int = 5,
    seed: int = SEED,
    space: Space | None = None,
    batch: int = 8,
    label: str = "type",
    id_col: str = "doc_id",
) -> TuneResult:
    """Best parameters by mean F1 of class 1 over the folds; history is (trial, value, params, state).

    Trials run in batches whose fits share the cluster; a failing batch is retried trial by trial
    and a failing trial is recorded as FAIL.
    """
    if model not in SPACES:
        raise UnknownMethodError(f"no search space for {model}")
    rng = np.random.default_rng(seed)
    n_trials = n_trials or DEFAULT_TRIALS.get(model, 50)
    params = [(space or SPACES[model])(rng) for _ in range(n_trials)]
    values: dict[int, float | None] = {}

    def run(trials: list[int]) -> None:
        members = {str(t): (model, params[t]) for t in trials}
        means = fold_scores(df, members, cv, label, id_col, seed).groupBy("model").agg(F.avg("f1").alias("f1")).collect()
        values.update({int(r["model"]): r["f1"] for r in means})

    for at in range(0, n_trials, batch):
        trials = list(range(at, min(at + batch, n_trials)))
        try:
            run(trials)
        except BAD_TRIAL:  # one bad combination must not lose the batch
            for t in trials:
                try:
                    run([t])
                except BAD_TRIAL:
                    values[t] = None
    done = [t for t in range(n_trials) if values.get(t) is not None]
    if not done:
        raise RuntimeError(f"no trial of {model} succeeded")
    best = max(done, key=lambda t: values[t])
    rows = [(t, values.get(t), str(params[t]), "COMPLETE" if values.get(t) is not None else "FAIL") for t in range(n_trials)]
    history = df.sparkSession.createDataFrame(rows, "trial int, value double, params string, state string")
    return TuneResult(params[best], float(values[best]), history)


def rungs(n_trials: int, factor: int) -> list[tuple[int, float]]:
    """(trials, share of the iterations) of every rung; the last one is a full fit."""
    n, counts = n_trials, [n_trials]
    while n > 1:
        n = max(1, n // factor)
        counts.append(n)
    return [(c, float(factor) ** (k + 1 - len(counts))) for k, c in enumerate(counts)]


def tune_by_halving(
    df: DataFrame,
    model: str,
    n_trials: int | None = None,
    cv: int = 5,
    seed: int = SEED,
    space: Space | None = None,
    factor: int = 3,
    label: str = "type",
    id_col: str = "doc_id",
) -> TuneResult:
    """Successive halving: every rung gives its trials ``factor`` times the iterations of the one before and passes on
    the best of them, one in ``factor``. History is (trial, value, params, state, rung): the value of the last rung a
    trial reached; states are COMPLETE, PRUNED and FAIL.

    Folds are dealt and cached once, with all rows, for all rungs. A rung's fits share the cluster; a trial
    that cannot be fitted is recorded as FAIL and loses only itself.
    """
    if model not in SPACES:
        raise UnknownMethodError(f"no search space for {model}")
    if factor < 2:
        raise ValueError("factor must be at least 2")
    rng = np.random.default_rng(seed)
    params = [(space or SPACES[model])(rng) for _ in range(n_trials or DEFAULT_TRIALS.get(model, 50))]
    budget = BUDGETS[model]
    values: dict[int, float] = {}
    reached: dict[int, int] = {}
    failed: set[int] = set()
    alive = list(range(len(params)))
    folded = assign_folds(df, cv, label, id_col, seed).persist()

    def run(trials: list[int], share: float) -> None:
        members = {}
        for t in trials:
            full = {"max_iter": SVM_ITERATIONS, **params[t]} if model == "svm" else resolve_params(model, params[t])
            members[str(t)] = (model, {**params[t], budget: max(1, round(full[budget] * share))})
        found = folded_scores(folded, members, cv, label, seed).groupBy("model").agg(F.avg("f1").alias("f1")).collect()
        values.update({int(r["model"]): r["f1"] for r in found})

    try:
        for rung, (count, share) in enumerate(rungs(len(params), factor)):
            alive = sorted(alive, key=lambda t: (-values.get(t, 0.0), t))[:count]
            try:
                run(alive, share)
            except BAD_TRIAL:
                for t in alive:
                    try:
                        run([t], share)
                    except BAD_TRIAL:
                        failed.add(t)
                        values.pop(t, None)
            reached.update({t: rung for t in alive})
            alive = [t for t in alive if t not in failed]
            if not alive:
                raise RuntimeError(f"no trial of {model} succeeded")
    finally:
        folded.unpersist()
    best = max(alive, key=lambda t: (values[t], -t))
    state = lambda t: "FAIL" if t in failed else "COMPLETE" if t in alive else "PRUNED"
    rows = [(t, values.get(t), str(params[t]), state(t), reached[t]) for t in range(len(params))]
    history = df.sparkSession.createDataFrame(rows, "trial int, value double, params string, state string, rung int")
    return TuneResult(params[best], float(values[best]), history)
