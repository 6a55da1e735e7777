"""Search over configurations: sampling, a tree-structured Parzen estimator, median pruning. Trials are few and are proposed on the driver."""

from __future__ import annotations

import json
import math
import os
import random
import statistics
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import finite, spread_score
from ..operators.ranking import best

# Sizes of the models by preset.
SIZES = {
    "small": {"mlp_embed_dim": 32, "gru_embed_dim": 32, "model_hidden": 128, "gru_hidden": 32, "dsconv_channels": 32},
    "medium": {"mlp_embed_dim": 32, "gru_embed_dim": 64, "model_hidden": 128, "gru_hidden": 64, "dsconv_channels": 64},
    "large": {"mlp_embed_dim": 64, "gru_embed_dim": 64, "model_hidden": 256, "gru_hidden": 64, "dsconv_channels": 64},
}


def sample(space: dict, rng: random.Random) -> dict:
    """One configuration: a list is a choice, a pair (low, high) of floats a log-uniform range."""
    return {k: rng.choice(v) if isinstance(v, list) else math.exp(rng.uniform(math.log(v[0]), math.log(v[1]))) for k, v in space.items()}


def sized(config: dict) -> dict:
    """A sampled configuration with the dimensions of its size preset."""
    return config | SIZES[config["size_preset"]] if "size_preset" in config else config


def _weight(value, seen: list, spec, prior: float = 1.0) -> float:
    """Density of a value among those seen, with a flat prior."""
    if isinstance(spec, list):
        return (seen.count(value) + prior / len(spec)) / (len(seen) + prior)
    low, high = math.log(spec[0]), math.log(spec[1])
    width = (high - low) / max(2, len(seen)) ** 0.5
    x = math.log(value)
    bumps = sum(math.exp(-(((x - math.log(s)) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi)) for s in seen)
    return (bumps + prior / (high - low)) / (len(seen) + prior)


def propose(space: dict, trials: list[tuple[dict, float]], rng: random.Random, startup: int = 5, tries: int = 24, share: float = 0.25) -> dict:
    """The next configuration: random at first, then of several samples the one likeliest among good trials against the others."""
    done = sorted((t for t in trials if math.isfinite(t[1])), key=lambda t: t[1])
    if len(done) < startup:
        return sample(space, rng)
    cut = max(1, math.ceil(share * len(done)))
    good, rest = [c for c, _ in done[:cut]], [c for c, _ in done[cut:]]

    def promise(config: dict) -> float:
        return sum(math.log(_weight(config[k], [c[k] for c in good], spec)) - math.log(_weight(config[k], [c[k] for c in rest], spec)) for k, spec in space.items())

    return max((sample(space, rng) for _ in range(tries)), key=promise)


def should_stop(history: list[list[float]], own: list[float], startup: int = 3, warmup: int = 1) -> bool:
    """Median pruning: after `warmup` steps, the running score is worse than the median of earlier trials at the same step."""
    step = len(own) - 1
    others = [h[step] for h in history if len(h) > step]
    return step >= warmup and len(others) >= startup and own[-1] > statistics.median(others)


def study(space: dict, score: Callable[[dict], float | Iterable[float]], n: int, seed: int = 42, store: str | None = None, prune: bool = False) -> list[dict]:
    """n trials in all, as dictionaries of number, config, value, state (complete, pruned, failed) and running scores.

    score(config) gives a number, or running scores in turn, the last of which counts; with `prune` a trial
    ends early by should_stop. Each trial draws from the seed and its own number, so that a study goes on as it
    would have, and with `store`, a file of JSON lines, it goes on after what is stored there.
    """
    trials: list[dict] = []
    if store and os.path.exists(store):
        with open(store, encoding="utf-8") as f:
            trials = [json.loads(line) for line in f if line.strip()]
    while len(trials) < n:
        done = [(t["config"], t["value"]) for t in trials if t["state"] == "complete"]
        config, steps, state = propose(space, done, random.Random(f"{seed}/{len(trials)}")), [], "complete"
        try:
            got = score(sized(config))
            for value in got if isinstance(got, Iterable) else [got]:
                steps.append(float(value))
                if prune and should_stop([t["steps"] for t in trials if t["state"] == "complete"], steps):
                    state = "pruned"
                    break
        except Exception as error:
            state, reason = "failed", str(error)
        else:
            reason = None
            if not steps or not math.isfinite(steps[-1]):
                state = "failed"
        trials.append({"number": len(trials), "config": config, "value": steps[-1] if state == "complete" else None, "state": state, "reason": reason, "steps": steps})
        if store:
            with open(store, "a", encoding="utf-8") as f:
                f.write(json.dumps(trials[-1]) + "\n")
    return trials


def best_trial(trials: list[dict]) -> dict:
    """The complete trial of least value, the first of several."""
    done = [t for t in trials if t["state"] == "complete"]
    if not done:
        raise ValueError("no trial is complete")
    return min(done, key=lambda t: t["value"])


def running_scores(rows: DataFrame, trial: str, step: str, error: str, gain: str, weight: float = 1.0, penalty: float = 1.0) -> DataFrame:
    """rows with running_score: mean + weight * deviation of the errors of the trial's steps so far, and the penalty for a mean loss on the baseline."""
    upto = W.partitionBy(trial).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    mean, std = F.avg(finite(F.col(error))).over(upto), F.coalesce(F.stddev_samp(finite(F.col(error))).over(upto), F.lit(0.0))
    return rows.withColumn("running_score", spread_score(mean, std, weight, F.avg(finite(F.col(gain))).over(upto), penalty))


def best_completed(trials: DataFrame, by: tuple[str, ...], score: str = "score", number: str = "number") -> DataFrame:
    """The completed trial of least score of each group, the first of several."""
    return best(trials.filter((F.col("state") == "complete") & finite(F.col(score)).isNotNull()), by, [score, number])
