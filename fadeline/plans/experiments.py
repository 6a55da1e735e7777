"""Experiment matrices: plans, resumption, configurations, searches. Plans are small tables; trials run as plain calls."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import statistics
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sets

# Base configuration of the models.
BASE_CONFIG = {
    "mlp_embed_dim": 64, "gru_embed_dim": 64, "model_hidden": 256, "gru_hidden": 64, "dsconv_channels": 64, "dropout": 0.10, "lr": 1e-3, "weight_decay": 1e-5,
    "huber_delta": 0.02, "clip_grad_norm": 1.0, "lr_scheduler_patience": 0, "lr_scheduler_factor": 0.5, "zero_output_init": False, "target_scale": 1.0,
}
TRUE_WORDS = ("1", "true", "yes", "y")


def plan(*tables: DataFrame, key: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Cross product of small tables; with `key`, a trial name of those columns."""
    out = sets.product(*tables)
    return out.withColumn("trial", F.concat(F.lit(prefix), F.concat_ws("|", *(F.col(k).cast("string") for k in key)))) if key else out


def scenarios(lookbacks: Iterable[int], horizons: Iterable[int]) -> list[dict]:
    """Grid of scenarios, in order, each once."""
    return [{"name": f"lb{a}_h{b}", "lookback_cycles": a, "horizon": b} for a, b in dict.fromkeys(itertools.product(lookbacks, horizons))]


def parse_scenarios(text: str) -> list[dict]:
    """`lookback:horizon[:name]` items of a comma-separated list, each once."""
    out = []
    for item in filter(None, (x.strip() for x in text.split(","))):
        parts = item.split(":")
        if len(parts) not in (2, 3):
            raise ValueError(f"not lookback:horizon[:name]: {item}")
        out.append({"name": parts[2] if len(parts) == 3 else f"lb{parts[0]}_h{parts[1]}", "lookback_cycles": int(parts[0]), "horizon": int(parts[1])})
    return list({tuple(s.values()): s for s in out}.values())


def choose_scenarios(from_file: list[dict] | None, inline: str | None, lookbacks: list[int] | None, horizons: list[int] | None, default: list[dict]) -> list[dict]:
    """File before inline text before grid before defaults."""
    if from_file:
        return from_file
    if inline:
        return parse_scenarios(inline)
    return scenarios(lookbacks, horizons) if lookbacks and horizons else default


def normalise_config(config: dict) -> dict:
    """Base configuration with the given values in its types; words are read as booleans where the base has one."""
    out = dict(BASE_CONFIG)
    for key, value in config.items():
        base = BASE_CONFIG.get(key)
        if isinstance(base, bool):
            out[key] = value.strip().lower() in TRUE_WORDS if isinstance(value, str) else bool(value)
        elif isinstance(base, (int, float)):
            out[key] = type(base)(value)
        else:
            out[key] = value
    return out


def configs_by_model(data, models: list[str]) -> dict[str, list[dict]]:
    """model -> configurations, out of a list, {"configs": [...]} or {model: [...]}; `*` stands for every model named nowhere else."""
    if isinstance(data, dict) and "configs" in data:
        data = data["configs"]
    if isinstance(data, list):
        data = {"*": data}
    found = {m: [normalise_config(c) for c in data.get(m, data.get("*", []))] for m in models}
    if lacking := [m for m, c in found.items() if not c]:
        raise ValueError(f"no configuration for {', '.join(lacking)}")
    return found


def configs_by_horizon(data: dict, horizons: list[int]) -> dict[int, dict]:
    """horizon -> configuration; a configuration that names another horizon than its key is an error."""
    out = {}
    for h in horizons:
        if (config := data.get(str(h))) is None:
            raise ValueError(f"no configuration for horizon {h}")
        if int(config.get("horizon", h)) != h:
            raise ValueError(f"the configuration for horizon {h} names {config['horizon']}")
        out[h] = config
    return out


def first_given(*values):
    """The first value that is not None: an explicit 0 counts."""
    return next((v for v in values if v is not None), None)


def config_hash(config: dict[str, Column] | dict) -> Column | str:
    """First ten hex digits of the SHA-1 of the JSON with sorted keys; of columns (whole numbers, booleans or strings), as a column.

    Strings are escaped as JSON in ASCII is, also beyond the basic plane.
    """
    if not any(isinstance(v, Column) for v in config.values()):
        return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:10]
    quoted = lambda c: F.coalesce(F.when(F.typeof(c) == "string", F.concat(F.lit('"'), _escaped(c.cast("string")), F.lit('"'))).otherwise(c.cast("string")), F.lit("null"))
    parts = [x for k in sorted(config) for x in (F.lit(f'{"{" if k == min(config) else ", "}"{k}": '), quoted(config[k]))]
    return F.substring(F.sha1(F.concat(*parts, F.lit("}"))), 1, 10)


def _escaped(text: Column) -> Column:
    """Text as it stands between the quotes of ASCII JSON."""
    short = {"\\": r"\\", '"': r"\"", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\b": r"\b", "\f": r"\f"}
    for c, shown in short.items():
        text = F.replace(text, F.lit(c), F.lit(shown))

    def one(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))  # four digits a unit, two units beyond the basic plane
        return F.concat(F.lit("\\u"), F.left(units, F.lit(4)), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.right(units, F.lit(4)))).otherwise(""))

    odd = text.rlike(r"[^\x20-\x7e]")
    return F.when(odd, F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(r"^[\x20-\x7e]$"), c).otherwise(one(c))), "")).otherwise(text)


def mean_std(values: Iterable[float]) -> tuple[float, float]:
    """Mean and sample deviation over finite values: none gives infinities, one a deviation of 0."""
    kept = [v for v in values if v is not None and math.isfinite(v)]
    if not kept:
        return math.inf, math.inf
    return statistics.fmean(kept), statistics.stdev(kept) if len(kept) > 1 else 0.0


def grid(space: dict[str, list]) -> Iterator[dict]:
    """Every combination of the values, in order."""
    for values in itertools.product(*space.values()):
        yield dict(zip(space, values, strict=True))


def staged_search(base: dict, stages: list[dict[str, list]], score: Callable[[dict], float]) -> tuple[dict, list[dict]]:
    """Coordinate search: each stage tries the grid of some keys with the rest held, and its best is carried on. Lower is better."""
    best, history, known = dict(base), [], {}
    for number, stage in enumerate(stages):
        tried = []
        for change in grid(stage):
            config = best | change
            key = config_hash(config)
            if key not in known:
                known[key] = score(config)
            tried.append((known[key], len(tried), config))
            history.append({"stage": number, "score": known[key], "hash": key, **config})
        best = min(tried, key=lambda t: (t[0] if math.isfinite(t[0]) else math.inf, t[1]))[2]
    return best, history


def confirm(candidates: list[dict], seeds: list[int], score: Callable[[dict, int], tuple[float, float]], weight: float = 1.0, penalty: float = 1.0) -> list[dict]:
    """Candidates over several seeds, best first: those that gain on their baseline before the others, then by mean + weight * std (and a penalty for loss).

    score(config, seed) gives (error, improvement).
    """
    out = []
    for config in candidates:
        runs = [score(config, s) for s in seeds]
        mean, std = mean_std(r[0] for r in runs)
        gain = mean_std(r[1] for r in runs)[0]
        out.append({**config, "mean": mean, "std": std, "gain": gain, "score": mean + weight * std + (penalty * abs(gain) if gain < 0 else 0.0)})
    return sorted(out, key=lambda r: (not r["gain"] > 0, r["score"]))


def run_trials(plan_rows: DataFrame, completed: DataFrame, key: list[str], trial: Callable[[dict], dict], workers: int = 1, keep_going: bool = True, force: bool = False, dry: bool = False) -> list[dict]:
    """Run the trials of a plan that are not completed, each in a driver thread; every row gets a status.

    The plan is a small table. Results come back in the plan's order; a failed trial has its error as reason.
    With `force` completed ones run again; a `dry` run runs none and gives them the status planned.
    """
    todo = [r.asDict() for r in (plan_rows if force else sets.pending(plan_rows, completed, key)).orderBy(*key).collect()]
    if dry:
        return [{**row, "status": "planned", "reason": None} for row in todo]

    def one(row: dict) -> dict:
        try:
            return {**row, **trial(row), "status": "done", "reason": None}
        except Exception as error:
            if not keep_going:
                raise
            return {**row, "status": "failed", "reason": str(error)}

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, todo))


def table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of dictionaries; keys that the schema lacks are left out."""
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def run_on_executors(plan_rows: DataFrame, completed: DataFrame, key: list[str], trial: Callable[[dict], dict], schema: str, tasks: int | None = None, force: bool = False) -> DataFrame:
    """(plan's columns, schema's columns, status, reason): the trials of a plan that are not completed, each run in a task where its row lies.

    trial(row) gives the values of schema; an error is the row's reason, its status failed, and its values null. A plan
    may have any number of rows. Trials may run twice if an executor is lost: they must bear that.
    """
    todo = plan_rows if force else sets.pending(plan_rows, completed, key)
    todo = todo.repartition(tasks, *key) if tasks else todo
    made = todo.sparkSession.createDataFrame([], schema).schema
    whole = T.StructType([*todo.schema.fields, *made.fields, T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    rows.append({**row, **trial(row), "status": "done", "reason": None})
                except Exception as error:
                    rows.append({**row, "status": "failed", "reason": str(error)})
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(whole))

    return todo.mapInArrow(run, whole)
