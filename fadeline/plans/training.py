"""Data-parallel training of the flat MLP: gradient sums per task in Arrow batches, added in a tree, one step of Adam in the driver.

With one batch an epoch is one step and one job: the pass that sums the gradient at the parameters just reached also
validates them, so that stopping, the learning rate and the best state follow from Spark aggregates. With more, samples
are dealt to batches by a hash and each batch is a step and a job. What the driver and every task hold is a few vectors
of the parameters' length, whatever the number of samples.
"""

from __future__ import annotations

import json
import math
import random
import statistics
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import artefacts
from ..operators.isolation import usable
from ..session import checkpointed

#: Gradients that one task adds up, and samples that go through the network together.
FAN, STEP = 8, 1024
NORM_EPS, BETAS, ADAM_EPS = 1e-5, (0.9, 0.999), 1e-8
#: What a pass sums up beside the gradient.
SUMS = ("n_train", "train_loss", "n_val", "val_loss", "val_abs", "val_square")

_erf = np.frompyfunc(math.erf, 1, 1)


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(x / math.sqrt(2)).astype(float))


def _gelu(x: np.ndarray) -> np.ndarray:
    return x * _phi(x)


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    return _phi(x) + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


@dataclass(frozen=True)
class Net:
    """inputs -> hidden, layer norm, GELU -> hidden / 2, GELU -> one number; dropout behind both GELUs. With zero_output the last layer starts at 0."""

    inputs: int
    hidden: int = 256
    dropout: float = 0.0
    zero_output: bool = False

    def shapes(self) -> dict[str, tuple[int, ...]]:
        h, half = self.hidden, self.hidden // 2
        return {"w1": (self.inputs, h), "b1": (h,), "gain": (h,), "shift": (h,), "w2": (h, half), "b2": (half,), "w3": (half, 1), "b3": (1,)}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            size = math.prod(shape)
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def start(self, seed: int) -> np.ndarray:
        """Weights and biases uniform within 1 / sqrt(inputs of the layer); the norm's gain is 1, its shift 0."""
        rng, parts = np.random.default_rng(seed), []
        fan_in = {"1": self.inputs, "2": self.hidden, "3": self.hidden // 2}
        for name, shape in self.shapes().items():
            if name in ("gain", "shift"):
                parts.append(np.full(shape, float(name == "gain")))
            else:
                most = 1 / math.sqrt(fan_in[name[1]])
                parts.append(rng.uniform(-most, most, shape))
        if self.zero_output:
            for p in parts[-2:]:
                p[...] = 0.0
        return np.concatenate([p.ravel() for p in parts])

    def forward(self, x: np.ndarray, flat: np.ndarray, kept: tuple | None = None) -> dict[str, np.ndarray]:
        """All layers: a1, unit (normalised), norm, h1, a2, h2, out. kept are the dropout factors of h1 and h2."""
        p = self.views(flat)
        a1 = x @ p["w1"] + p["b1"]
        spread = np.sqrt(a1.var(1, keepdims=True) + NORM_EPS)
        unit = (a1 - a1.mean(1, keepdims=True)) / spread
        norm = unit * p["gain"] + p["shift"]
        h1 = _gelu(norm) * (1 if kept is None else kept[0])
        a2 = h1 @ p["w2"] + p["b2"]
        h2 = _gelu(a2) * (1 if kept is None else kept[1])
        return {"spread": spread, "unit": unit, "norm": norm, "h1": h1, "a2": a2, "h2": h2, "out": (h2 @ p["w3"] + p["b3"])[:, 0]}

    def gradient(self, x: np.ndarray, flat: np.ndarray, slope, kept: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the summed loss, outputs); slope(outputs) is the loss's derivative by each output."""
        p, f = self.views(flat), self.forward(x, flat, kept)
        out = np.zeros_like(flat)
        g = self.views(out)
        d = slope(f["out"])[:, None]
        g["w3"][:], g["b3"][:] = f["h2"].T @ d, d.sum(0)
        d = d @ p["w3"].T * (1 if kept is None else kept[1]) * _gelu_slope(f["a2"])
        g["w2"][:], g["b2"][:] = f["h1"].T @ d, d.sum(0)
        d = d @ p["w2"].T * (1 if kept is None else kept[0]) * _gelu_slope(f["norm"])
        g["gain"][:], g["shift"][:] = (d * f["unit"]).sum(0), d.sum(0)
        d = d * p["gain"]
        d = (d - d.mean(1, keepdims=True) - f["unit"] * (d * f["unit"]).mean(1, keepdims=True)) / f["spread"]
        g["w1"][:], g["b1"][:] = x.T @ d, d.sum(0)
        return out, f["out"]

    def kept(self, ids: np.ndarray, epoch: int, seed: int) -> tuple | None:
        """Dropout factors of a sample's units, out of a hash of seed, epoch, sample and unit: the same however samples are dealt to tasks."""
        if not self.dropout:
            return None
        out = []
        for layer, units in enumerate((self.hidden, self.hidden // 2)):
            own = _hash(ids.astype(np.uint64) + _hash(np.array([seed * 1_000_003 + epoch * 7 + layer], np.uint64)))
            u = (_hash(own[:, None] + np.arange(1, units + 1, dtype=np.uint64)) >> np.uint64(11)) / 2.0**53
            out.append((u >= self.dropout) / (1 - self.dropout))
        return tuple(out)


def _hash(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Loss:
    """Huber loss with a delta, or, without one, the squared error."""

    delta: float | None = 0.02

    def value(self, e: np.ndarray) -> np.ndarray:
        if self.delta is None:
            return e * e
        a = np.abs(e)
        return np.where(a <= self.delta, 0.5 * e * e, self.delta * (a - 0.5 * self.delta))

    def slope(self, e: np.ndarray) -> np.ndarray:
        return 2 * e if self.delta is None else np.clip(e, -self.delta, self.delta)


@dataclass
class Adam:
    """Adam with decay added to the gradient, after the gradient is clipped to a norm (0: not at all)."""

    lr: float = 1e-3
    decay: float = 1e-5
    clip: float = 1.0
    steps: int = 0
    first: np.ndarray | None = None
    second: np.ndarray | None = None

    def step(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        if self.clip > 0:
            g = g * min(1.0, self.clip / (float(np.linalg.norm(g)) + 1e-6))
        g = g + self.decay * p
        self.steps += 1
        self.first = (1 - BETAS[0]) * g if self.first is None else BETAS[0] * self.first + (1 - BETAS[0]) * g
        self.second = (1 - BETAS[1]) * g * g if self.second is None else BETAS[1] * self.second + (1 - BETAS[1]) * g * g
        m, v = self.first / (1 - BETAS[0] ** self.steps), self.second / (1 - BETAS[1] ** self.steps)
        return p - self.lr * m / (np.sqrt(v) + ADAM_EPS)


@dataclass
class Plateau:
    """The learning rate falls by a factor when the value has not fallen by a ten-thousandth for more than `patience` epochs (0: never)."""

    patience: int = 0
    factor: float = 0.5
    best: float = math.inf
    bad: int = 0

    def after(self, value: float, lr: float) -> float:
        if self.patience <= 0:
            return lr
        if value < self.best * (1 - 1e-4):
            self.best, self.bad = value, 0
        else:
            self.bad += 1
        if self.bad > self.patience:
            self.bad = 0
            return lr * self.factor if lr - lr * self.factor > 1e-8 else lr
        return lr


@dataclass
class Model:
    net: Net
    parameters: np.ndarray
    history: list[dict] = field(default_factory=list)
    best_epoch: int = 0


def _matrix(batch, inputs: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)


def one_pass(laid: DataFrame, tasks: int, net: Net, flat: np.ndarray, loss: Loss, epoch: int, seed: int, scale: float, learn: bool = True) -> tuple[np.ndarray, dict[str, float]]:
    """(summed gradient over training rows, SUMS) at the parameters; the tree's levels are stages of one job."""
    shared = laid.sparkSession.sparkContext.broadcast(flat)  # bounded by the network

    def own(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total, sums, p = np.zeros(len(flat)), np.zeros(len(SUMS)), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = _matrix(part, net.inputs)
                ids, y, val, current, target = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("sample_id", "y", "is_val", "current", "target"))
                val = val.astype(bool)
                if learn and not val.all():
                    t = ~val
                    g, out = net.gradient(x[t], p, lambda o, t=t: loss.slope(o - y[t]), net.kept(ids[t], epoch, seed))
                    total += g
                    sums[:2] += t.sum(), loss.value(out - y[t]).sum()
                if val.any():
                    out = net.forward(x[val], p)["out"]
                    off = target[val] - (current[val] - out / scale)
                    sums[2:] += val.sum(), loss.value(out - y[val]).sum(), np.abs(off).sum(), (off * off).sum()
        yield _row(pa, TaskContext.get().partitionId(), sums, total)

    def added(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total, sums = np.zeros(len(flat)), np.zeros(len(SUMS))
        for batch in batches:
            for s, g in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                sums += s
                total += np.frombuffer(g.as_buffer())
        yield _row(pa, TaskContext.get().partitionId(), sums, total)

    schema = "task int, sums array<double>, gradient binary"
    parts = laid.mapInArrow(own, schema)
    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.repartitionById(tasks, F.expr(f"task div {FAN}").cast("int")).sortWithinPartitions("task").mapInArrow(added, schema)
    total, sums = np.zeros(len(flat)), np.zeros(len(SUMS))
    for row in parts.collect():  # one
        total, sums = total + np.frombuffer(bytes(row.gradient)), sums + row.sums
    shared.unpersist()
    return total, dict(zip(SUMS, sums.tolist(), strict=True))


def _row(pa, task: int, sums: np.ndarray, total: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([total.tobytes()], pa.binary())], names=["task", "sums", "gradient"])


def train(
    samples: DataFrame, net: Net, epochs: int = 50, lr: float = 1e-3, weight_decay: float = 1e-5, patience: int = 0, min_delta: float = 0.0, huber_delta: float | None = 0.02,
    clip_grad_norm: float = 1.0, lr_patience: int = 0, lr_factor: float = 0.5, seed: int = 42, reconstruct: bool = False, scale: float = 1.0, tasks: int | None = None, batches: int = 1,
) -> Model:
    """Train on samples (sample_id long, x array<double>, y double, is_val boolean [, current, target double]).

    Each epoch: a full-batch step, then the validation of its parameters. The state of the epoch that validated best is
    kept; `patience` epochs without an improvement of more than min_delta end the training (0: never). The value that
    decides is the mean loss or, with `reconstruct`, where y is `scale` times current - target, the mean absolute error
    of the value rebuilt, current - output / scale. Rows whose x is null, of another length or not finite, whose y is
    null, or whose sample_id or is_val is null take no part. Without a training or a validation row it raises.

    Training rows are dealt to `batches` by a hash of sample_id and seed, and their order is drawn anew each epoch; the
    training loss of an epoch is the mean of its steps'. Dropout is drawn by hash, so that the result does not depend on
    how samples are dealt to tasks beyond the rounding of sums.
    """
    tasks = tasks or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col("x").cast("array<double>")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in samples.columns else F.lit(0.0)
    rows = samples.filter(usable(x, net.inputs) & F.col("y").isNotNull() & ~F.isnan("y") & F.col("sample_id").isNotNull() & F.col("is_val").isNotNull())
    rows = rows.select(F.col("sample_id").cast("long").alias("sample_id"), x.alias("x"), F.col("y").cast("double").alias("y"), "is_val", number("current").alias("current"), number("target").alias("target"))
    loss, adam, plateau = Loss(huber_delta), Adam(lr, weight_decay, clip_grad_norm), Plateau(lr_patience, lr_factor)
    p, model, best, waited = net.start(seed), Model(net, np.zeros(0)), math.inf, 0
    one = lambda part, at, epoch, learn=True: one_pass(part, tasks, net, at, loss, epoch, seed, scale, learn)
    if batches == 1:
        laid = checkpointed(rows.repartition(tasks, "sample_id"))
        gradient, sums = one(laid, p, 1)
        counted = sums["n_train"], sums["n_val"]
    else:
        val = checkpointed(rows.filter("is_val").repartition(tasks, "sample_id"))
        dealt = rows.filter("not is_val").withColumn("_batch", batch_of(batches, seed))
        parts = [checkpointed(dealt.filter(F.col("_batch") == k).drop("_batch").repartition(tasks, "sample_id")) for k in range(batches)]
        parts = [part for part in parts if not part.isEmpty()]
        counted = len(parts), not val.isEmpty()
    if not all(counted):
        raise ValueError("training needs rows to learn from and rows to validate on")
    for epoch in range(1, epochs + 1):
        if batches == 1:
            train_loss = sums["train_loss"] / sums["n_train"]
            p = adam.step(p, gradient / sums["n_train"])
            gradient, sums = one(laid, p, epoch + 1, epoch < epochs)
        else:
            losses = []
            for k in random.Random(f"{seed}/{epoch}").sample(range(len(parts)), len(parts)):
                gradient, got = one(parts[k], p, epoch)
                losses.append(got["train_loss"] / got["n_train"])
                p = adam.step(p, gradient / got["n_train"])
            train_loss, sums = statistics.fmean(losses), one(val, p, epoch, False)[1]
        n = sums["n_val"]
        row = {"epoch": epoch, "train_loss": train_loss, "val_loss": sums["val_loss"] / n, "val_mae": sums["val_abs"] / n, "val_rmse": math.sqrt(sums["val_square"] / n)}
        decides = row["val_mae"] if reconstruct else row["val_loss"]
        adam.lr = plateau.after(decides, adam.lr)
        model.history.append(row | {"lr": adam.lr})
        if decides < best - min_delta:
            best, waited, model.parameters, model.best_epoch = decides, 0, p, epoch
        else:
            waited += 1
        if patience > 0 and waited >= patience:
            break
    if not model.best_epoch:  # no epoch's value was finite
        model.parameters = p
    return model


def batch_of(batches: int, seed: int) -> Column:
    """The batch of a sample, by a hash of its id and the seed."""
    return F.pmod(F.crc32(F.concat(F.lit(f"{seed}/"), F.col("sample_id").cast("string"))), F.lit(batches)).cast("int")


def applied(rows: DataFrame, model: Model, x: str = "x", name: str = "pred", layer: str | None = None, layer_name: str = "hidden") -> DataFrame:
    """rows with the network's output and, if asked for, one layer (norm, h1, a2 or h2) as an array of doubles; null where x does not fit."""
    from pyspark.sql import types as T

    net, shared = model.net, rows.sparkSession.sparkContext.broadcast(model.parameters)
    own = rows.withColumn("_x", F.when(usable(F.col(x).cast("array<double>"), net.inputs), F.col(x).cast("array<double>")))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType()), *([T.StructField(layer_name, T.ArrayType(T.DoubleType()))] if layer else [])])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            there = np.flatnonzero(pc.is_valid(vectors).to_numpy(zero_copy_only=False))
            out = np.full(batch.num_rows, np.nan)
            hidden: list = [None] * batch.num_rows
            for at in range(0, len(there), STEP):
                own = there[at : at + STEP]
                f = net.forward(vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, net.inputs), shared.value)
                out[own] = f["out"]
                for k, v in zip(own, f[layer] if layer else (), strict=False):
                    hidden[k] = v
            missing = np.ones(batch.num_rows, bool)
            missing[there] = False
            more = [pa.array(out, pa.float64(), mask=missing), *([pa.array(hidden, pa.list_(pa.float64()))] if layer else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], name, *([layer_name] if layer else [])])

    return own.mapInArrow(run, schema)


def history(spark, model: Model) -> DataFrame:
    """(epoch, train_loss, val_loss, val_mae, val_rmse, lr, is_best): one row per epoch."""
    rows = [(h["epoch"], h["train_loss"], h["val_loss"], h["val_mae"], h["val_rmse"], h["lr"], h["epoch"] == model.best_epoch) for h in model.history]
    return spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double, val_mae double, val_rmse double, lr double, is_best boolean")


def save(spark, model: Model, path: str, tables: dict[str, DataFrame] | None = None, document: dict | None = None) -> int:
    """Publish a network as an artefact: parameters, history, and what belongs to them (split, constants). The number of its version."""
    parameters = spark.createDataFrame([(n, v.ravel().tolist()) for n, v in model.net.views(model.parameters).items()], "name string, value array<double>")
    about = {"net": asdict(model.net), "best_epoch": model.best_epoch, "more": document or {}}
    return artefacts.publish(spark, path, {"parameters": parameters, "history": history(spark, model), **(tables or {})}, about)


def load(spark, path: str, version: int | None = None) -> Model:
    """The network of an artefact; a version that is not whole raises."""
    if hurt := artefacts.damaged(spark, path, version).limit(5).collect():
        raise ValueError(f"{path}: {', '.join(f'{r.file} {r.fault}' for r in hurt)}")
    about = json.loads(artefacts.document(spark, path, version).first()[0])
    net = Net(**about["net"])
    parts = dict(artefacts.table(spark, path, "parameters", version).collect())
    rows = artefacts.table(spark, path, "history", version).orderBy("epoch").drop("is_best").collect()
    return Model(net, np.concatenate([np.array(parts[n]) for n in net.shapes()]), [r.asDict() for r in rows], about["best_epoch"])


def register(name: str, model: Model, samples: DataFrame, x: str = "x") -> None:
    """Make a trained network a predictor of `predict.predict(name, samples)`, for tables of these columns; it adds `pred`."""
    from . import predict

    predict.register_table(name, lambda rows: applied(rows, model, x), [c for c in samples.columns if c == x])


def train_and_evaluate(samples: DataFrame, runs: list[dict], net: Net, by: tuple[str, ...] = ("seed", "horizon"), actual: str = "target", **options) -> DataFrame:
    """(by, model, n, RMSE, MAE, MAPE_percent, R2, best_epoch, n_epochs) of one network per run, trained on the run's samples and scored on its validation rows.

    A run names the values of `by`; those that samples have as columns select its samples, and `seed` seeds its start.
    Outputs are changes against `current`, divided by options' scale, as in training with reconstruct.
    """
    from ..operators import metrics

    out = None
    for run in runs:
        own = samples
        for k in by:
            own = own.filter(F.col(k) == F.lit(run[k])) if k in samples.columns else own.withColumn(k, F.lit(run[k]))
        model = train(own, net, seed=run.get("seed", 42), reconstruct=True, **options)
        scored = applied(own.filter("is_val"), model, name="change").withColumn("pred", F.col("current") - F.col("change") / F.lit(float(options.get("scale", 1.0))))
        row = metrics.strict_regression_metrics(scored, by, actual, "pred").select(*by, F.lit("flatten_mlp").alias("model"), "n", "RMSE", "MAE", "MAPE_percent", "R2")
        row = row.withColumn("best_epoch", F.lit(model.best_epoch)).withColumn("n_epochs", F.lit(len(model.history)))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no run")
    return out
