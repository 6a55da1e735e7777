"""Array kernels on the curves of one cycle. All are expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fewest finite points of a usable curve, and cycles that a reference capacity is averaged over.
LEAST_POINTS, REFERENCE_CYCLES = 5, 5
LARGEST_SOH = 1.5


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside lambdas an expression is computed at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite_points(a: Column) -> Column:
    """The array without null, NaN and infinite points; a missing array is empty."""
    kept = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(kept, F.expr("cast(array() as array<float>)"))


def gradient(a: Column) -> Column:
    """Central differences, one-sided at the ends; null under two points."""

    def slopes(v: Column) -> Column:
        n = F.size(v)
        inner = lambda i: F.get(v, F.least(i + 1, n - 1)) - F.get(v, F.greatest(i - 1, F.lit(0)))
        width = lambda i: F.when((i == 0) | (i == n - 1), 1.0).otherwise(2.0)
        return F.when(n >= 2, F.transform(v, lambda _, i: inner(i) / width(i)))

    return let(a, slopes)


def resample_linear(a: Column, length: int) -> Column:
    """The curve at `length` even places from its first to its last point; null under two points."""
    if length < 1:
        raise ValueError("length is at least 1")

    def curve(v: Column) -> Column:
        n = F.size(v)

        def at(k: Column) -> Column:
            place = k * (n - 1) / F.lit(float(max(1, length - 1)))
            low = F.least(F.floor(place).cast("int"), n - 2)
            a0 = F.get(v, low).cast("double")
            return a0 + (F.get(v, low + 1).cast("double") - a0) * (place - low)

        return F.when(n >= 2, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))

    return let(a, curve)


def capacity_soh(q: Column, reference: Column) -> Column:
    """State of health: the largest finite capacity over the reference; null if out of (0, 1.5) or under five points."""

    def label(points: Column) -> Column:
        soh = F.try_divide(F.array_max(points).cast("double"), reference.cast("double"))
        return F.when((F.size(points) >= LEAST_POINTS) & (soh > 0) & (soh < LARGEST_SOH), soh)

    return let(finite_points(q), label)


def reference_capacity(nominal: Column, q: Column, position: Column, *by: str) -> Column:
    """A file's reference: the nominal capacity if finite and positive, else the mean of the largest capacity over its
    first five cycles (by position) that have points enough. A window aggregate over `by`."""
    nominal = nominal.cast("double")
    points = finite_points(q)
    early = F.when((position < REFERENCE_CYCLES) & (F.size(points) >= LEAST_POINTS), F.array_max(points).cast("double"))
    given = F.when(~F.isnan(nominal) & (nominal > 0) & (nominal < float("inf")), nominal)
    return F.coalesce(given, F.avg(early).over(W.partitionBy(*by)))


def features(v: Column, i: Column, length: int, q: Column | None = None, order: str = "VI") -> Column:
    """struct of three curves of `length` points: voltage, current and the voltage's gradient, or capacity if q is given.

    Voltage and current are filtered each for itself and then cut to the shorter; null under five
    common points. `order` names the first two fields' order: VI for the windowed track, IV for the
    fixed-origin one.
    """
    if order not in ("VI", "IV"):
        raise ValueError("order is VI or IV")
    curves = F.array(finite_points(v), finite_points(i), *([] if q is None else [finite_points(q)]))

    def cut(c: Column) -> Column:
        n = F.array_min(F.transform(c, lambda a: F.size(a)))
        return F.transform(c, lambda a: F.slice(a, 1, n))

    def built(c: Column) -> Column:
        cv, ci = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        third = gradient(cv) if q is None else F.get(c, F.lit(2))
        first = [resample_linear(cv, length).alias("v"), resample_linear(ci, length).alias("i")]
        return F.when(F.size(cv) >= LEAST_POINTS, F.struct(*(first if order == "VI" else first[::-1]), resample_linear(third, length).alias("x")))

    return let(let(curves, cut), built)


def usable_cycles(cells: DataFrame, length: int) -> DataFrame:
    """One row per usable cycle of nested cell files: file, cell_id, ord, cycle_number, reference_capacity, soh, feature.

    Cycles are ordered by number, those without one last, and then counted from 1; a missing id is the
    file's stem. Cycles without a valid feature or label are left out.
    """
    rows = cells.select("file", F.coalesce("cell_id", F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)).alias("cell_id"), "nominal_capacity_in_Ah", F.size("cycle_data").alias("n"), F.posexplode("cycle_data").alias("place", "c"))
    order = W.partitionBy("file").orderBy(F.coalesce("c.cycle_number", "n"), "place")
    rows = rows.withColumn("position", F.row_number().over(order) - 1)
    rows = rows.withColumn("reference_capacity", reference_capacity(F.col("nominal_capacity_in_Ah"), F.col("c.discharge_capacity_in_Ah"), F.col("position"), "file"))
    rows = rows.select("file", "cell_id", F.col("position").alias("ord"), F.coalesce("c.cycle_number", F.col("position") + 1).alias("cycle_number"), "reference_capacity", capacity_soh(F.col("c.discharge_capacity_in_Ah"), F.col("reference_capacity")).alias("soh"), features(F.col("c.voltage_in_V"), F.col("c.current_in_A"), length).alias("feature"))
    return rows.filter(F.col("soh").isNotNull() & F.col("feature").isNotNull())
