"""Truncated Fourier spectra of melt-pool series, and the melt pool made of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.schema import DIMS, MeltPoolSpec

def summary(series: DataFrame) -> DataFrame:
    """``(series_id, n_samples, mean, dt)``; the step is that of the first two samples."""
    return series.groupBy("series_id").agg(
        F.count("*").alias("n_samples"), F.avg("value").alias("mean"),
        (F.max(F.when(F.col("n") == 1, F.col("t"))) - F.max(F.when(F.col("n") == 0, F.col("t")))).alias("dt"),
    )


def modes_sql(series: DataFrame, n_modes: int) -> DataFrame:
    """``(series_id, k, amplitude, frequency, phase)`` of modes 0 to ``n_modes - 1`` as grouped sums of cosines and sines.

    Mode 0 is (mean, 0, 0); amplitudes are one-sided, without the factor 2.  Every sample meets every mode map-side, and only
    partial sums are shuffled.
    """
    sums = summary(series)
    if n_modes > 1:
        few = sums.select("series_id", "n_samples").where(F.col("n_samples") < n_modes).limit(1).collect()
        if few:
            raise ValueError(f"series {few[0]['series_id']} has fewer samples than modes")
    base = sums.select("series_id", F.lit(0).alias("k"), F.col("mean").alias("amplitude"), F.lit(0.0).alias("frequency"), F.lit(0.0).alias("phase"))
    if n_modes <= 1:
        return base
    joined = series.join(sums.select(F.col("series_id").alias("sid"), "n_samples", "dt"), F.col("series_id") == F.col("sid"))
    each = joined.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_modes - 1))))
    # the angle is reduced in integers first, so long series keep their precision
    angle = F.lit(2 * math.pi) * ((F.col("k") * F.col("n")) % F.col("n_samples")).cast("double") / F.col("n_samples")
    parts = each.groupBy("series_id", "k", "n_samples", "dt").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), (-F.sum(F.col("value") * F.sin(angle))).alias("im"))
    n = F.col("n_samples")
    rest = parts.select("series_id", "k", (F.hypot("re", "im") / n).alias("amplitude"), (F.col("k") / (F.col("dt") * n)).alias("frequency"), F.atan2("im", "re").alias("phase"))
    return base.unionByName(rest)


def modes_fft(series: DataFrame, n_modes: int) -> DataFrame:
    """The same spectra by FFT: one series is one Arrow group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        v, n = pdf["value"].to_numpy(), len(pdf)
        if n_modes > n and n_modes > 1:
            raise ValueError(f"series {pdf['series_id'].iloc[0]} has fewer samples than modes")
        amplitude, frequency, phase = [float(v.mean())], [0.0], [0.0]
        if n_modes > 1:
            f = np.fft.fft(v)[1:n_modes]
            dt = pdf["t"].iloc[1] - pdf["t"].iloc[0]
            amplitude += list(np.abs(f) / n)
            frequency += list(np.arange(1, n_modes) / (dt * n))
            phase += list(np.angle(f))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "k": np.arange(len(amplitude), dtype=np.int32), "amplitude": amplitude, "frequency": frequency, "phase": phase})

    return series.groupBy("series_id").applyInPandas(run, "series_id string, k int, amplitude double, frequency double, phase double")


def compute_spectral_components(series: DataFrame, n_modes: int, method: str = "fft") -> DataFrame:
    """Spectra of all series by ``fft`` or ``sql``; one mode, or none, is the mean alone."""
    return modes_fft(series, max(1, n_modes)) if method == "fft" else modes_sql(series, max(1, n_modes))


def padded(modes: DataFrame, n_modes: int) -> DataFrame:
    """Modes of each ``dim`` filled with zeros up to ``n_modes`` rows."""
    spark = modes.sparkSession
    every = modes.select("dim").distinct().crossJoin(F.broadcast(spark.range(n_modes).select(F.col("id").cast("int").alias("k"))))
    return every.join(modes, ["dim", "k"], "left").select("dim", "k", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("amplitude", "frequency", "phase")]).unionByName(modes.where(F.col("k") >= n_modes).select("dim", "k", "amplitude", "frequency", "phase"))


def scaled(modes: DataFrame, scale: float) -> DataFrame:
    """Amplitudes times ``scale``, the mean included."""
    return modes.withColumn("amplitude", F.col("amplitude") * F.lit(float(scale)))


def bounds(modes: DataFrame) -> DataFrame:
    """``(dim, mean, maximum, n_modes)``: mode 0 and the sum of amplitudes."""
    return modes.groupBy("dim").agg(F.max(F.when(F.col("k") == 0, F.col("amplitude"))).alias("mean"), F.sum("amplitude").alias("maximum"), F.count("*").alias("n_modes"))


def pool_from_modes(modes: DataFrame, shapes: dict[str, float] | None = None, random_phases: bool = False, seed: int = 0) -> MeltPoolSpec:
    """The driver-side pool of a ``mode`` table; it has three times the configured number of modes as rows."""
    found: dict[str, list] = {d: [] for d in DIMS}
    for r in modes.orderBy("dim", "k").collect():
        found[r["dim"]].append((r["amplitude"], r["frequency"], r["phase"]))
    shapes = shapes or {}
    return MeltPoolSpec({d: tuple(m) for d, m in found.items()}, shapes.get("width", 2.0), shapes.get("depth", 2.0), shapes.get("height", 2.0), random_phases, seed)


def create_melt_pool(inputs: dict, enable_random_phases: bool = True, seed: int = 0) -> MeltPoolSpec:
    """A pool from ``{dim: (table, n_modes, scale, shape)}``.

    A two-column table (from ``read_data``) is a series: it is transformed, truncated to its lowest modes and scaled.  A
    three-column one is a spectrum and taken as it is.  All are padded with zeros to the longest.
    """
    from meltfield.sources.series import as_series, kind_of

    missing = set(DIMS) - set(inputs)
    if missing:
        raise ValueError(f"melt pool data lacks {', '.join(sorted(missing))}")
    modes, shapes = {}, {}
    most = max(int(n) for _, n, _, _ in inputs.values())
    for dim, (table, n_modes, scale, shape) in inputs.items():
        if kind_of(table) == "series":
            if table.limit(2).count() < 2:
                raise ValueError(f"the {dim} series needs at least two samples")
            rows = scaled(compute_spectral_components(as_series(table, dim), int(n_modes)), scale).orderBy("k").collect()
            modes[dim] = [(r["amplitude"], r["frequency"], r["phase"]) for r in rows]
        else:
            modes[dim] = [(r["c0"], r["c1"], r["c2"]) for r in table.orderBy("n").collect()]
        modes[dim] += [(0.0, 0.0, 0.0)] * (most - len(modes[dim]))
        shapes[dim] = float(shape)
    return MeltPoolSpec({d: tuple(m) for d, m in modes.items()}, shapes["width"], shapes["depth"], shapes["height"], enable_random_phases, seed)
