"""Synthetic melt-pool series: band-passed noise of several physical scales around a mean."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EFFECT = "name string, length_scale_m double, frequency_hz double, sigma_weight double"
LOW_EDGE, HIGH_EDGE = 1e-4, 0.999


def normalised(effects: DataFrame, sigma: float, scan_speed: float) -> DataFrame:
    """Effects with their centre frequency (speed over length, where a length is given) and share of ``sigma``; squared shares sum up."""
    total = effects.agg(F.sqrt(F.sum(F.col("sigma_weight") * F.col("sigma_weight"))).alias("norm"))
    f = F.when(F.col("length_scale_m").isNotNull(), F.lit(float(scan_speed)) / F.col("length_scale_m")).otherwise(F.col("frequency_hz"))
    return effects.crossJoin(F.broadcast(total)).select("name", "length_scale_m", f.alias("frequency_hz"), "sigma_weight", (F.col("sigma_weight") / F.col("norm") * F.lit(float(sigma))).alias("sigma_contribution"))


def band(f0: float, fs: float, bandwidth_fraction: float = 1.0) -> tuple[float, float]:
    """Edges around ``f0`` as fractions of the Nyquist frequency, clamped."""
    low, high = (f0 * (1 + s * bandwidth_fraction / 2) / (0.5 * fs) for s in (-1, 1))
    return (max(low, LOW_EDGE) if low > LOW_EDGE else LOW_EDGE), (HIGH_EDGE if high >= 1.0 else high)


def butterworth_band(order: int, low: float, high: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a Butterworth band-pass.

    Analog prototype, band transform and bilinear map; one section for each conjugate pole pair, with zeros at +1 and -1.
    """
    w1, w2 = (4 * math.tan(math.pi * e / 2) for e in (low, high))
    width, centre2 = w2 - w1, w1 * w2
    prototype = np.array([-np.exp(1j * math.pi * m / (2 * order)) for m in range(1 - order, order, 2)])
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre2 + 0j)
    analog = np.concatenate([half + root, half - root])
    poles = (4 + analog) / (4 - analog)
    gain = width**order * np.real(4.0**order / np.prod(4 - analog))
    upper = sorted((p for p in poles if p.imag > 1e-14), key=lambda p: abs(p))
    real = sorted(p.real for p in poles if abs(p.imag) <= 1e-14)
    sections = [[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper]
    sections += [[1.0, 0.0, -1.0, 1.0, -(a + b), a * b] for a, b in zip(real[::2], real[1::2])]
    out = np.array(sections)
    out[:, :3] *= abs(gain) ** (1 / len(out))
    return out


def filtered(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A causal cascade with zero initial state (a recurrence, so it runs sample by sample)."""
    y = np.asarray(x, float).tolist()
    for b0, b1, b2, _, a1, a2 in sections.tolist():
        s1 = s2 = 0.0
        out = []
        for v in y:
            o = b0 * v + s1
            s1 = b1 * v - a1 * o + s2
            s2 = b2 * v - a2 * o
            out.append(o)
        y = out
    return np.array(y)


def bandpass(series: DataFrame, f0: float, fs: float, order: int = 4) -> DataFrame:
    """``(series_id, n, value)`` of each series band-passed around ``f0``; a recurrence, so one series is one Arrow group."""
    sections = butterworth_band(order, *band(f0, fs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        return pd.DataFrame({"series_id": pdf["series_id"], "n": pdf["n"], "value": filtered(sections, pdf["value"].to_numpy())})

    return series.select("series_id", "n", "value").groupBy("series_id").applyInPandas(run, "series_id string, n long, value double")


class MeltPoolFilter:
    """A series of mean ``mu`` and target deviation ``sigma`` from named physical effects.

    ``timeseries_params`` is (sampling rate, duration).  ``add_effect(name, (length, frequency, weight))``, ``initialize``,
    then ``generate_fluctuations``.  All effects filter the same noise, so their components correlate.
    """

    def __init__(self, mu: float, sigma: float, scan_speed: float, timeseries_params, seed: int = 0):
        self.mu, self.sigma, self.scan_speed, self.seed = float(mu), float(sigma), float(scan_speed), seed
        self.fs, self.duration = map(float, timeseries_params)
        self.dt = 1 / self.fs
        self.n_points = int(self.duration / self.dt)
        self.physical_effects: dict[str, dict] = {}

    def add_effect(self, effect_name: str, effect_params) -> None:
        length, frequency, weight = effect_params
        if length is None and frequency is None:
            raise ValueError(f"effect {effect_name} needs a length scale or a frequency")
        self.physical_effects[effect_name] = {"length_scale_m": length, "frequency_hz": frequency, "sigma_weight": weight}

    def effects(self, spark: SparkSession) -> DataFrame:
        rows = [(n, *(None if e[c] is None else float(e[c]) for c in ("length_scale_m", "frequency_hz", "sigma_weight"))) for n, e in self.physical_effects.items()]
        return spark.createDataFrame(rows, EFFECT)

    def initialize(self, spark: SparkSession | None = None) -> None:
        if not self.physical_effects:
            raise ValueError("add an effect first")
        spark = spark or SparkSession.getActiveSession()
        for r in normalised(self.effects(spark), self.sigma, self.scan_speed).collect():
            self.physical_effects[r["name"]] |= {"frequency_hz": r["frequency_hz"], "sigma_contribution": r["sigma_contribution"]}
        top = max(e["frequency_hz"] for e in self.physical_effects.values())
        if top > self.fs / 2:
            raise ValueError(f"a series sampled at {self.fs:g} Hz cannot carry an effect of {top:g} Hz")

    def generate_fluctuations(self, noise_scale: float = 1.0, spark: SparkSession | None = None) -> DataFrame:
        """``(n, c0, c1)``: time and value; seeded noise, so a repeated task draws the same series."""
        spark = spark or SparkSession.getActiveSession()
        effects = [(e["frequency_hz"], e["sigma_contribution"]) for e in self.physical_effects.values()]
        n, fs, mu, seed, dt = self.n_points, self.fs, self.mu, self.seed, self.dt

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            noise = np.random.default_rng(seed).normal(0.0, noise_scale, n)
            total = np.zeros(n)
            for f0, share in effects:
                part = filtered(butterworth_band(4, *band(f0, fs)), noise)
                total += part * (share / part.std())
            return pd.DataFrame({"n": np.arange(n), "c0": np.arange(n) * dt, "c1": total + mu})

        return spark.range(1).groupBy("id").applyInPandas(run, "n long, c0 double, c1 double")
