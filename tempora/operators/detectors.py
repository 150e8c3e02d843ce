"""Declared detectors: a running baseline per series and slot of a season, with verdict rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.buckets import micros, parse_width
from tempora.session import ship

_VERDICT = "value double, baseline double, stddev double, z double, cusum_pos double, cusum_neg double, anomaly boolean, reason string, slot bigint"


@dataclass
class Detector:
    """zscore flags |z| over the threshold; cusum flags sums of z beyond ``h`` with allowance ``k``.

    A value is judged against the mean and deviation of the values before it in its slot (season split into
    slots); an outlier is not folded in; ``half_life`` (values) forgets the past.
    """

    name: str
    field: str
    time: str
    group_by: list[str] = field(default_factory=list)
    method: str = "zscore"
    threshold: float = 3.0
    min_samples: int = 10
    season: str | None = None
    slot: str | None = None
    h: float = 5.0
    k: float = 0.5
    half_life: float | None = None
    where: str | None = None

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """(group, time, verdict columns), one per value; a series is walked in one task."""
        ship(rows.sparkSession)
        if self.where:
            rows = rows.where(self.where)
        size = parse_width(self.season).micros or parse_width(self.season).days * 86400 * 10**6 if self.season else 1
        width = (parse_width(self.slot).micros or parse_width(self.slot).days * 86400 * 10**6) if self.slot else size
        slot = F.floor(F.pmod(micros(F.col(self.time)), F.lit(size)) / width) if self.season else F.lit(0).cast("long")
        used = rows.where(F.col(self.field).isNotNull()).select(*self.group_by, self.time, F.col(self.field).cast("double").alias("value"), slot.cast("long").alias("slot"))
        detector, names = self, [*self.group_by, self.time]
        fields = [used.schema[n] for n in names] + T._parse_datatype_string(_VERDICT).fields

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(detector.time, kind="stable").reset_index(drop=True)
            made = detector._walk(pdf["value"].to_numpy(float), pdf["slot"].to_numpy())
            return pd.concat([pdf[names], made], axis=1)

        return used.groupBy(*self.group_by).applyInPandas(walk, T.StructType(fields))

    def _walk(self, values: np.ndarray, slots: np.ndarray) -> pd.DataFrame:
        keep = 0.5 ** (1 / self.half_life) if self.half_life else 1.0
        state: dict[int, list[float]] = {}
        up = down = 0.0
        out = []
        for value, slot in zip(values.tolist(), slots.tolist(), strict=True):
            n, weight, mean, m2 = state.get(slot, (0, 0.0, 0.0, 0.0))
            ready = n >= self.min_samples and weight > 1
            std = max((m2 / (weight - 1)) ** 0.5, abs(mean) * 1e-9, 1e-12) if ready else None
            z = (value - mean) / std if ready else None
            outlier = ready and abs(z) > self.threshold
            if ready:
                up, down = max(0.0, up + z - self.k), max(0.0, down - z - self.k)
            reason = "zscore" if outlier and self.method == "zscore" else "cusum" if self.method == "cusum" and max(up, down) > self.h else None
            out.append((value, mean if n else None, std, z, up, down, reason is not None, reason, slot))
            if reason == "cusum":
                up = down = 0.0
            if not outlier:
                weight, m2 = weight * keep + 1, m2 * keep
                delta = value - mean
                mean += delta / weight
                state[slot] = [n + 1, weight, mean, m2 + delta * (value - mean)]
        return pd.DataFrame(out, columns=["value", "baseline", "stddev", "z", "cusum_pos", "cusum_neg", "anomaly", "reason", "slot"])
