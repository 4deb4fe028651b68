"""A generic constant-velocity smoother over dated positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUIET_S = 3 * 3600


class Filter:
    """Predicts and corrects (x, y, vx, vy) of one track; lengths in km, times in hours."""

    def __init__(self, noise_km: float, drift_kmh: float):
        self.noise, self.drift = noise_km**2, drift_kmh**2
        self.track = self.t = self.state = self.cov = None

    def __call__(self, track, t: float, x: float, y: float) -> tuple[float, float, float, float, float]:
        if track != self.track:
            self.track, self.t = track, t
            self.state = np.array([x, y, 0.0, 0.0])
            self.cov = np.diag([self.noise, self.noise, self.drift, self.drift])
        else:
            h, self.t = t - self.t, t
            move = np.eye(4)
            move[0, 2] = move[1, 3] = h
            spread = np.zeros((4, 4))
            for p, v in ((0, 2), (1, 3)):
                spread[p, p], spread[p, v], spread[v, p], spread[v, v] = h**3 / 3, h**2 / 2, h**2 / 2, h
            self.state, self.cov = move @ self.state, move @ self.cov @ move.T + self.drift * spread
            gain = self.cov[:, :2] @ np.linalg.inv(self.cov[:2, :2] + self.noise * np.eye(2))
            self.state = self.state + gain @ (np.array([x, y]) - self.state[:2])
            self.cov = self.cov - gain @ self.cov[:2]
        speed_sigma = float(np.sqrt((self.cov[2, 2] + self.cov[3, 3]) / 2))
        return (*map(float, self.state), speed_sigma)


def smooth(points: DataFrame, noise_km: float = 5.0, drift_kmh: float = 60.0, quiet_s: int = QUIET_S) -> DataFrame:
    """(track, id, x, y, vx, vy, sigma) of positions (track, id, t seconds, x, y in km), in order of (t, id).

    Late rows take their place in the order. A track starts anew after a quiet stretch, so that a
    busy track is many stretches over many tasks. Rows without time or position are left out.
    """
    known = points.where("t is not null and x is not null and y is not null")
    order = Window.partitionBy("track").orderBy("t", "id")
    new = F.coalesce(F.col("t") - F.lag("t").over(order) > quiet_s, F.lit(True)).cast("int")
    cut = known.withColumn("_new", new).withColumn("_part", F.sum("_new").over(order)).select("track", "_part", "id", "t", "x", "y")
    cut = cut.repartition("track", "_part").sortWithinPartitions("track", "_part", "t", "id")
    kinds = dict(points.dtypes)
    schema = T.StructType.fromDDL(f"track {kinds['track']}, id {kinds['id']}, x double, y double, vx double, vy double, sigma double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Filter(noise_km, drift_kmh)
        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("track", "_part", "t", "x", "y")), strict=True)
            out = [step((track, part), t / 3600.0, x, y) for track, part, t, x, y in rows]
            values = [pa.array([r[i] for r in out], pa.float64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b["track"], b["id"], *values], names=["track", "id", "x", "y", "vx", "vy", "sigma"])

    return cut.mapInArrow(work, schema)
