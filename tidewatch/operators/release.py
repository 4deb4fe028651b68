"""The public view: what is due, where it roughly was, and nothing that would tell more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def released(reports: DataFrame, done: DataFrame, as_of, salt: str, holdback: str = "3 HOURS", batch: int | None = None) -> DataFrame:
    """(id, ts, rough_lat, rough_lng, level, status, region, summary) of reports (id, ts, lat, lon, confidence, held, region, event_type) that may be published now.

    Ids in ``done`` were published before. ``held`` reports wait for the holdback. Positions move by up to 0.02 degrees either way, as the digest of the
    id under the caller's secret ``salt`` says, and are rounded to hundredths; without the salt the move cannot be told. With ``batch`` the
    newest so many of what is due come, after those published before are left out, so that older ones do not starve.
    """
    due = reports.where(~F.col("held") | (F.col("ts") <= F.lit(as_of) - F.expr(f"INTERVAL {holdback}"))).join(done.select("id"), "id", "left_anti")
    if batch is not None:
        due = due.orderBy(F.desc("ts"), F.desc("id")).limit(batch)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    coarse = lambda x: F.floor(x * 100 + 0.5) / 100.0
    shift = lambda x: (x % 1000 / 1000.0 - 0.5) * 0.04
    level = F.when(F.col("confidence") >= 80, "HIGH").when(F.col("confidence") >= 50, "MEDIUM").otherwise("LOW")
    status = F.when(F.col("confidence") >= 80, "CONFIRMED").otherwise("PRELIMINARY")
    summary = F.concat(F.col("event_type"), F.lit(" reported in region "), F.col("region"))
    return due.select("id", "ts", coarse(F.col("lat") + shift(h)).alias("rough_lat"), coarse(F.col("lon") + shift(F.shiftright(h, 10))).alias("rough_lng"), level.alias("level"), status.alias("status"), "region", summary.alias("summary"))
