"""Synteny drawings: polygons between neighbouring genomes as a picture any browser shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WIDTH, ROW = 1000.0, 100.0


def write_polygons(corners: DataFrame, lengths: DataFrame, path: str) -> None:
    """One SVG file from ``corners`` (block, seq_idx, x0, x1 in this genome, y0, y1 in the next) and ``lengths`` (seq_idx,
    total). Each genome is a line of the picture's width; inverted stretches cross. Lines are written by one task, in order."""
    totals = lengths.select("seq_idx", "total")
    most = totals.agg(F.max("total").alias("t"), F.max("seq_idx").alias("n")).first()
    scale, height = WIDTH / max(most.t or 1, 1), ROW * ((most.n or 0) + 1)
    x = lambda c: F.format_string("%.2f", F.col(c) * scale)
    y = lambda k: F.format_string("%.0f", (F.col("seq_idx") + k) * ROW + ROW / 2)
    point = lambda c, k: F.concat(x(c), F.lit(","), y(k))
    polygon = F.concat(F.lit('<polygon fill-opacity="0.5" points="'), F.concat_ws(" ", point("x0", 0), point("x1", 0), point("y1", 1), point("y0", 1)), F.lit('"/>'))
    shapes = corners.select(F.lit(1).alias("k"), "seq_idx", F.col("block").alias("b"), polygon.alias("value"))
    at = F.format_string("%.0f", F.col("seq_idx") * ROW + ROW / 2)
    line = F.concat(F.lit('<line stroke="black" x1="0" y1="'), at, F.lit('" x2="'), F.format_string("%.2f", F.col("total") * scale), F.lit('" y2="'), at, F.lit('"/>'))
    lines = totals.select(F.lit(0).alias("k"), "seq_idx", F.lit(-1).cast("bigint").alias("b"), line.alias("value"))
    head = [(-1, 0, 0, f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH:.0f} {height:.0f}">'), (2, 0, 0, "</svg>")]
    frame = corners.sparkSession.createDataFrame(head, "k int, seq_idx int, b bigint, value string")
    frame.unionByName(lines).unionByName(shapes).coalesce(1).sortWithinPartitions("k", "seq_idx", "b").select("value").write.mode("overwrite").text(path)
