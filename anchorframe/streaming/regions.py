"""Regions as a stream, joined to a static match table (stateless)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.intervals import overlap_join

REGIONS = "region_id bigint, seq_idx int, start bigint, end bigint"


def stream_overlaps(regions: DataFrame, mums: DataFrame) -> DataFrame:
    """Overlaps of every streamed region: the batch join works on streams as it is (explode and equi-join only)."""
    return overlap_join(regions, mums)
