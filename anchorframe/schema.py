"""Canonical relations (see README): names and types of the long match table and its companions."""

MATCHES = "mum_id bigint, seq_idx int, start bigint, length bigint, strand boolean"
WIDE = "mum_id bigint, length bigint, starts array<bigint>, strands array<boolean>"
CONTIGS = "seq_idx int, contig_idx int, contig string, length bigint, offset bigint, path string"
REGIONS = "region_id bigint, seq_idx int, start bigint, end bigint"
BED = "contig string, start bigint, end bigint, path string"
