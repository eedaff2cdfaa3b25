"""Column functions: regions, names, strands, digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_REGION = r"^(.*):(\d+)-(\d+)$"


def region_contig(region: Column) -> Column:
    """Contig of ``contig:start-end``; the contig may contain colons."""
    return F.regexp_extract(region, _REGION, 1)


def region_start(region: Column) -> Column:
    return F.regexp_extract(region, _REGION, 2).cast("bigint")


def region_end(region: Column) -> Column:
    return F.regexp_extract(region, _REGION, 3).cast("bigint")


def is_url(path: Column) -> Column:
    return path.rlike("^https?://")


def interval_text(contig: Column, start: Column, end: Column) -> Column:
    """1-based inclusive ``contig:lo-hi`` of a half-open interval; null where it would be empty or negative."""
    return F.when((start >= 0) & (end > start), F.concat(contig, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string")))


def fasta_header(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit(">"), contig, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


def safe_name(text: Column, size: int = 200) -> Column:
    """Runs of characters other than ASCII word characters, dot and hyphen become one underscore."""
    clean = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_"), F.lit("._"))
    return F.substring(F.when(clean == "", F.lit("region")).otherwise(clean), 1, size)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", "")


def extension(path: Column, default: str = ".fa") -> Column:
    ext = F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1)
    return F.when(ext == "", F.lit(default)).otherwise(ext)


def extract_name(path: Column, slug: Column | None = None) -> Column:
    """``{stem}_extract{ext}``, with the slug before the extension if one is given."""
    middle = F.lit("_extract") if slug is None else F.concat(F.lit("_extract_"), slug)
    return F.concat(_stem(path), middle, extension(path))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def mirrored(start: Column, length: Column, strand: Column, total: Column) -> Column:
    """Start on the reverse strand's own axis for reverse matches."""
    return F.when(strand, start).otherwise(total - start - length)


def little_endian(x: Column) -> Column:
    """16 hex digits of a 64-bit number, least significant byte first."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


def haplotype(path: Column, chromosome: str) -> Column:
    """Name parts of a genome file, as sample.haplotype; one sample is published under another name."""
    name = F.element_at(F.split(base_name(F.element_at(F.split(path, r"\s+"), 1)), f"_{chromosome}"), 1)
    # Fixed value: the reference assembly's file name and its published parts.
    return F.when(name == "chm13", F.array(F.lit("CHM13"), F.lit("1"), F.lit(chromosome))).otherwise(F.concat(F.split(name, r"\."), F.array(F.lit(chromosome))))
