"""Command line over match tables kept as Parquet (long form) or in the binary format.

Every command reads a table, applies one operator and writes Parquet, text or JSON; errors end with status 1.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.ordered import ranked, shared
from .operators import collinear, coords, enhance as en, gaps, intervals, layout, liftover, segment, seqs
from .sources import archive, binindex, fasta as fa, fastaindex, matchfile, svg, text

VERSION = "0.1.0"
# File extensions of the binary format, of its text form and of their companions.
BINARY, TEXT, INDEX, LENGTHS, COMPANIONS = ".bumbl", ".mums", ".bi", ".lengths", (".lengths", ".athresh", ".thresh", ".bumbl.bi")


def load(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """A match table; of a binary one only the rows of ``ranges``, if given."""
    if path.endswith(BINARY):
        matchfile.register(spark)
        r = spark.read.format("matchfile")
        if ranges is not None:
            r = r.option("ranges", ",".join(f"{lo}-{hi}" for lo, hi in ranges))
        return r.load(path)
    return spark.read.parquet(path)


def stored_blocks(spark: SparkSession, path: str) -> DataFrame | None:
    """Blocks that a binary table brings with it."""
    if path.endswith(BINARY) and matchfile.read_header(path).num_blocks:
        return matchfile.read_blocks(spark, path)
    return None


def in_order(df: DataFrame) -> tuple[DataFrame, bool]:
    """The table sorted by the first genome, and whether it was so already."""
    df = collinear.facing_forward(df)
    if not layout.disorder(df.where("seq_idx = 0")).where("n_violations > 0").count():
        return df, True
    return reordered(df, layout.sort_by_genome(df, 0, absent=True)), False


def with_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The table in the order of the first genome and its blocks: those it brings, if it was in order, else found ones."""
    df, was = in_order(load(spark, path))
    blocks = stored_blocks(spark, path) if was else None
    if blocks is None:
        df = shared(df)
        blocks = shared(collinear.collinear_blocks(df, genomes(df)))
    return df, blocks


def say(lines: DataFrame) -> None:
    """Lines to standard output, a partition at a time."""
    for r in lines.toLocalIterator():
        print(r.value)


def save(df: DataFrame, path: str | None, form: str | None = None, blocks: list[tuple[int, int]] | None = None) -> None:
    """Binary, text or Parquet: by ``form``, else by extension; text to standard output without a path."""
    form = form or ("text" if path is None or path.endswith(TEXT) else "binary" if path.endswith(BINARY) else "parquet")
    if path is None:
        if form != "text":
            raise ValueError(f"{form} output needs a path")
        say(text.match_lines(df).orderBy("mum_id").select("value"))
    elif form == "binary":
        matchfile.write(df, path, blocks)
    elif form == "text":
        text.write_matches(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def target(a) -> str:
    """Where a command that rewrites a table writes it: --out, the table itself, or a name beside it."""
    if a.in_place and a.out:
        raise ValueError("cannot use both --in-place and --out")
    if a.in_place and not a.table.endswith(BINARY):
        raise ValueError("only a binary table can be replaced in place")
    stem, ext = os.path.splitext(a.table.rstrip("/"))
    return a.table if a.in_place else a.out or f"{stem}.sorted{ext}"


def companion(a, given: str | None, extension: str, whole: bool) -> str:
    """A companion file: as given, else beside the table (after its whole name, or in place of its extension)."""
    path = given or (a.table if whole else os.path.splitext(a.table)[0]) + extension
    if not matchfile.is_url(path) and "://" not in path and not os.path.exists(path):
        raise ValueError(f"{path} not found" + ("" if given else ", and none given"))
    return path


def manifest(spark: SparkSession, a) -> DataFrame:
    path = companion(a, a.lengths, LENGTHS, False)
    if matchfile.is_url(path):  # one small file, a line per contig
        data = matchfile.read_at(path, 0, matchfile.size_of(path)).decode()
        return shared(text.manifest_of(spark.createDataFrame([(x,) for x in data.splitlines()], "value string").coalesce(1)))
    return shared(text.read_manifest(spark, path))


def genomes(df: DataFrame) -> int:
    return (df.agg(F.max("seq_idx")).first()[0] if df.columns else -1) + 1


def check_genome(df: DataFrame, seq_idx: int) -> None:
    n = genomes(df)
    if not 0 <= seq_idx < n:
        raise ValueError(f"genome {seq_idx} is not in 0..{n - 1}")


def reordered(df: DataFrame, order: DataFrame) -> DataFrame:
    """Rows with new numbers (mum_id, new_id)."""
    return df.join(order.select("mum_id", "new_id"), "mum_id").select(F.col("new_id").alias("mum_id"), "seq_idx", "start", "length", "strand")


def sort(spark, a):
    df = load(spark, a.table)
    check_genome(df, a.seq)
    if a.verify:
        bad = layout.disorder(df).where(F.col("seq_idx") == a.seq).first().n_violations
        print("sorted" if not bad else f"not sorted: {bad} rows out of order", file=sys.stderr)
        return int(bad > 0)
    out = target(a)
    save(reordered(df, layout.sort_by_genome(df, a.seq, absent=True)), out, a.format)


def filter_(spark, a):
    out = target(a)
    df, blocks = with_blocks(spark, a.table)
    kept = reordered(df, collinear.filter_collinear(blocks))
    new = [(r.new_s, r.new_e) for r in collinear.renumbered(blocks).orderBy("s").collect()] if out.endswith(BINARY) else None  # the file's block list
    save(kept, out, a.format, new)
    print(json.dumps(collinear.collinear_share(blocks, df).first().asDict()), file=sys.stderr)


def index(spark, a):
    df = load(spark, a.table)
    if a.verify:
        return int(not binindex.verify(df, a.out))
    if a.single is not None:
        check_genome(df, a.single)
        if layout.disorder(df).where(F.col("seq_idx") == a.single).first().n_violations:
            raise ValueError("the table is not sorted by this genome")
        binindex.write_one(df, a.single, a.width, a.out)
    else:
        binindex.write_all(df, a.width, a.out)


def _regions(spark, a) -> tuple[DataFrame, DataFrame]:
    contigs = manifest(spark, a)
    r = spark.createDataFrame([(i, a.seq, x) for i, x in enumerate(a.region)], "region_id bigint, seq_idx int, region string")
    g = shared(coords.to_global(r, contigs))
    for bad in g.where("reason is not null").collect():  # a row per region on the command line
        raise ValueError(f"region {a.region[bad.region_id]}: {bad.reason}")
    return g.select("region_id", "seq_idx", F.col("g_start").alias("start"), F.col("g_end").alias("end")), contigs


def subset(spark, a):
    regions, _ = _regions(spark, a)
    ranges = None
    if a.table.endswith(BINARY) and (a.index or os.path.exists(a.table + INDEX)):
        path = companion(a, a.index, INDEX, True)
        ranges = [x for r in regions.collect() for x in binindex.rows_of(spark, path, a.seq, r.start, r.end - 1)]
        n = matchfile.read_header(a.table).n_seqs
        if not 0 <= a.seq < n:
            raise ValueError(f"genome {a.seq} is not in 0..{n - 1}")
    df = load(spark, a.table, ranges)
    if ranges is None:
        check_genome(df, a.seq)
    ids = intervals.overlap_join(regions, df).select("mum_id").distinct()
    order = seqs_of(ids)
    save(reordered(df, order), a.out, a.format)


def seqs_of(ids: DataFrame) -> DataFrame:
    """mum_id and new_id, its place among ``ids``."""
    return ranked(ids, [], ["mum_id"], "new_id")


def extract(spark, a):
    df = load(spark, a.table)
    check_genome(df, a.seq)
    regions, contigs = _regions(spark, a)
    bounds = liftover.offsets(liftover.bounds(regions, df)).collect()  # a row per region on the command line
    if not bounds:
        raise ValueError("no bounding matches")
    for r in bounds:
        print(f"{a.region[r.region_id]}: left margin {r.left_margin}, right margin {r.right_margin}", file=sys.stderr)
    lifted = liftover.liftover(regions, df, strand_aware=a.stranded)
    if a.sequences:
        lifted = liftover.pick_sequences(lifted, a.sequences)
    local = coords.to_local(lifted, contigs).where("reason is null").join(contigs.select("seq_idx", "contig", "path"), ["seq_idx", "contig"])
    bed = local.select("contig", F.col("l_start").alias("start"), F.col("l_end").alias("end"), "path")
    if a.out:
        text.write_bed(bed, a.out)
    else:
        say(text.bed_lines(bed))


def shred(spark, a):
    contigs = manifest(spark, a)
    df, blocks = with_blocks(spark, a.table)
    rows = shared(collinear.block_rows(blocks).select("mum_id"))
    strips = segment.shred_intervals(segment.shred_cuts(rows, df, contigs, a.size), contigs).withColumn("end_incl", F.col("end") - 1)
    local = coords.to_local(strips, contigs).where("reason is null").join(contigs.select("seq_idx", "contig", "path"), ["seq_idx", "contig"])
    text.write_bed(local.select("seq_idx", "cut_id", "contig", F.col("l_start").alias("start"), F.col("l_end").alias("end"), "path"), a.out, "seq_idx" if a.per_sequence else "cut_id")


def gaps_(spark, a):
    df, blocks = with_blocks(spark, a.table)
    g = shared(gaps.gaps(blocks, df))
    chosen = gaps.to_enhance(g, a.min_gap).select("gap")
    g.join(chosen, "gap").join(gaps.outliers(g, a.outlier_factor).select("gap", "seq_idx", "masked"), ["gap", "seq_idx"]).write.mode("overwrite").parquet(a.out)


def fetched(spark, bed: DataFrame, table: str | None) -> tuple[DataFrame, DataFrame]:
    """Slices of BED rows, and the paths and contigs there are: from a Parquet table (path, contig, seq), else from the FASTA
    files, of which only the asked bytes are read; files that are compressed, or in a store that only Spark reads, are read whole."""
    if table:
        pieces = seqs.in_pieces(spark.read.parquet(table))
        return seqs.fetch_pieces(bed, pieces), pieces.where("piece = 0").select("path", "contig")
    paths = [r.path for r in bed.select("path").distinct().collect()]  # the files to read
    packed = [p for p in paths if p.endswith((".gz", ".bgz", ".bz2", ".zst")) or ("://" in p and not p.startswith(("file://", "http://", "https://")))]
    tables, there = [], []
    if len(packed) < len(paths):
        index = fastaindex.offsets(spark, [p for p in paths if p not in packed])
        tables.append(fastaindex.fetch(bed.where(~F.col("path").isin(packed)) if packed else bed, index).drop("bytes_read"))
        there.append(index.select("path", "contig").distinct())
    if packed:
        pieces = fa.read_fasta(spark, packed)
        tables.append(seqs.fetch_pieces(bed.where(F.col("path").isin(packed)), pieces))
        there.append(pieces.where("piece = 0").select("path", "contig"))
    join = lambda x: x[0] if len(x) == 1 else x[0].unionByName(x[1])
    return join(tables), join(there)


def enhance(spark, a):
    contigs = manifest(spark, a)
    df, blocks = with_blocks(spark, a.table)
    n = genomes(df)
    open_ = shared(en.open_gaps(blocks, df, contigs, a.min_gap, a.outlier_factor))
    print(f"Gaps to enhance: {open_.select('gap').distinct().count()}", file=sys.stderr)
    if open_.isEmpty():
        out = reordered(df, layout.sort_by_genome(df, 0, absent=True))
    else:
        out = en.enhanced_table(df, en.rematch(shared(en.of_slices(fetched(spark, en.wanted(open_), a.sequences)[0])), a.min_match), n)
    save(out, a.out, a.format)


def fasta(spark, a):
    bed = shared(text.read_bed(spark, a.bed))
    if bed.isEmpty():
        raise ValueError("no rows")
    if a.archive:
        bad = archive.complaints(bed, a.archive, a.program).collect()
        if bad:
            raise ValueError("; ".join(sorted(r.message for r in bad)))
        got = shared(archive.fetch(seqs.file_names(bed), a.archive, a.program))
    else:
        got, there = fetched(spark, seqs.file_names(bed), a.sequences)
        lost = seqs.missing(bed, there).collect()
        if lost:
            raise ValueError("; ".join(f"no sequence {r.contig} in {r.path}" for r in lost))
    if a.each:
        fa.write_each(got, a.out)
    elif a.out:
        text.write_fasta(got, a.out)
    else:
        say(got.orderBy("path", "contig", "start").select(F.concat("header", F.lit("\n"), "slice").alias("value")))


def draw(spark, a):
    contigs = manifest(spark, a)
    df, _ = in_order(load(spark, a.table))
    df = shared(df)
    blocks = shared(collinear.oriented_blocks(df, genomes(df)))
    svg.write_polygons(collinear.polygons(blocks, df), contigs.groupBy("seq_idx").agg(F.sum("length").alias("total")), a.out)


def stats(spark, a):
    report = layout.table_stats(load(spark, a.table)).first().asDict()
    stem = a.table.removesuffix(BINARY)
    report["companions"] = [stem + x for x in COMPANIONS if os.path.exists(stem + x)]
    print(json.dumps(report, indent=2) if a.json else "\n".join(f"{k}: {v}" for k, v in report.items()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="anchorframe", description=__doc__)
    p.add_argument("-V", "--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, fn, *args, table=True, out=True):
        c = sub.add_parser(name)
        c.set_defaults(fn=fn)
        if table:
            c.add_argument("table")
        if out:
            c.add_argument("-o", "--out", required=name in ("index", "shred", "gaps", "draw"))
        for flags, options in args:
            c.add_argument(*flags, **options)

    seq = (("-s", "--seq"), {"type": int, "default": 0})
    lengths, region = (("-l", "--lengths"), {}), (("-r", "--region"), {"required": True, "action": "append"})
    flag = {"action": "store_true"}
    form, place = (("--format",), {"choices": ["binary", "text", "parquet"]}), (("-i", "--in-place"), flag)
    store = (("--sequences",), {"help": "Parquet table path, contig, seq; without it the FASTA files are read"})
    add("sort", sort, seq, (("--verify",), flag), form, place)
    add("filter", filter_, form, place)
    add("index", index, (("--single",), {"type": int}), (("-w", "--width"), {"type": int, "default": 1_000_000}), (("--verify",), flag))
    add("subset", subset, seq, lengths, region, form, (("-b", "--index"), {}))
    add("extract", extract, seq, lengths, region, (("-x", "--sequences"), {"type": int, "nargs": "+"}), (("--stranded",), flag))
    add("shred", shred, lengths, (("--size",), {"type": int, "default": 10_000_000}), (("--per-sequence",), flag))
    add("gaps", gaps_, (("--min-gap",), {"type": int, "required": True}), (("--outlier-factor",), {"type": float}))
    add("enhance", enhance, (("min_gap",), {"type": int}), lengths, form, store, (("--min-match",), {"type": int, "default": 20}), (("--outlier-factor",), {"type": float, "default": 5.0}))
    add("fasta", fasta, (("bed",), {}), store, (("--each",), flag), (("--archive",), {}), (("--program",), {"default": archive.PROGRAM}), table=False)
    add("draw", draw, lengths)
    add("stats", stats, (("--json",), flag), out=False)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.fn(spark or SparkSession.builder.appName("anchorframe").getOrCreate(), a) or 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except BrokenPipeError:
        return 0


if __name__ == "__main__":
    sys.exit(main())
