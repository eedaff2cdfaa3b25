"""SimHash near-duplicates by bit-sliced comparison.

A text's shingles are its runs of three words (repeats included); a bit of its fingerprint is set if it is set in over
half of the shingles' XXH64 values. Two fingerprints link if they differ in at most ``RADIUS`` of 64 bits.

1. Documents with one fingerprint are one entry from here on, so copies cost nothing.
2. A fingerprint has eight bytes, and those that differ in two bits agree in at least six of them. Every fingerprint
   goes to the 28 buckets of six of its bytes. What a bucket's members still differ in is 16 bits, so no bucket can hold
   more than 65,536 of them, whatever the corpus.
3. Buckets are compared bit-sliced: all members' values of one bit form one vertical plane of packed words. Shifting the
   planes by d lays every member beside the one d places on; one exclusive or for each plane gives one more differing bit
   of 64 pairs at once, and carry-save counters, which start so that they overflow beyond the radius, add them up.
   A block of words is abandoned once all its pairs are beyond. Many small buckets share planes; the largest come first, so
   a shift only looks at buckets that are that long.
4. Links are thinned to a forest in each batch and closed by connected components.

The result is exact: no link is lost, none is made up.

Defined results: null and empty texts, and texts of separators only, have fingerprint zero, which links like any other;
a text of one or two words is one shingle; repeated rows get equal results; a row with a null id links as any other, but
its id is no component's; a component without any id is null; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .common import cut, tidy
from .graph import components, forest

SHINGLE, SEED, RADIUS = 3, 42, 2
BYTES = 8
#: The two bytes that the members of a bucket may differ in.
FREE = list(combinations(range(BYTES), RADIUS))
#: Shingles whose bits are counted at a time, and packed words compared at a time.
STEP, BLOCK = 1 << 14, 1 << 12


def shingle_hashes(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a chunk, and its row (in order)."""
    size = w.end - w.start
    begin = np.cumsum(size + 1) - size - 1
    buf = np.full(int(size.sum()) + len(w), 32, np.uint8)
    inside = np.repeat(w.start - np.cumsum(size) + size, size) + np.arange(size.sum())
    buf[np.arange(len(inside)) + np.repeat(np.arange(len(w)), size)] = w.data[inside]
    raw, end, n = buf.tobytes(), begin + size, w.counts()
    first = np.flatnonzero(w.row[: -SHINGLE + 1] == w.row[SHINGLE - 1 :]) if len(w) >= SHINGLE else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    a, b = np.concatenate([first, w.first[short]]), np.concatenate([first + SHINGLE - 1, w.first[short + 1] - 1])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    one = xxhash.xxh64_intdigest
    h = [one(raw[x:y], SEED) for x, y in zip(begin[a].tolist(), end[b].tolist(), strict=True)]
    return np.array(h, np.uint64), w.row[a]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprint (uint64) of every text; null is empty."""
    out = [np.zeros(0, np.uint64)]
    for w in tk.tokenize(texts):
        h, row = shingle_hashes(w)
        count = np.zeros((w.rows, 64), np.int64)
        for lo in range(0, len(h), STEP):
            bits = np.unpackbits(h[lo : lo + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = row[lo : lo + STEP]
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            count[own[start]] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
        half = np.bincount(row, minlength=w.rows)[:, None]
        out.append(np.packbits(2 * count > half, axis=1, bitorder="little").view("<u8").ravel())
    return np.concatenate(out)


def close_pairs(values: np.ndarray, sizes: np.ndarray, width: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of one group that differ in at most ``radius`` of ``width`` bits.

    ``values`` holds the groups one after another, ``sizes`` how long they are.
    """
    order = np.argsort(-sizes, kind="stable")
    begin = np.cumsum(sizes) - sizes
    sizes = sizes[order]
    place = np.repeat(begin[order] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    most, n = int(sizes.max(initial=0)), len(place)
    group = np.full(n + most, -1)
    group[:n] = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.zeros((n + most + 191) // 64 * 64, values.dtype)
    padded[:n] = values[place]
    planes = [np.packbits((padded >> values.dtype.type(p)) & values.dtype.type(1), bitorder="little").view("<u8") for p in range(width)]
    ends = np.cumsum(sizes)
    digits = (radius + 1).bit_length()
    start = (1 << digits) - radius - 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for r in range(min(64, most)):
        moved = planes if r == 0 else [np.append((x[:-1] >> np.uint64(r)) | (x[1:] << np.uint64(64 - r)), np.uint64(0)) for x in planes]
        for d in range(r or 64, most, 64):
            m = int(ends[np.searchsorted(-sizes, -d, "left") - 1])  # members of groups of more than d
            same = np.zeros((m + 63) // 64 * 64, bool)
            same[:m] = group[:m] == group[d : m + d]
            beyond = ~np.packbits(same, bitorder="little").view("<u8")
            for lo in range(0, len(beyond), BLOCK):
                over = beyond[lo : lo + BLOCK]
                hi = lo + len(over)
                counter = [np.full(len(over), np.uint64(0xFFFFFFFFFFFFFFFF if start >> k & 1 else 0)) for k in range(digits)]
                for x, y in zip(planes, moved, strict=True):
                    carry = x[lo:hi] ^ y[lo + d // 64 : hi + d // 64]
                    for k in range(digits):
                        counter[k], carry = counter[k] ^ carry, counter[k] & carry
                    over |= carry
                    if (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                        break
            i = np.flatnonzero(~np.unpackbits(beyond.view(np.uint8), bitorder="little")[:m].astype(bool))
            found.append((place[i], place[i + d]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, high = (np.array(x, np.uint64) * np.uint64(8) for x in zip(*FREE, strict=True))
    for b in batches:
        lists = b.column(1)
        sizes, fps = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
        k = np.repeat(b.column(0).to_numpy(), sizes)
        rest = ((fps >> low[k]) & np.uint64(255)) | ((fps >> high[k]) & np.uint64(255)) << np.uint64(8)
        i, j = close_pairs(rest.astype(np.uint16), sizes, 16)
        v, c = forest(fps[i].view(np.int64), fps[j].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(v[v != c]), pa.array(c[v != c])], names=["a", "b"])


def linked(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct ``fp`` (bigint) of a table, enough to connect all that hang together."""
    masks = [~sum(255 << 8 * x for x in free) & (1 << 64) - 1 for free in FREE]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for k, m in enumerate(signed)])
    buckets = fps.select("fp", F.explode(keys).alias("at")).groupBy("at.k", "at.key").agg(F.collect_list("fp").alias("fps"))
    return buckets.where(F.size("fps") > 1).select("k", "fps").mapInArrow(tidy(_links), "a bigint, b bigint")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id; one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1)).view(np.int64))], names=["doc_id", "fp"])

    own = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, fp bigint"))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    closed = nodes.join(components(linked(nodes)), F.col("fp") == F.col("v"), "left")
    tied = closed.where("c is not null")
    ids = tied.join(tied.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "component_id")
    labels = closed.where("c is null").select("fp", F.col("least").alias("component_id")).unionByName(ids)
    return own.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
