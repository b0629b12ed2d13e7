"""Lines repeated across one site's documents (problem 4).

One pass over the pages cuts them into lines and fingerprints each line twice: as it is written (the variant) and in its form. Every
task stores the pages of each variant of a site as compressed bitmaps, one container for each 2^16 page ids: sorted 16-bit values
while sparse, 8 KB of bits when dense. So a line that stands on millions of pages leaves a task as a few bytes per page at most.
After a shuffle by (site, form, container) the variants' bitmaps are united, their exact sizes are summed to one cardinality per
form, and forms over the threshold are kept. For the deletion the pages (as arrays of fingerprints) meet the kept bitmaps of their
site and 2^16 block, and a line goes if its form is kept and the page's bit is set in its bitmap.

Defined results: rows without a site (null, empty or unusable url) or with null page id give nothing; null content counts
as a page of the site without lines; lines without a letter never count; exact duplicate rows count once; rows of one page
id with different content are one page with the lines of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.skew import salted_join
from textmill.session import cut_lineage

DENSE = 4096  # values from which a container is stored as bits; so only those have 8,192 bytes


def site_of(url: Column) -> Column:
    """Host of ``url`` in lower case without user, port, closing dot and one leading ``www.``; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", ""), F.lit(""))


_NO_LETTERS = regex.compile(r"[^\p{L}]+")


def line_form(line: str) -> str:
    """Lower case, every run of characters other than letters as one space, trimmed."""
    return _NO_LETTERS.sub(" ", line.lower()).strip()


# ---- containers, in whole batches -----------------------------------------------------------------------------------


def _boundaries(*columns: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal rows of sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pack(groups: tuple[np.ndarray, ...], low: np.ndarray) -> tuple[list[np.ndarray], pa.Array, np.ndarray]:
    """Containers of (group, value) rows: the groups' keys, a binary array of containers and their sizes."""
    order = np.lexsort((low, *reversed(groups)))
    groups, low = [g[order] for g in groups], low[order]
    first = _boundaries(*groups, low)
    groups, low = [g[first] for g in groups], low[first].astype("<u2")
    starts = _boundaries(*groups)
    sizes = np.diff(np.append(starts, len(low)))
    if (sizes >= DENSE).any():
        blobs = []
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if n >= DENSE:
                bits = np.zeros(65536, np.uint8)
                bits[low[s : s + n]] = 1
                blobs.append(np.packbits(bits).tobytes())
            else:
                blobs.append(low[s : s + n].tobytes())
        packed = pa.array(blobs, pa.binary())
    else:
        offsets = np.append(starts, len(low)).astype(np.int32) * 2
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(low.tobytes())])
    return [g[starts] for g in groups], packed, sizes


def unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row number, value) of every value of an array of containers."""
    sizes = np.fromiter((len(x) for x in packed.to_pylist()), np.int64, len(packed)) if len(packed) else np.zeros(0, np.int64)
    rows, values = [], []
    sparse = np.flatnonzero(sizes != 8192)
    if len(sparse):
        taken = packed.take(pa.array(sparse))
        rows.append(np.repeat(sparse, sizes[sparse] // 2))
        values.append(np.frombuffer(b"".join(taken.to_pylist()), "<u2").astype(np.int64))
    for r in np.flatnonzero(sizes == 8192).tolist():
        found = np.flatnonzero(np.unpackbits(np.frombuffer(packed[r].as_py(), np.uint8)))
        rows.append(np.full(len(found), r))
        values.append(found.astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(values)


CONTAINERS = "site bigint, form bigint, high bigint, pages binary, n bigint"


def _emit(keys: list[np.ndarray], packed: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), packed, pa.array(sizes.astype(np.int64))], ["site", "form", "high", "pages", "n"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their lines' fingerprints to the variants' containers; gathered within about a million lines of a task."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        site, form, variant, page = (np.concatenate(c) for c in zip(*held, strict=True))
        (site, form, _, high), packed, sizes = pack((site, form, variant, page >> 16), page & 0xFFFF)
        return _emit([site, form, high], packed, sizes)

    for b in batches:
        forms, variants = b.column(2), b.column(3)
        lengths = np.diff(forms.offsets.to_numpy())
        flat = forms.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        page, site = (np.repeat(b.column(i).to_numpy(), lengths)[known] for i in (0, 1))
        held.append((site, flat.drop_null().to_numpy(), variants.flatten().to_numpy(zero_copy_only=False)[known], page))
        count += len(page)
        if count >= 1_000_000:
            yield flush()
            held, count = [], 0
    if count:
        yield flush()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by their keys to one container a key; the last key of a batch waits for the next batch."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        keys = [t.column(i).to_numpy() for i in range(3)]
        starts = _boundaries(*keys)
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield _united(t.slice(0, cut))
        rest = t.slice(cut)
        if rest.num_rows > 64:  # many parts of one key: unite what is there
            rest = pa.Table.from_batches([_united(rest)])
    if rest is not None and rest.num_rows:
        yield _united(rest)


def _united(t: pa.Table) -> pa.RecordBatch:
    rows, values = unpack(t.column("pages").combine_chunks())
    keys = tuple(t.column(i).to_numpy()[rows] for i in range(3))
    return _emit(*pack(keys, values))


# ---- the operator ---------------------------------------------------------------------------------------------------


def _print_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int | None, int]] = {}  # emptied when full, which costs time only
    prints = xxhash.xxh3_64_intdigest

    def of(line: str) -> tuple[int | None, int]:
        form = line_form(line)
        got = (prints(form.encode()) - (1 << 63) if form else None, prints(line.encode()) - (1 << 63))
        if len(line) <= 400:
            if len(known) >= 200_000:
                known.clear()
            known[line] = got
        return got

    for b in batches:
        forms, variants = [], []
        for content in b.column(2).to_pylist():
            both = [known.get(x) or of(x) for x in content.split("\n")] if content is not None else []
            forms.append([f for f, _ in both])
            variants.append([v for _, v in both])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, kind), pa.array(variants, kind)], ["page_id", "site", "forms", "variants"])


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, site, forms, variants): per row with a site the fingerprints of its lines in order; forms are null for lines
    without a letter. Fingerprints have 64 bits and are compared within a site (of which the fingerprint has 64 bits more)."""
    site = site_of(F.col("url"))
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("bigint").alias("page_id"), site.alias("_s"), "content").where(F.col("_s").isNotNull())
    return rows.select("page_id", F.xxhash64("_s").alias("site"), "content").mapInArrow(_print_lines, "page_id bigint, site bigint, forms array<bigint>, variants array<bigint>")


def repeated_lines(lines: DataFrame, min_pages: int = 4, share_num: int = 1, share_den: int = 5) -> DataFrame:
    """(site, form, high, pages): the bitmaps of every form that stands on at least ``min_pages`` distinct pages of its site and on
    at least share_num/share_den of the site's distinct pages. ``lines`` as of ``page_lines``."""
    keys = ["site", "form", "high"]
    united = lines.mapInArrow(_build, CONTAINERS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_unite, CONTAINERS)
    sizes = united.groupBy("site", "form").agg(F.sum("n").alias("pages_with")).where(F.col("pages_with") >= min_pages)
    sites = lines.select("site", "page_id").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    chosen = salted_join(sizes, sites, ["site"], F.col("form")).where(F.col("pages_with") * share_den >= F.col("site_pages") * share_num).select("site", "form")
    # of a line, as many containers as page ids span: spread by container, so that no line is one task's
    return salted_join(united.select("site", "form", "high", "pages"), chosen, ["site", "form"], F.col("high")).select("site", "form", "high", "pages")


def _looked_up(lines: pa.Table, kept: pa.Table) -> pa.Table:
    """The (page_id, line_no) of the lines of one site and block of pages that are set in a kept bitmap."""
    forms = lines.column("forms").combine_chunks()
    flat, lengths = forms.flatten(), np.diff(forms.offsets.to_numpy())
    prints = flat.fill_null(0).to_numpy()
    page = np.repeat(lines.column("page_id").to_numpy(), lengths)
    number = np.arange(len(prints)) - np.repeat(forms.offsets.to_numpy()[:-1] - forms.offsets[0].as_py(), lengths) + 1
    hit = np.isin(prints, kept.column("form").to_numpy()) & flat.is_valid().to_numpy(zero_copy_only=False)
    prints, page, number = prints[hit], page[hit], number[hit]
    order = np.argsort(prints, kind="stable")
    prints, page, number = prints[order], page[order], number[order]
    gone = np.zeros(len(prints), bool)
    for form, bitmap in zip(kept.column("form").to_numpy().tolist(), kept.column("pages"), strict=True):
        a, b = np.searchsorted(prints, form), np.searchsorted(prints, form, "right")
        if a < b:
            bits = np.zeros(65536, bool)
            bits[unpack(pa.array([bitmap.as_py()], pa.binary()))[1]] = True
            gone[a:b] = bits[page[a:b] & 0xFFFF]
    return pa.table({"page_id": pa.array(page[gone]), "line_no": pa.array(number[gone].astype(np.int64))})


def repeated_line_numbers(pages: DataFrame, **thresholds: int) -> DataFrame:
    """(page_id, line_no): the lines of each page that ``repeated_lines`` finds, by a lookup in their bitmaps.

    The fingerprints are made once and kept in the checkpoint folder. A group of the lookup is a site's pages of one block of 2^16
    page ids with the kept bitmaps of that block, so a large site is as many groups as blocks."""
    lines = cut_lineage(page_lines(pages))
    kept = repeated_lines(lines, **thresholds)
    blocks = lines.where(F.size("forms") > 0).select("site", F.shiftright("page_id", 16).alias("high"), "page_id", "forms")
    looked = blocks.groupBy("site", "high").cogroup(kept.groupBy("site", "high")).applyInArrow(_looked_up, "page_id bigint, line_no bigint")
    return looked.distinct()


def without_repeated_lines(pages: DataFrame, **thresholds: int) -> DataFrame:
    """(page_id, content, removed): every row's content without the repeated lines, and how many were removed.

    Rows without a site, and null contents, come out as they are."""
    found = repeated_line_numbers(pages, **thresholds).groupBy("page_id").agg(F.collect_set("line_no").alias("_gone"))
    rows = pages.select("page_id", "content").join(found, "page_id", "left")
    gone = F.coalesce("_gone", F.array().cast("array<bigint>"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(gone, (i + 1).cast("bigint")))
    return rows.select("page_id", F.when(F.col("content").isNotNull(), F.array_join(kept, "\n")).alias("content"), F.size(gone).alias("removed"))
