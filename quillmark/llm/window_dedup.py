"""Substring dedup with super-k-mers.

A window is ``width`` consecutive words. Its minimiser is the smallest hash of its runs of ``seed_words`` words, and
consecutive windows with the same minimiser travel together as one packed string to the minimiser's bucket: equal
windows have equal minimisers, so they meet there. A filter of fixed size keeps strings at home whose minimiser occurs
only once. In a bucket, the windows' 128-bit names are sorted, which counts equal windows exactly.

The strings of a hot minimiser, counted along with the filter, never go to one bucket: their windows are named where they
are and go to an ordinary aggregation, which counts them in the tasks first. So do the windows of a bucket that outgrows
a task's memory all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeat_filter import PACKED, may_repeat, pack, pack_often, repeated, runs, sliding_min
from .shared import shuffle_parts, stored
from .words import Hasher, mix, split_words, word_hashes

#: Strings handled at once in a task; a single bucket beyond ten times that is spread by window.
STRINGS = 30_000
#: A minimiser of so many strings is hot.
HOT_FROM = 100_000
SPANS = "doc_id long, text_key long, first int, beyond int, name_a long, name_b long"


def _seeds(n: int, salt: int):
    """Odd multipliers for a sum over ``n`` neighbours."""
    import numpy as np

    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def _names(hashes, n: int, salt: int):
    """A name of each run of ``n`` hashes."""
    size = len(hashes) - n + 1
    out = hashes[:size] * _seeds(n, salt)[0]
    for k in range(1, n):
        out = out + hashes[k : k + size] * _seeds(n, salt)[k]
    return mix(out)


def _minimisers(hashes, width: int, seed_words: int):
    return sliding_min(_names(hashes, seed_words, 1), width - seed_words + 1)


def _first_pass(docs: DataFrame, width: int, seed_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hasher, held, size = Hasher(), [], 0
        for batch in batches:
            for text in batch.column(2):
                hashes = word_hashes(text.as_py(), hasher, lower=False)
                if len(hashes) >= width:
                    mins = _minimisers(hashes, width, seed_words)
                    held.append(mins[runs(mins)[0]])
                    size += len(held[-1])
                if size > 1_000_000:
                    mins = np.concatenate(held)
                    yield pack(mins)
                    yield pack_often(mins)
                    held, size = [], 0
        if held:
            mins = np.concatenate(held)
            yield pack(mins)
            yield pack_often(mins)

    return docs.mapInArrow(run, PACKED)


def _hot_windows(docs: DataFrame, width: int, seed_words: int, hot) -> DataFrame:
    """Windows of hot minimisers with their names, as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hasher = Hasher()
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = word_hashes(text.as_py(), hasher, lower=False)
                if len(hashes) < width:
                    continue
                at = np.flatnonzero(np.isin(_minimisers(hashes, width, seed_words), hot))
                if len(at):
                    names = [_names(hashes, width, salt)[at].view(np.int64) for salt in (2, 3)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc_id)), pa.array(np.full(len(at), key)), pa.array(at.astype(np.int32)), pa.array((at + width).astype(np.int32)), *map(pa.array, names)], names=[f.split()[0] for f in SPANS.split(", ")])

    return docs.mapInArrow(run, SPANS)


def _strings(docs: DataFrame, width: int, seed_words: int, filter_bits, hot) -> DataFrame:
    """Super-k-mers that may meet another, but for hot ones: bucket, doc_id, text_key, first word, number of words, packed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hasher, bits = Hasher(), np.frombuffer(filter_bits.value, np.uint8)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = split_words(text.as_py(), lower=False)
                if len(words) < width:
                    continue
                mins = _minimisers(np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words)), width, seed_words)
                start, end = runs(mins)
                chosen = np.flatnonzero(may_repeat(bits, mins[start]) & ~np.isin(mins[start], hot))
                for bucket, a, b in zip(mins[start[chosen]].view(np.int64).tolist(), start[chosen].tolist(), (end[chosen] + width).tolist(), strict=True):
                    rows.append((bucket, doc_id, key, a, b - a, b" ".join(words[a:b])))
                if len(rows) > 50_000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    names = ["bucket", "doc_id", "text_key", "first", "n", "packed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def out(rows):
        columns = zip(*rows, strict=True) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, "bucket long, doc_id long, text_key long, first int, n int, packed binary")


def _spans(strings: DataFrame, width: int) -> DataFrame:
    """Word spans of windows that occur in a smaller doc_id; of oversized buckets, all windows with their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hasher = Hasher()

        def out(doc, key, first, beyond, a=None, b=None):
            n = len(doc)
            arrays = [pa.array(doc), pa.array(key), pa.array(first.astype(np.int32)), pa.array(beyond.astype(np.int32)), *(pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (a, b))]
            return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SPANS.split(", ")])

        def windows(table: pa.Table):
            """Name and string of each window, and its offset in the string."""
            n = table["n"].to_numpy()
            words = b" ".join(x.as_buffer() for x in table["packed"]).split(b" ")
            hashes = np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))
            begin = np.cumsum(n) - n
            count = n - width + 1
            owner = np.repeat(np.arange(len(n)), count)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            at = begin[owner] + offset
            return owner, offset, _names(hashes, width, 2)[at], _names(hashes, width, 3)[at]

        def spans(table: pa.Table):
            owner, offset, a, b = windows(table)
            doc, key, first = (table[c].to_numpy() for c in ("doc_id", "text_key", "first"))
            order = np.argsort(a, kind="stable")
            if ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():
                order = np.lexsort((b, a))
            new = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
            lowest = np.repeat(np.minimum.reduceat(doc[owner[order]], new), np.diff(np.r_[new, len(order)]))
            drop = np.zeros(len(order), bool)
            drop[order] = doc[owner[order]] > lowest
            at = np.flatnonzero(drop)
            if len(at):
                start = at[np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]]
                end = at[np.r_[(at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]), True]]
                o = owner[start]
                yield out(doc[o], key[o], first[o] + offset[start], first[o] + offset[end] + width)

        def spread(table: pa.Table):
            owner, offset, a, b = windows(table)
            doc, key, first = (table[c].to_numpy() for c in ("doc_id", "text_key", "first"))
            yield out(doc[owner], key[owner], first[owner] + offset, first[owner] + offset + width, a, b)

        held, size, oversized = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < STRINGS:
                continue
            table = pa.Table.from_batches(held)
            bucket = table["bucket"].to_numpy()
            if oversized is not None:  # the rest of a bucket that was already spread
                k = int(np.searchsorted(bucket != oversized, True)) if bucket[0] == oversized else 0
                if k:
                    yield from spread(table.slice(0, k))
                    table, bucket = table.slice(k), bucket[k:]
                if len(bucket):
                    oversized = None
            cut = int(np.flatnonzero(bucket == bucket[-1])[0]) if len(bucket) else 0
            if cut:
                yield from spans(table.slice(0, cut))
            if len(bucket) - cut > 10 * STRINGS:
                yield from spread(table.slice(cut))
                oversized, cut = bucket[-1], len(bucket)
            held = table.slice(cut).to_batches()
            size = len(bucket) - cut
            if cut == 0 and size < 10 * STRINGS:
                size = 0  # wait for as many rows again
        if held:
            table = pa.Table.from_batches(held)
            bucket = table["bucket"].to_numpy()
            k = int((bucket == oversized).sum()) if oversized is not None else 0
            if k:
                yield from spread(table.slice(0, k))
            if k < len(bucket):
                yield from spans(table.slice(k))

    return strings.mapInArrow(run, SPANS)


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, seed_words: int = 4) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are runs of anything but ASCII white space, unchanged. A word goes when a window that covers it also starts
    in a document with a smaller id. Windows are judged on the input. A null text has no words, and an empty table gives
    an empty result; texts may have any length. Rows with the same id
    are one document in this respect, and rows without an id neither lose words nor make others lose them. Other
    columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    bits, hot = repeated(_first_pass(known, width, seed_words), hot_from=HOT_FROM)
    dealt = _strings(known, width, seed_words, bits, hot).repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket")
    spans = stored(_spans(dealt, width), "spans")
    named = spans.where("name_a IS NOT NULL")
    if len(hot):
        named = named.unionByName(_hot_windows(known, width, seed_words, hot))
    least = named.groupBy("name_a", "name_b").agg(F.min("doc_id").alias("least"))
    late = named.join(least, ["name_a", "name_b"]).where("doc_id > least")
    found = spans.where("name_a IS NULL").select("doc_id", "text_key", "first", "beyond").union(late.select("doc_id", "text_key", "first", "beyond"))
    by_doc = found.groupBy("doc_id", "text_key").agg(F.collect_list("first").alias("first"), F.collect_list("beyond").alias("beyond"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            total, removed, kept = [], [], []
            for text, first, beyond in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = split_words(text.as_py(), lower=False)
                total.append(len(words))
                if first.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, first.values.to_numpy(), 1)
                    np.add.at(edge, beyond.values.to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(by_doc, ["doc_id", "text_key"], "left").select("doc_id", "text", "first", "beyond")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
