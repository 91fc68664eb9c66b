"""Suffix-array dedup of long byte strings.

A byte goes when a string of ``length`` bytes that covers it starts at another place too. Strings are compared by
suffix sorting with a difference cover modulo 3: triples at sampled positions are sorted and named, the names are
sorted recursively, the remaining suffixes are merged in, and then neighbours in the suffix order are compared over
``length`` bytes. Symbols are blocks of 50 bytes at a stride of 50, so two levels reach 400 bytes.

The suffix sorting is dealt out by content: consecutive strings that share a minimiser (the smallest hash of 16 bytes
inside) travel as one packed segment to the minimiser's bucket, and equal strings meet in one bucket, where the suffix
order decides. A filter of fixed size keeps segments at home whose minimiser occurs only once; a segment that occurs as
a whole several times needs no sorting, and is sorted only once against others. A bucket that outgrows a task goes back to
Spark and is dealt out by other minimisers, and what outgrows a task even then by the names of its strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeat_filter import PACKED, may_repeat, pack, repeated, runs, sliding_min
from .shared import shuffle_parts, stored
from .words import mix

#: Bytes of distinct segments that one suffix sort takes; a larger bucket is dealt anew by another minimiser.
SORTED_BYTES = 300_000
#: Bytes of segments (and 64 for each place) that a task holds of one bucket; a larger bucket goes back to Spark.
BUCKET_BYTES = 8_000_000
#: How often such buckets are dealt out by another minimiser before their strings are dealt out by name.
DEALS = 2
#: Bytes of text that minimisers are taken of at once.
TEXT_BYTES = 1_000_000
SEED_BYTES = 16
SPANS = "doc_id long, text_key long, first long, beyond long, segment binary"
SEGMENTS = "bucket long, doc_id long, text_key long, first long, inner boolean, segment binary"
STRINGS = "high long, low long, doc_id long, text_key long, first long"


def words_at(data):
    """The 8 bytes from each position of a uint8 array, as one big-endian number; zeros after the end."""
    import numpy as np

    out = np.zeros(len(data) + 8, np.uint64)
    out[: len(data)] = data
    for k in (1, 2, 4):
        out[:-k] = (out[:-k] << np.uint64(8 * k)) | out[k:]
        out[len(out) - k :] <<= np.uint64(8 * k)
    return out[: len(data)]


def minimisers(data, length: int, salt: int = 0):
    """Runs of strings of ``length`` bytes of a uint8 array (of less than 2 ** 20 bytes) that share a minimiser.

    The minimiser is the smallest hash of :data:`SEED_BYTES` bytes inside the string, the last one of equals. Gives
    each run's minimiser, first and last string, and whether the minimiser occurs several times in it.
    """
    import numpy as np

    eight = words_at(data)
    n = len(data) - SEED_BYTES + 1
    seeds = mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + eight[8 : 8 + n])
    low = np.uint64(2**20 - 1)
    at = low - (sliding_min((seeds & ~low) | (low - np.arange(n, dtype=np.uint64)), length - SEED_BYTES + 1) & low)
    values = seeds[at.astype(np.int64)]
    start, end = runs(values)
    moved = np.cumsum(np.r_[0, at[1:] != at[:-1]])
    return values[start], start, end, moved[start] != moved[end]


def symbols_at(words, length: int):
    """Symbols of the suffix sort and their stride: blocks of a ninth to a third of ``length`` where one divides it,
    named by a 64-bit hash, else 8-byte words in byte order.

    Any order of blocks will do, for only equal strings need to be neighbours; what a block leaves of ``length`` must be
    in byte order.
    """
    import numpy as np

    size = next((length // n for n in (9, 8, 7, 6, 5, 4, 3) if length % n == 0 and length // n > 8), 8)
    if size == 8:
        return words, 8
    out = np.zeros(len(words), np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for n, k in enumerate([*range(0, size - 8, 8), size - 8]):
        out[: len(out) - k] += words[k:] * factors[n]
    return mix(out), size


def _packed(columns, tops) -> tuple:
    """Rows of columns as one number each, in their order; ``tops`` are bounds of the columns."""
    import numpy as np

    out, top = columns[0], int(tops[0])
    for column, bound in zip(columns[1:], tops[1:], strict=True):
        if top * int(bound) >= 1 << 64:
            out = np.unique(out, return_inverse=True)[1].astype(np.uint64)
            top = len(out)
        out, top = out * np.uint64(bound) + column, top * int(bound)
    return out


def _ranked(keys):
    """1, 2, ... by size; equal keys share a rank."""
    import numpy as np

    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else 0
    return out


def suffix_ranks(s, depth: int):
    """Rank of each suffix of ranks ``s`` (1 and more) by its first ``depth`` symbols at least.

    Suffixes with equal ranks agree on ``depth`` symbols; those that agree on that many are neighbours in the order.
    """
    import numpy as np

    n = len(s)
    if depth <= 1:
        return s
    top = int(s.max(initial=0)) + 2
    padded = np.r_[s, np.zeros(3, np.uint64)]
    if n < 3:
        return _ranked(_packed([padded[k : k + n] for k in range(3)], [top] * 3))
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    at = np.r_[one, two]
    names = _ranked(_packed([padded[at], padded[at + 1], padded[at + 2]], [top] * 3))
    if depth > 3 and int(names.max(initial=0)) < len(names):
        text = np.r_[names[: len(one)], np.zeros(1, np.uint64), names[len(one) :]] + np.uint64(1)
        deeper = suffix_ranks(text, -(-depth // 3))
        names = np.r_[deeper[: len(one)], deeper[len(one) + 1 :]]
    rank = np.zeros(n + 3, np.uint64)
    rank[at] = names
    wide = int(names.max(initial=0)) + 2
    # remaining suffixes: a symbol and the rank of what follows; against the second class two symbols
    zero_key = padded[zero] * np.uint64(wide) + rank[zero + 1]
    one_key = padded[one] * np.uint64(wide) + rank[one + 1]
    far = np.r_[zero, two]
    far_key = _packed([padded[far], padded[far + 1], rank[far + 2]], [top, top, wide])
    zero_far, two_far = far_key[: len(zero)], far_key[len(zero) :]
    out = np.empty(n, np.uint64)  # how many suffixes are smaller
    by_zero, by_one, by_two = (np.argsort(x) for x in (zero_key, one_key, two_far))
    zero_sorted, one_sorted, two_sorted, far_sorted, names_sorted = zero_key[by_zero], one_key[by_one], two_far[by_two], np.sort(zero_far), np.sort(names)
    # sorted needles keep the searches in the processor's cache
    out[zero[by_zero]] = np.searchsorted(zero_sorted, zero_sorted) + np.searchsorted(one_sorted, zero_sorted) + np.searchsorted(two_sorted, zero_far[by_zero])
    below = np.searchsorted(names_sorted, np.r_[names[: len(one)][by_one], names[len(one) :][by_two]])
    out[one[by_one]] = below[: len(one)] + np.searchsorted(zero_sorted, one_sorted)
    out[two[by_two]] = below[len(one) :] + np.searchsorted(far_sorted, two_sorted)
    return out + np.uint64(1)


def repeated_starts(data, starts, length: int):
    """Which of the strings of ``length`` bytes from ``starts`` (uint8 array ``data``) occur at another of them too."""
    import numpy as np

    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    padded = np.zeros(len(data) + 2 * length, np.uint8)
    padded[: len(data)] = data
    words = words_at(padded)
    symbols, stride = symbols_at(words, length)
    symbols = np.r_[symbols, np.zeros(-len(symbols) % stride, np.uint64)]
    # all positions of one residue one after another: a stride becomes a step of one
    ranks = suffix_ranks(_ranked(symbols.reshape(-1, stride).T.ravel()), -(-length // stride))
    order = starts[np.argsort(ranks.reshape(stride, -1).T.ravel()[starts])]
    i = np.arange(len(order) - 1)
    for k in range(0, length - stride + 1, stride):  # neighbours that agree so far
        i = i[symbols[order[i] + k] == symbols[order[i + 1] + k]]
    if length % stride:
        i = i[words[order[i] + length - 8] == words[order[i + 1] + length - 8]]
    if not _agree(data, order[i], order[i + 1], length):  # two blocks with one hash: by the strings themselves
        seen: dict[bytes, int] = {}
        for s in starts.tolist():
            seen[data[s : s + length].tobytes()] = seen.get(data[s : s + length].tobytes(), 0) + 1
        return np.array([seen[data[s : s + length].tobytes()] > 1 for s in starts.tolist()], bool)
    found = np.zeros(len(data) + 1, bool)
    found[order[i]] = found[order[i + 1]] = True
    return found[starts]


def _agree(data, a, b, length: int) -> bool:
    """Whether the strings from ``a`` and ``b`` are equal, pair by pair; neighbouring pairs are compared once."""
    import numpy as np

    if not len(a):
        return True
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((a, b - a))
    a, apart = a[order], (b - a)[order]
    new = np.r_[True, (apart[1:] != apart[:-1]) | (a[1:] > a[:-1] + length)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(a)] - 1
    size = a[last] + length - a[first]
    for k in range(0, len(first), 4096):  # so many runs at once
        n = size[k : k + 4096]
        at = np.repeat(a[first[k : k + 4096]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if (data[at] != data[at + np.repeat(apart[first[k : k + 4096]], n)]).any():
            return False
    return True


def _pieces(text, length: int):
    """(offset, uint8 array) of overlapping pieces of a text's bytes; every string of ``length`` lies in one."""
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(len(data) - length + 1, 0), TEXT_BYTES):
        yield at, data[at : at + TEXT_BYTES + length - 1]


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes()


def _first_pass(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, size = [], 0
        for batch in batches:
            for text in batch.column(2):
                for _, data in _pieces(_raw(text), length):
                    mins, _, _, inner = minimisers(data, length)
                    held.append(np.r_[mins, mins[inner]])
                    size += len(held[-1])
            if size > 500_000:
                yield pack(np.concatenate(held))
                held, size = [], 0
        if held:
            yield pack(np.concatenate(held))

    return docs.mapInArrow(run, PACKED)


def _segments(docs: DataFrame, length: int, filter_bits) -> DataFrame:
    """Segments that may share a string: bucket, doc_id, text_key, first byte, whether its seed recurs in it, bytes."""
    names = ["bucket", "doc_id", "text_key", "first", "inner", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bits = np.frombuffer(filter_bits.value, np.uint8)

        def out(rows):
            columns = zip(*rows, strict=True) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = _raw(text)
                for at, data in _pieces(raw, length):
                    mins, start, end, inner = minimisers(data, length)
                    c = np.flatnonzero(may_repeat(bits, mins))
                    for bucket, a, b, again in zip(mins[c].view(np.int64).tolist(), (at + start[c]).tolist(), (at + end[c] + length).tolist(), inner[c].tolist(), strict=True):
                        rows.append((bucket, doc_id, key, a, again, raw[a:b]))
                if len(rows) > 10_000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    return docs.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, ("long", "long", "long", "long", "boolean", "binary"), strict=True)))


def _split(segments: list[tuple], length: int, salt: int) -> list[list[tuple]]:
    """Deal (number, offset, bytes) segments of a large bucket anew by another minimiser; groups of at most
    :data:`SORTED_BYTES` where content allows."""
    import numpy as np

    if sum(len(s[2]) for s in segments) <= SORTED_BYTES or salt > 8:
        return [segments]
    groups: dict[int, list] = {}
    for number, offset, raw in segments:
        for at, data in _pieces(raw, length):
            mins, start, end, _ = minimisers(data, length, salt)
            for bucket, a, b in zip(mins.tolist(), (at + start).tolist(), (at + end + length).tolist(), strict=True):
                groups.setdefault(bucket, []).append((number, offset + a, raw[a:b]))
    out, joint, size = [], [], 0
    for group in groups.values():
        total = sum(len(s[2]) for s in group)
        if total > SORTED_BYTES:
            out += _split(group, length, salt + 1)
            continue
        if size + total > SORTED_BYTES:
            out.append(joint)
            joint, size = [], 0
        joint.extend(group)
        size += total
    return [*out, joint] if joint else out


def _spans(segments: DataFrame, length: int) -> DataFrame:
    """Byte spans to remove, from segments in the order of their buckets; and, with their bytes instead of an end, the
    segments of buckets over :data:`BUCKET_BYTES`."""
    most = BUCKET_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        spans: list[tuple] = []
        over: list[tuple] = []  # segments of a bucket that is too large

        def out():
            rows = [(*s, None) for s in spans] + [(doc, key, first, None, raw) for doc, key, first, raw in over]
            spans.clear()
            over.clear()
            columns = zip(*rows, strict=True) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["doc_id", "text_key", "first", "beyond", "segment"])

        def order(group: list[tuple]):
            """group: (number of the distinct segment, offset in it, bytes). Marks of repeated strings by segment."""
            sizes = np.array([len(s[2]) for s in group])
            data = np.frombuffer(b"".join(s[2] for s in group), np.uint8)
            count = sizes - length + 1
            owner = np.repeat(np.arange(len(group)), count)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            at = np.flatnonzero(repeated_starts(data, (np.cumsum(sizes) - sizes)[owner] + offset, length))
            if not len(at):
                return
            cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
            for a, b in zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist(), strict=True):
                number, begin, _ = group[owner[a]]
                yield number, begin + int(offset[a]), begin + int(offset[b]) + length

        waiting: list[tuple] = []  # distinct segments to sort
        places: list[list[tuple]] = []  # of each distinct segment: (doc_id, text_key, first)
        size = 0

        def sort():
            nonlocal size
            if not waiting:
                return
            for group in _split(waiting, length, 1):
                for number, a, b in order(group):
                    spans.extend((doc, key, first + a, first + b) for doc, key, first in places[number])
            waiting.clear()
            places.clear()
            size = 0

        def bucket_done():
            """One bucket: whole segments that recur are spans; others are sorted with what waits."""
            nonlocal size
            some = len(held) > 1 or any(inner for _, inner in held.values())
            total = sum(map(len, held))
            if some and size and size + total > SORTED_BYTES:
                sort()
            for raw, (where, _) in held.items():
                if len(where) > 1:
                    spans.extend((doc, key, first, first + len(raw)) for doc, key, first in where)
                if some and (len(held) > 1 or len(where) == 1):
                    waiting.append((len(places), 0, raw))
                    places.append(where if len(where) == 1 else [])
                    size += len(raw)
            held.clear()

        held: dict[bytes, tuple[list, bool]] = {}
        last, weight = None, 0
        for batch in batches:
            for bucket, doc, key, first, inner, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last:
                    bucket_done()
                    last, weight = bucket, 0
                at = held.get(raw)
                weight += 64 + (len(raw) if at is None else 0)
                if weight > most:
                    for whole, (where, _) in held.items():
                        over.extend((*place, whole) for place in where)
                    held.clear()
                    over.append((doc, key, first, raw))
                    if len(over) > 10_000:
                        yield out()
                    continue
                if at is None:
                    held[raw] = ([(doc, key, first)], inner)
                else:
                    at[0].append((doc, key, first))
                if len(spans) > 50_000:
                    yield out()
        bucket_done()
        sort()
        yield out()

    return segments.mapInArrow(run, SPANS)


def _dealt_anew(segments: DataFrame, length: int, salt: int) -> DataFrame:
    """Segments cut and named by another minimiser."""
    names = ["bucket", "doc_id", "text_key", "first", "inner", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, first, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, data in _pieces(raw, length):
                    mins, start, end, inner = minimisers(data, length, salt)
                    for bucket, a, b, again in zip(mins.view("int64").tolist(), (at + start).tolist(), (at + end + length).tolist(), inner.tolist(), strict=True):
                        rows.append((bucket, doc, key, first + a, again, raw[a:b]))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return segments.mapInArrow(run, SEGMENTS)


def _by_name(segments: DataFrame, length: int) -> DataFrame:
    """Spans of the strings of segments that occur several times, told by 128-bit names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for doc, key, first, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, len(raw) - length + 1, 20_000):
                    n = min(20_000, len(raw) - length + 1 - at)
                    named = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(at, at + n)), np.int64).reshape(-1, 2)
                    columns = [named[:, 0].copy(), named[:, 1].copy(), [doc] * n, np.full(n, key), first + at + np.arange(n)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["high", "low", "doc_id", "text_key", "first"])

    strings = segments.mapInArrow(run, STRINGS)
    several = strings.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low")
    return strings.join(several, ["high", "low"], "left_semi").select("doc_id", "text_key", "first", (F.col("first") + length).alias("beyond"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes).

    Strings of ``length`` bytes (at least 32) are those of the UTF-8 text of one document; overlaps with itself count,
    and they are judged on the input. A null or empty text has no bytes. Repeated rows are places of their own, so both
    lose what they share. Null ids are ids like others. Texts may have any length: long ones are cut into pieces that
    overlap by a string. An empty table gives an empty result. Other columns are not read.
    """
    if length < 2 * SEED_BYTES:
        raise ValueError("length is at least 32")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("raw"))
    bits = repeated(_first_pass(rows, length))
    dealt = _segments(rows, length, bits).repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket")
    found = stored(_spans(dealt, length), "spans")
    spans = found.where("segment IS NULL").drop("segment")
    for n in range(DEALS + 1):
        over = found.where("segment IS NOT NULL").select("doc_id", "text_key", "first", "segment")
        if over.isEmpty():
            break
        if n == DEALS:
            spans = spans.unionByName(stored(_by_name(over, length), "spans"))
            break
        # salts that _split does not use
        anew = _dealt_anew(over, length, 16 + n).repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket")
        found = stored(_spans(anew, length), "spans")
        spans = spans.unionByName(found.where("segment IS NULL").drop("segment"))
    by_doc = spans.groupBy("doc_id", "text_key").agg(F.collect_list("first").alias("first"), F.collect_list("beyond").alias("beyond"))
    by_doc = by_doc.select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "first", "beyond")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            total, removed, n_spans, kept = [], [], [], []
            for raw, first, beyond in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = raw.as_py()
                total.append(len(data))
                found = 0
                if first.is_valid:
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, first.values.to_numpy(), 1)
                    np.add.at(edge, beyond.values.to_numpy(), -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    found = int((np.diff(np.r_[1, stays.astype(np.int8)]) == -1).sum())
                    data = np.frombuffer(data, np.uint8)[stays].tobytes()
                removed.append(total[-1] - len(data))
                n_spans.append(found)
                kept.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, n_spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    same = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_key") == F.col("span_key"))
    joined = rows.join(by_doc, same, "left").select("doc_id", "raw", "first", "beyond")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
