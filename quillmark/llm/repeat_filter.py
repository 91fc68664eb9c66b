"""A filter of hashes that occur more than once, of a fixed size.

Tasks send the filter's bit positions of their hashes, packed by chunk of the filter. Each chunk is merged with two bit
sets, hit once and hit twice, so merging takes the chunk's size however many hashes arrive. The bits hit twice go to
all executors. A hash whose bit is clear is certainly alone; one whose bit is set may be. When the hashes outnumber the
bits, more hashes pass, and nothing else changes.

Along with the bits, tasks can send how often they met their most frequent hashes, so that hot ones are known beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import shuffle_parts
from .words import mix

#: 2 ** 27 bits are 16 MB.
LOG_BITS = 27
LOG_CHUNKS = 6
PACKED = "chunk int, positions binary"


def positions_of(hashes, log_bits: int = LOG_BITS):
    """Bit positions of 64-bit hashes; the hashes are mixed first, as minima crowd at low values."""
    import numpy as np

    return (mix(hashes) >> np.uint64(64 - log_bits)).astype(np.uint32)


def pack(hashes, log_bits: int = LOG_BITS) -> pa.RecordBatch:
    """Positions of a task's hashes by chunk; what occurs more often than twice is sent twice."""
    import numpy as np

    found, n = np.unique(positions_of(hashes, log_bits), return_counts=True)
    found = np.repeat(found, np.minimum(n, 2))
    chunk = found >> np.uint32(log_bits - LOG_CHUNKS)
    cuts = np.searchsorted(chunk, np.arange(2**LOG_CHUNKS + 1))
    some = np.flatnonzero(np.diff(cuts))
    rows = [found[cuts[c] : cuts[c + 1]].astype("<u4").tobytes() for c in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(rows, pa.binary())], names=["chunk", "positions"])


def pack_often(hashes, least: int = 8) -> pa.RecordBatch:
    """Hashes that a task met ``least`` times or more and how often, as rows that :func:`repeated` adds up."""
    import numpy as np

    found, n = np.unique(hashes, return_counts=True)
    found, n = found[n >= least], n[n >= least].astype(np.uint64)
    part = (found % np.uint64(2**LOG_CHUNKS)).astype(np.int64)
    rows = [(-1 - c, np.stack([found[part == c], n[part == c]], axis=1).astype("<u8").tobytes()) for c in np.unique(part).tolist()]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "positions"])


def repeated(packed: DataFrame, log_bits: int = LOG_BITS, times: int = 2, hot_from: int | None = None):
    """Broadcast bits (as bytes) that were hit at least ``times`` (1 or 2) times, from rows of :func:`pack`.

    With ``hot_from`` also the hashes that :func:`pack_often` counted that often in all, at most one in ``hot_from``, as a
    sorted uint64 array.
    """
    import numpy as np

    size = 2 ** (log_bits - LOG_CHUNKS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        often: dict[int, int] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk < 0:
                    for value, n in np.frombuffer(packed.as_buffer(), "<u8").reshape(-1, 2).tolist():
                        often[value] = often.get(value, 0) + n
                    continue
                at = np.frombuffer(packed.as_buffer(), "<u4") & np.uint32(size - 1)
                a = once.setdefault(chunk, np.zeros(size, bool))
                b = twice.setdefault(chunk, np.zeros(size, bool))
                b[at[a[at]]] = True
                b[at[1:][at[1:] == at[:-1]]] = True
                a[at] = True
        hit = once if times == 1 else twice
        chunks = sorted(hit)
        hot = np.array([v for v, n in often.items() if n >= (hot_from or n + 1)], "<u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([*chunks, -1], pa.int32()), pa.array([*(np.packbits(hit[c], bitorder="little").tobytes() for c in chunks), hot], pa.binary())], names=["chunk", "bits"])

    bits, hot = bytearray(2**log_bits // 8), []
    dealt = packed.repartition(min(2**LOG_CHUNKS, shuffle_parts(packed.sparkSession)), "chunk")
    for chunk, part in dealt.mapInArrow(merge, "chunk int, bits binary").collect():  # 2**log_bits / 8 bytes in all
        if chunk < 0:
            hot.append(np.frombuffer(part, "<u8"))
        else:
            bits[chunk * size // 8 : (chunk + 1) * size // 8] = part
    shared = packed.sparkSession.sparkContext.broadcast(bytes(bits))
    return shared if hot_from is None else (shared, np.sort(np.concatenate([np.zeros(0, "<u8"), *hot])))


def members(values: DataFrame, log_bits: int = LOG_BITS):
    """Broadcast bits of a table with one column of longs: those of its values are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pack(batch.column(0).to_numpy().view("uint64"), log_bits)

    return repeated(values.mapInArrow(run, PACKED), log_bits, times=1)


def may_repeat(bits, hashes, log_bits: int = LOG_BITS):
    """Which hashes may occur more than once; ``bits`` is a uint8 array of the filter."""
    import numpy as np

    at = positions_of(hashes, log_bits)
    return (bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)


def sliding_min(values, width: int):
    """Minimum of each run of ``width`` neighbours, by doubling."""
    import numpy as np

    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def runs(mins):
    """First and last index of each run of equal neighbours."""
    import numpy as np

    start = np.flatnonzero(np.r_[True, mins[1:] != mins[:-1]])
    return start, np.r_[start[1:], len(mins)] - 1
