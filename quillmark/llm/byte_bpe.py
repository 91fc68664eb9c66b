"""Byte-level BPE encoding and decoding by a file of merge ranks.

A text is cut by the tokenizer's pattern. Each distinct word of a task is encoded once: its bytes start as single
pieces, and a fold merges the neighbouring pair of lowest rank, leftmost first, until no pair has a rank. Decoding
concatenates the binary pieces of the ids.

Two forms of the fold are given. :func:`merge_words` is a column expression of higher-order functions over the byte
arrays of a table of distinct words, with the ranks as a literal array of hash slots; it serves a vocabulary, where
each word occurs once. :func:`encode_documents` runs the same fold inside Arrow batches, next to the documents, so
that occurrences of words are never shuffled; README.md has the figures that decide between them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidy

#: Words remembered by one Python worker; the memory is emptied when full, so it stays bounded.
MEMORY_WORDS = 300_000
#: Bytes of ids and decoded texts that leave a task together; a batch of texts comes to several times its size as Python objects.
OUT_BYTES = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 piece and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@cache
def library_classes(pattern: str) -> tuple[str, int]:
    """``pattern`` with letters and numbers as tiktoken's regex engine knows them, and the first character changed.

    Engines follow different Unicode versions. A tokenizer of single bytes that joins a character's last byte to a
    following ``a`` or ``1`` shows whether the library puts both in one word; characters that only this side's engine
    counts are taken out of the class.
    """
    import regex
    import tiktoken

    first = 0x110000
    for name, mark in (("L", b"a"), ("N", b"1")):
        ranks = {bytes([n]): n for n in range(256)} | {bytes([n]) + mark: 256 + n for n in range(256)}
        encode = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        ours = regex.compile(rf"\p{{{name}}}").match
        extra = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and ours(chr(c)) and max(encode(chr(c) + mark.decode())) < 256]
        if extra:
            ranges: list[list[int]] = []
            for c in extra:
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
            first = min(first, extra[0])
            out = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges)
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{out}]]")
    return pattern, first


class Merger:
    """Word to packed ids (little-endian unsigned 32-bit), with a bounded memory."""

    def __init__(self, ranks: dict[bytes, int], memory_words: int = MEMORY_WORDS):
        self.ranks, self.memory_words = ranks, memory_words
        self.known: dict[str, bytes] = {}

    def encode_word(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > 400:
            return self._encode_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        joint = [ranks.get(parts[i] + parts[i + 1], 1 << 31) for i in range(len(parts) - 1)]
        while joint and (low := min(joint)) < 1 << 31:
            at = joint.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at < len(joint):
                joint[at] = ranks.get(parts[at] + parts[at + 1], 1 << 31)
            if at:
                joint[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 31)
        return [ranks[p] for p in parts]

    def _encode_long(self, word: bytes) -> list[int]:
        """The same merges with a heap over linked pieces, in n log n for very long words."""
        import heapq

        ranks, n = self.ranks, len(word)
        end, right, left = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], right[i] = 0, stop, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(word[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if left[i] >= 0 and (r := ranks.get(word[left[i] : stop])) is not None:
                heapq.heappush(heap, (r, left[i], stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def __call__(self, words: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > self.memory_words:
            known.clear()
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = b"".join(i.to_bytes(4, "little") for i in self.encode_word(word.encode()))
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with ``with_ids`` the ids and the decoded bytes; these
    only with ``with_decoded`` where that is given.

    A null or empty text has no ids; its digests are those of no bytes. Rows with repeated or null ids are encoded like
    any other. A text is encoded whole, however long. An empty table gives an empty result; other columns are not read.
    """
    exact, first_unsure = library_classes(pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary file
    with_decoded = with_ids if with_decoded is None else with_decoded
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded binary" * with_decoded
    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * (with_ids + with_decoded)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np
        import regex

        # texts without a character that the engines see differently take the plain, faster pattern
        plain, careful, merge = regex.compile(pattern).findall, regex.compile(exact, regex.V1).findall, Merger(ranks.value)
        unsure = re.compile(f"[\\U{min(first_unsure, 0x10FFFF):08x}-\U0010ffff]").search
        pieces = np.empty(max(ranks.value.values()) + 1, object)
        for piece, rank in ranks.value.items():
            pieces[rank] = piece

        def packed(ids, rows):
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            rows: list[tuple] = []
            first, size = 0, 0
            for at, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                ids = merge((careful if unsure(text) else plain)(text))
                decoded = b"".join(pieces[np.frombuffer(ids, "<u4")])
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *(ids,) * with_ids, *(decoded,) * with_decoded))
                size += len(ids) * with_ids + len(decoded) * with_decoded
                if size > OUT_BYTES:
                    yield packed(batch.column(0).slice(first, len(rows)), rows)
                    rows, first, size = [], at + 1, 0
            if rows:
                yield packed(batch.column(0).slice(first), rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the concatenated pieces of an array of ids, null where it is null."""
    pieces = rank_table(rows.sparkSession, ranks_path)
    at = rows.select("*", F.monotonically_increasing_id().alias("__row"))
    flat = at.select("__row", F.posexplode(ids_col).alias("__at", "rank")).join(F.broadcast(pieces), "rank")
    joined = flat.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__at", "piece"))).alias("__pieces"))
    whole = F.aggregate("__pieces", F.lit(b""), lambda out, x: F.concat(out, x["piece"]))
    return at.join(joined, "__row", "left").withColumn("decoded", F.when(F.col(ids_col).isNotNull(), F.coalesce(whole, F.lit(b"")))).drop("__row", "__pieces")


def rank_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """(piece, rank) of the vocabulary; as many rows as the file has lines."""
    return spark.createDataFrame([(bytearray(p), r) for p, r in read_ranks(ranks_path).items()], "piece binary, rank int")


def merge_words(word: Column, slots: Column) -> Column:
    """Ids of a word (binary) as an array, by a fold of higher-order functions.

    ``slots`` is the literal rank map: an array of ``n`` arrays of (piece, rank), piece ``p`` standing in slot
    ``xxhash64(p) mod n``.
    """

    def rank(piece):
        found = F.filter(F.element_at(slots, (F.pmod(F.xxhash64(piece), F.size(slots)) + 1).cast("int")), lambda x: x["piece"] == piece)
        return F.coalesce(F.get(found, 0)["rank"], F.lit(1 << 30))

    single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def step(parts, _):
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.struct(rank(F.concat(F.get(parts, i), F.coalesce(F.get(parts, i + 1), F.lit(b"")))).alias("rank"), i.alias("at")))
        best = F.array_min(pairs)
        merged = F.concat(F.slice(parts, F.lit(1), best["at"]), F.array(F.concat(F.get(parts, best["at"]), F.get(parts, best["at"] + 1))), F.slice(parts, best["at"] + 3, F.size(parts)))
        return F.when((F.size(parts) > 1) & (best["rank"] < 1 << 30), merged).otherwise(parts)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), single, step)
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(folded, rank))


def rank_slots(spark: SparkSession, ranks_path: str, n: int = 65_536) -> DataFrame:
    """One row with the slots that :func:`merge_words` takes; as large as the vocabulary file."""
    slots: list[list[tuple]] = [[] for _ in range(n)]
    hashed = rank_table(spark, ranks_path).select("piece", "rank", F.pmod(F.xxhash64("piece"), F.lit(n)).alias("slot"))
    for piece, rank, slot in hashed.collect():  # the vocabulary file, not the corpus
        slots[slot].append((bytearray(piece), rank))
    return spark.createDataFrame([(slots,)], "slots array<array<struct<piece: binary, rank: int>>>")
