"""N-gram Jaccard self-join with token-combination prefixes.

A document's tokens are the hashes of its distinct word shingles. All sets are sorted by one order: tokens that are not
known to be frequent first, then frequent ones by how frequent. Two sets that link share at least ``need`` tokens of
either, so their first two common tokens lie in the first ``n - need + 2`` tokens of both. Hence it is enough to index

* single tokens that are not frequent, of the first ``n - need + 1``, and
* pairs of frequent tokens, of the prefix extended by one, since a pair of documents whose first common token is
  frequent has a second one that is frequent too. Long sets would have too many pairs; the frequent tokens of their size
  classes are indexed one by one.

Documents that share an index key are candidates. Short lists give all pairs that sizes and places in the order allow. In a long list, sorted by how
frequent a set's tokens are and cut by size, each member first meets the first one of about its size, its hub, only. Members that are then still in
another component than their hub meet all members around the hubs of that component, as tiles: blocks of sketches that
bound in how many tokens two sets differ, compared as matrices and dealt over tasks by block pair; of each row only the
nearest candidates leave a tile, more of them in later rounds, until nothing is left out. Candidates are verified on the whole sets, so
nothing but the speed depends on the table of frequent tokens, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .repeat_filter import may_repeat, members
from .shared import discard, shuffle_parts, stored, tidy
from .words import Hasher, mix, word_hashes

#: Lists up to this length give all their pairs at once, less those that sizes and places in the order rule out.
SHORT_LIST = 48
#: Pairs of lists that a task looks at together.
PAIRS = 300_000
#: Sets up to this size index pairs of frequent tokens.
PAIR_SIZE = 250
#: Bytes of an outline, a sketch folded where it is longer: what pairs are shuffled with at first. Members in a tile.
OUTLINE, TILE = 256, 4096
#: Sets up to this size have their whole sketch as outline.
WHOLE = 4 * OUTLINE
#: Candidates of a row that leave a tile, by round; the last round takes all.
NEAREST = (16, 256, None)
#: Tokens counted at once by a task when it looks for frequent ones.
COUNTED = 3_000_000
#: Index rows that leave a task together.
INDEXED = 200_000


def shingle_set(hashes, width: int):
    """Sorted distinct shingle hashes of a text's word hashes; all words as one shingle if there are fewer."""
    import numpy as np

    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, width)
    factors = mix(np.arange(size + 1, dtype=np.uint64) + np.uint64(size << 32)) | np.uint64(1)
    out = np.full(n - size + 1, factors[size], np.uint64)
    for k in range(size):
        out += hashes[k : n - size + 1 + k] * factors[k]
    out = mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def at_least(tokens, least: int):
    """Values that stand ``least`` times or more in an array, ascending, and how often. The array is sorted where it is, and no
    other of its size is made but one of single bytes: np.unique takes several times the memory."""
    import numpy as np

    tokens.sort()
    new = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
    first = np.flatnonzero(new[: len(tokens) - least + 1] & (tokens[least - 1 :] == tokens[: len(tokens) - least + 1])) if len(tokens) >= least else np.zeros(0, np.int64)
    found = tokens[first]
    return found, np.searchsorted(tokens, found, "right") - first


def sketch(tokens) -> bytes:
    """Parities of the tokens in about twice as many buckets as there are tokens, packed.

    A token that only one of two sets has flips one bit, so two sketches differ in no more bits than the sets differ in
    tokens. The number of buckets is a power of two of at least 64; halves of a longer sketch can be folded together.
    """
    import numpy as np

    size = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    parity = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many tokens two sets differ at least, by their sketches."""
    if len(a) > len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    bits = 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def fingerprint(tokens) -> int:
    """63-bit name of a set; with the set's size it identifies the set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: doc_id, text_key, n, name, sketch of each document; of kind 1: a token often met in one task, and how often."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hasher, held, size = Hasher(), np.empty(COUNTED + 2**16, np.uint64), 0

        def rows(kind, ids, keys, n, names, sketches):
            arrays = [pa.array(np.full(len(n), kind, np.int8)), ids, keys, pa.array(n, pa.int64()), pa.array(names, pa.int64()), sketches]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", "doc_id", "text_key", "n", "name", "sketch"])

        def often():
            tokens, n = at_least(held[:size], 8)
            none = pa.nulls(len(n), pa.int64())
            return rows(1, none, none, n, tokens.view(np.int64), pa.nulls(len(none), pa.binary()))

        for batch in batches:
            ns, names, sketches = [], [], []
            for text in batch.column(1):
                tokens = shingle_set(word_hashes(text.as_py(), hasher), width)
                ns.append(len(tokens))
                names.append(fingerprint(tokens))
                sketches.append(sketch(tokens))
                if size + len(tokens) > len(held):  # a set longer than the room beyond COUNTED
                    held = np.concatenate([held[:size], tokens])
                held[size : size + len(tokens)] = tokens
                size += len(tokens)
                if size > COUNTED:
                    yield often()
                    size = 0
            yield rows(0, batch.column(0), batch.column(2), ns, names, pa.array(sketches, pa.binary()))
        if size:
            yield often()

    return docs.mapInArrow(run, "kind byte, doc_id long, text_key long, n long, name long, sketch binary")


def _postings(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """Index rows (key, weight, left, n, name) of every distinct set of a task.

    The weight says how frequent a set's tokens are. ``left`` is how many tokens two sets can share at most by this one's
    count if the key's tokens are the first they share: those and all that follow in the order.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tokens_known, classes = frequent.value
        hasher, seen = Hasher(), set()
        # a little wider than the sizes of linked sets differ, so that rounding never puts them two classes apart
        ratio = np.log(100 / percent * 1.001)

        def combine(a, b, bucket):
            return mix(mix(a + np.uint64(bucket + 1)) ^ b)

        def index(tokens):
            n = len(tokens)
            need = -(-n * percent // 100)
            if len(tokens_known):
                at = np.minimum(np.searchsorted(tokens_known, tokens), len(tokens_known) - 1)
                level = np.where(tokens_known[at] == tokens, classes[at], 0)
            else:
                level = np.zeros(n, np.int8)
            order = np.argsort(level, kind="stable")[: n - need + 2] if level.any() else np.arange(min(n, n - need + 2))
            weight = int(level.sum(dtype=np.int64) * 64 // n)
            tokens, rare = tokens[order], level[order] == 0
            single = tokens[: n - need + 1]
            place = np.arange(len(tokens))
            keys, left = [single[rare[: n - need + 1]]], [n - place[: len(single)][rare[: n - need + 1]]]
            if not rare.all():
                single_left = n - place[: len(single)][~rare[: n - need + 1]]
                single = single[~rare[: n - need + 1]]
                home = int(np.log(n) / ratio)
                for bucket in (home, home + 1):  # linked sets differ by one size class at most
                    if np.exp((bucket + 1) * ratio) <= PAIR_SIZE:
                        some = tokens[~rare]
                        i, j = np.triu_indices(len(some), 1)
                        keys.append(combine(some[i], some[j], bucket))
                        left.append(n + 1 - place[~rare][j])
                        if need < 2:  # such sets may share no more than one token
                            keys.append(combine(single, single, bucket))
                            left.append(single_left)
                    else:
                        keys.append(combine(single, single, bucket))
                        left.append(single_left)
            return np.concatenate(keys), np.concatenate(left), weight

        def rows(keys, lefts, weights, ns, names):
            sizes = [len(k) for k in keys]
            columns = [np.concatenate(keys).view(np.int64), *(np.repeat(np.array(x, kind), sizes) for x, kind in ((weights, np.int16), (ns, np.int32), (names, np.int64)))]
            columns.insert(2, np.concatenate(lefts).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "weight", "left", "n", "name"])

        for batch in batches:
            keys, lefts, weights, ns, names = held = [], [], [], [], []
            size = 0
            for text in batch.column(1):
                tokens = shingle_set(word_hashes(text.as_py(), hasher), width)
                if not len(tokens) or (name := fingerprint(tokens)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(name)
                found, left, weight = index(tokens)
                keys.append(found)
                lefts.append(left)
                weights.append(weight)
                ns.append(len(tokens))
                names.append(name)
                size += len(found)
                if size > INDEXED:  # pairs of frequent tokens come to many times the size of their texts
                    yield rows(*held)
                    for column in held:
                        column.clear()
                    size = 0
            if keys:
                yield rows(*held)

    return docs.mapInArrow(run, "key long, weight short, left int, n int, name long")


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of short lists, and (star) of each member of a long list with its hub, the first one of about its
    size; from postings sorted by key and falling weight.

    One pass in bounded memory: of a list longer than a batch only the hubs are kept.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ratio = np.log(100 / percent * 1.001)

        def class_of(n):
            """Size classes, of which linked sets are in the same or in neighbouring ones."""
            return (np.log(n) / ratio).astype(np.int64)

        def out(a, n_a, b, n_b, star):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, n_a, b, n_b, np.full(len(a), star))], names=["a", "n_a", "b", "n_b", "star"])

        def stars(name, n, hub, n_hub):
            """Once for each member and hub; a member of many lists often has the same hub in most."""
            order = np.lexsort((n, hub, name))
            name, n, hub, n_hub = (x[order] for x in (name, n, hub, n_hub))
            new = np.r_[True, (name[1:] != name[:-1]) | (hub[1:] != hub[:-1]) | (n[1:] != n[:-1])] & ((name != hub) | (n != n_hub))
            return out(name[new], n[new], hub[new], n_hub[new], True)

        def pairs(i, j, left, n, name):
            """Those that may link and of which the key may be the first they share; once for each pair."""
            n_i, n_j = n[i].astype(np.int64), n[j].astype(np.int64)
            fits = (100 * np.minimum(n_i, n_j) >= percent * np.maximum(n_i, n_j)) & ((100 + percent) * np.minimum(left[i], left[j]).astype(np.int64) >= percent * (n_i + n_j))
            i, j = i[fits], j[fits]
            swap = name[i] > name[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.lexsort((name[j], name[i]))
            i, j = i[order], j[order]
            new = np.r_[True, (name[i[1:]] != name[i[:-1]]) | (name[j[1:]] != name[j[:-1]])] if len(i) else np.zeros(0, bool)
            return out(name[i[new]], n[i[new]], name[j[new]], n[j[new]], False)

        def lengths(new):
            """First row of each run's row, length of its run, and its place in it."""
            start = np.flatnonzero(new)
            length = np.diff(np.r_[start, len(new)])
            first = np.repeat(start, length)
            return first, np.repeat(length, length), np.arange(len(new)) - first

        def emit(key, left, n, name):
            """Of complete lists. Long ones are cut by size: a member is in the part of its class and in that of the next."""
            new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1])]
            key, left, n, name = key[new], left[new], n[new], name[new]
            first, size, rank = lengths(np.r_[True, key[1:] != key[:-1]])
            at = np.flatnonzero((size > 1) & (size <= SHORT_LIST))
            yield from short(at, size, rank, left, n, name)
            at = np.flatnonzero(size > SHORT_LIST)
            if not len(at):
                return
            part = class_of(n[at])
            at, part = np.r_[at, at], np.r_[part, part + 1]
            order = np.lexsort((rank[at], part, first[at]))
            at, part = at[order], part[order]
            first, size, rank = lengths(np.r_[True, (part[1:] != part[:-1]) | (first[at[1:]] != first[at[:-1]])])
            left, n, name = left[at], n[at], name[at]
            yield from short(np.flatnonzero((size > 1) & (size <= SHORT_LIST)), size, rank, left, n, name)
            i = np.flatnonzero(size > SHORT_LIST)
            if len(i):
                yield stars(name[i], n[i], name[first[i]], n[first[i]])

        def short(at, size, rank, left, n, name):
            found, held = [], 0
            for gap in range(1, SHORT_LIST):
                at = at[rank[at] + gap < size[at]]
                if not len(at):
                    break
                found.append((at, at + gap))
                held += len(at)
                if held > PAIRS:
                    yield pairs(*(np.concatenate(x) for x in zip(*found, strict=True)), left, n, name)
                    found, held = [], 0
            if found:
                yield pairs(*(np.concatenate(x) for x in zip(*found, strict=True)), left, n, name)

        def more(n, name):
            """Rows of a list of which some were given out already: each meets the hubs of its two parts."""
            part = class_of(n)
            at, part = np.r_[np.arange(len(n)), np.arange(len(n))], np.r_[part, part + 1]
            for p in np.unique(part).tolist():
                i = at[part == p]
                hub = hubs.setdefault(p, (name[i[0]], n[i[0]]))
                yield stars(name[i], n[i], np.full(len(i), hub[0]), np.full(len(i), hub[1]))

        carry, long_key = None, None
        hubs: dict[int, tuple] = {}  # of the parts of the list of long_key
        for batch in batches:
            key, left, n, name = (batch.column(k).to_numpy() for k in range(4))
            if not len(key):
                continue
            if long_key is not None:  # the rest of a list that was already given out as long
                k = int((key == long_key).sum())
                if k:
                    yield from more(n[:k], name[:k])
                if k == len(key):
                    continue
                key, left, n, name, long_key = key[k:], left[k:], n[k:], name[k:], None
            if carry is not None:
                key, left, n, name = (np.concatenate(x) for x in zip(carry, (key, left, n, name), strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from emit(key[:cut], left[:cut], n[:cut], name[:cut])
            carry = key[cut:], left[cut:], n[cut:], name[cut:]
            if len(carry[0]) > 50_000 and len(np.unique(carry[3])) > SHORT_LIST:
                long_key = key[-1]
                hubs.clear()
                yield from more(n[cut:], name[cut:])
                carry = None
        if carry is not None:
            yield from emit(*carry)

    return postings.select("key", "left", "n", "name").mapInArrow(run, "a long, n_a int, b long, n_b int, star boolean")


def _outlined(classes: DataFrame) -> DataFrame:
    """``classes`` with ``outline``, the sketch folded to :data:`OUTLINE` bytes at most."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index("sketch")):
                words = np.frombuffer(x.as_buffer(), "<u8")
                while len(words) > OUTLINE // 8:
                    words = words[: len(words) // 2] ^ words[len(words) // 2 :]
                out.append(words.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "outline"])

    return classes.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", outline binary")


def _may_link(n_a, n_b, a, b, percent: int) -> bool:
    """Whether two sets' sizes and sketches (Arrow values) do not rule a link out."""
    n_a, n_b = n_a.as_py(), n_b.as_py()
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    # shared = (n_a + n_b - d) / 2 and union = (n_a + n_b + d) / 2 where the sets differ in d tokens
    d = differing(a.as_py(), b.as_py())
    return 100 * (n_a + n_b - d) >= percent * (n_a + n_b + d)


def _long(classes: DataFrame, percent: int) -> DataFrame:
    """Sets that are too long for an outline, and those of their links."""
    return classes.where(100 * F.col("n") >= percent * WHOLE)


def _whole(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (node_a, node_b) of long sets whose whole sketches do not rule a link out: a sketch is far smaller than its set."""
    left, right = (_long(classes, percent).select(F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    both = pairs.join(left, "node_a").join(right, "node_b").select("node_a", "node_b", "n_a", "n_b", "sketch_a", "sketch_b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [_may_link(*x, percent) for x in zip(*batch.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["node_a", "node_b"]).filter(pa.array(fits, pa.bool_()))

    return both.mapInArrow(run, "node_a long, node_b long")


def _alike(pairs: DataFrame, classes: DataFrame, percent: int, by: str) -> DataFrame:
    """Pairs (a, n_a, b, n_b, hub_a, hub_b) with the classes of both ends (node, class_id) and ``alike``: whether their
    sizes and their sketches or outlines (column ``by``) do not rule a link out."""
    left, right = (classes.select(F.col("name").alias(x), F.col("n").alias(f"n_{x}"), F.col("node").alias(f"node_{x}"), F.col("class_id").alias(f"class_{x}"), F.col(by).alias(f"sketch_{x}")) for x in "ab")
    kept = ["a", "n_a", "node_a", "class_a", "b", "n_b", "node_b", "class_b", "hub_a", "hub_b"]
    both = pairs.join(left, ["a", "n_a"]).join(right, ["b", "n_b"]).select(*kept, "sketch_a", "sketch_b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [_may_link(*x, percent) for x in zip(*(batch.column(c) for c in (1, 5, 10, 11)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:10], pa.array(alike, pa.bool_())], names=[*kept, "alike"])

    return both.mapInArrow(run, "a long, n_a int, node_a long, class_a long, b long, n_b int, node_b long, class_b long, hub_a boolean, hub_b boolean, alike boolean")


def _tiles(members_of: DataFrame, classes: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Pairs (hub, node_a, node_b, cut, folded) around a hub, in different parts, whose sketches do not rule a link out.

    Rows of ``members_of``: hub (a component), node, part, and ``outside``, whether the part is not the hub's. Hubs
    without members outside drop out. Members are dealt by hash into tiles of about :data:`TILE`; a tile of outside members meets every
    tile of its hub, each pair of tiles in a place of its own. Each row gives its ``nearest`` candidates of a tile;
    ``cut`` tells where there were more, ``folded`` where an outline was not the whole sketch.
    """
    count = {name: F.ceil(F.count_if(F.col("outside") == side) / TILE).cast("int").alias(name) for name, side in (("n_out", True), ("n_in", False))}
    sizes = members_of.groupBy("hub").agg(*count.values()).where("n_out > 0")
    tile = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), "n_out")).otherwise(F.col("n_out") + F.pmod(F.xxhash64("node"), "n_in")).cast("int")
    rows = members_of.join(sizes, "hub").withColumn("tile", tile).join(classes.select("node", "n", F.col("outline").alias("sketch")), "node")
    tiles = stored(rows.groupBy("hub", "tile", "n_out", "n_in").agg(F.collect_list(F.struct("node", "n", "part", "sketch")).alias("rows")), "tiles")
    total = F.col("n_out") + F.col("n_in") - 1
    left = tiles.where("tile < n_out").select("hub", F.col("tile").alias("i"), F.explode(F.sequence("tile", total)).alias("j"), F.col("rows").alias("left"))
    right = tiles.select("hub", F.explode(F.sequence(F.lit(0), F.least("tile", F.col("n_out") - 1))).alias("i"), F.col("tile").alias("j"), F.col("rows").alias("right"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def by_length(rows):
            """(number of 64-bit words, row numbers, sketches as a matrix) of each length."""
            held: dict[int, list[int]] = {}
            sketches = rows.field("sketch")
            for k, x in enumerate(sketches):
                held.setdefault(len(x.as_buffer()) // 8, []).append(k)
            for words, at in held.items():
                yield words, np.array(at), np.frombuffer(b"".join(sketches[k].as_buffer() for k in at), "<u8").reshape(-1, words)

        def folded(sketches, words):
            while sketches.shape[1] > words:
                half = sketches.shape[1] // 2
                sketches = sketches[:, :half] ^ sketches[:, half:]
            return sketches

        def folded_of(rows, at):
            return rows.field("n").to_numpy()[at] > WHOLE

        def near(left, right):
            """Row of left, row of right, bits that differ, of all candidates."""
            n_a, part_a, n_b, part_b = (x.field(c).to_numpy() for x in (left, right) for c in ("n", "part"))
            others = list(by_length(right))
            for words, at, sketches in by_length(left):
                for words_b, at_b, sketches_b in others:
                    least = min(words, words_b)
                    x, y = folded(sketches, least), folded(sketches_b, least)
                    step = max(1, 4_000_000 // (len(y) * least))
                    for k in range(0, len(x), step):
                        d = np.bitwise_count(x[k : k + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                        row, n, m = at[k : k + step], n_a[at[k : k + step], None].astype(np.int64), n_b[None, at_b].astype(np.int64)
                        # shared = (n + m - d) / 2 and union = (n + m + d) / 2 where the sets differ in d tokens
                        fits = (100 * (n + m - d) >= percent * (n + m + d)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (part_a[row, None] != part_b[None, at_b])
                        i, j = np.nonzero(fits)
                        yield row[i], at_b[j], d[i, j]

        for batch in batches:
            for hub, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                left, right = left.values, right.values
                i, j, d = (np.concatenate(x) for x in zip(*near(left, right), strict=True))
                order = np.lexsort((right.field("node").to_numpy()[j], d, i))
                i, j = i[order], j[order]
                start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
                length = np.diff(np.r_[start, len(i)])
                most = len(i) if nearest is None else nearest
                some = np.arange(len(i)) - np.repeat(start, length) < most
                cut = np.repeat(length > most, length)[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), hub)), pa.array(left.field("node").to_numpy()[i[some]]), pa.array(right.field("node").to_numpy()[j[some]]), pa.array(cut), pa.array(folded_of(left, i[some]) | folded_of(right, j[some]))], names=["hub", "node_a", "node_b", "cut", "folded"])

    return left.join(right, ["hub", "i", "j"]).select("hub", "left", "right").mapInArrow(run, "hub long, node_a long, node_b long, cut boolean, folded boolean")


def _verify(pairs: DataFrame, wanted: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (node_a, node_b): the pairs whose whole sets are alike enough.

    ``wanted`` has node, class_id, n and name of all ends; each set is made from the text of one document of its class.
    """
    wanted = stored(wanted.distinct(), "wanted")
    bits = members(wanted.select("class_id"))
    # repeated rows give the same tokens once; they stand where the join has put them
    found = _sets(texts, bits, width).join(wanted.withColumnRenamed("class_id", "doc_id"), ["doc_id", "n", "name"])
    sets = stored(found.groupBy("doc_id", "n", "name", "node").agg(F.first("tokens").alias("tokens")), "sets")
    bits.destroy()
    left, right = (sets.select(F.col("node").alias(f"node_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    both = pairs.join(left, "node_a").join(right, "node_b").select("node_a", "node_b", "tokens_a", "tokens_b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = int((b[at] == a).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["node_a", "node_b"]).filter(pa.array(keep, pa.bool_()))

    links = stored(both.mapInArrow(run, "node_a long, node_b long"), "found")
    discard(wanted)
    discard(sets)
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, frequent_tokens: int = 131_072, frequent_from: int = 64, row_keys: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id.

    Words are runs of anything but ASCII white space, lower-cased A to Z. Two sets link when 100 * shared >= ``percent``
    (1 to 100) * union. ``class_id`` is the smallest id with the same set and ``component_id`` the smallest id reachable
    by links; pairs that are known to be in one component already are not verified again. A text that is null or has no
    word has no shingle and stands alone; so does a row without an id. Repeated rows share a class. Rows that repeat an
    id with another text are documents of their own, though their classes may have the same smallest id. Texts may have
    any length. An empty table gives an empty result. Other columns are not read.

    With ``row_keys`` two columns follow: text_key, xxhash64 of the text, which together with the id says which row it
    is, and component, a number of the component in this run (null for rows that stand alone by rule), which tells
    components apart also where ids repeat.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    scan = stored(_scan(texts, width), "scan")
    meta = scan.where("kind = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("n").cast("int").alias("n"), "name", "sketch")
    often = scan.where("kind = 1").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent_from)
    top = often.orderBy(F.desc("n"), "name").limit(frequent_tokens).toPandas()  # at most frequent_tokens rows
    frequent = spark.sparkContext.broadcast(_levels(top))
    # a class is the documents of one set; its number is fixed once the table is written
    classes = meta.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "name").agg(F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch"))
    classes = stored(_outlined(classes.withColumn("node", F.monotonically_increasing_id())), "classes")

    dealt = _postings(texts.where("doc_id IS NOT NULL"), width, percent, frequent)
    lists = stored(_lists(dealt.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", F.desc("weight"), "n", "name"), percent), "lists")
    frequent.destroy()
    first = lists.select(*_ordered(), (F.col("star") & (F.col("a") > F.col("b"))).alias("hub_a"), (F.col("star") & (F.col("a") <= F.col("b"))).alias("hub_b"))
    first = first.groupBy("a", "n_a", "b", "n_b").agg(F.max("hub_a").alias("hub_a"), F.max("hub_b").alias("hub_b"))
    met = stored(_alike(first, classes, percent, "outline"), "met")
    discard(lists)
    near = met.where("alike")
    folded = F.greatest("n_a", "n_b") > WHOLE  # their outlines are shorter than their sketches
    if not near.where(folded).isEmpty():
        whole = near.where(folded).select("a", "n_a", "b", "n_b", "hub_a", "hub_b")
        near = near.where(~folded).unionByName(stored(_alike(whole, _long(classes, percent), percent, "sketch").where("alike"), "near"))
    ends = near.select(F.explode(F.array(*[F.struct(F.col(f"node_{x}").alias("node"), F.col(f"class_{x}").alias("class_id"), F.col(f"n_{x}").alias("n"), F.col(x).alias("name")) for x in "ab"])).alias("end")).select("end.*")
    labels = connected(_verify(near.select("node_a", "node_b"), ends, texts, width, percent), "node_a", "node_b", roots=False)

    # members that are still in another component than their hub meet the others around it, not once a list
    stars = [met.where(f"hub_{h}").select(F.col(f"node_{h}").alias("hub"), F.col(f"node_{m}").alias("node")) for h, m in ("ab", "ba")]
    around = stars[0].union(stars[1])
    for nearest in NEAREST:
        of_hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("hub_part"))
        placed = around.join(of_hub, "hub", "left").join(labels, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("part"), F.coalesce("hub_part", "hub").alias("hub_part"))
        # hubs of one component are one from here on, so a member stands once beside all of them
        placed = stored(placed.select(F.col("hub_part").alias("hub"), "node", "part", (F.col("part") != F.col("hub_part")).alias("outside")).distinct(), "placed")
        if placed.where("outside").isEmpty():
            break
        rest = stored(_tiles(placed, classes, percent, nearest), "rest")
        if not rest.isEmpty():
            pairs = stored(rest.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), "folded").distinct(), "pairs")
            short, long = (pairs.where(x).drop("folded") for x in ("NOT folded", "folded"))
            pairs = short if long.isEmpty() else short.unionByName(stored(_whole(long, classes, percent), "near"))
            if not pairs.isEmpty():
                ends = pairs.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct().join(classes.drop("sketch", "outline"), "node")
                more = _verify(pairs, ends, texts, width, percent)
                labels = connected(labels.select(F.col("node").alias("node_a"), F.col("component").alias("node_b")).union(more), "node_a", "node_b", roots=False)
        open_hubs = rest.where("cut").select("hub").distinct()
        if open_hubs.isEmpty():
            break
        around = placed.join(open_hubs, "hub", "left_semi").select("hub", "node")

    known = classes.select("n", "name", "class_id", "node").join(labels, "node", "left").select("n", "name", "class_id", F.coalesce("component", "node").alias("component"))
    lowest = known.groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = known.join(lowest, "component")
    own = F.col("doc_id").isNotNull()
    joined = meta.drop("sketch").join(known, ["n", "name"], "left")
    extra = ["text_key", F.when(own, F.col("component")).alias("component")] if row_keys else []
    return joined.select("doc_id", "n_shingles", F.coalesce(F.when(own, F.col("class_id")), "doc_id").alias("class_id"), F.coalesce(F.when(own, F.col("component_id")), "doc_id").alias("component_id"), *extra)


def _ordered() -> list:
    """a, n_a, b, n_b with the smaller name first."""
    swap = F.col("a") > F.col("b")
    return [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("n_b", "n_a"), ("a", "b"), ("n_a", "n_b"))]


def _levels(top):
    """Sorted frequent tokens and their class: 1 + log2 of how often."""
    import numpy as np

    tokens = top["name"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    level = 1 + np.log2(np.maximum(top["n"].to_numpy(np.int64), 1)).astype(np.int8)
    return tokens[order], level[order]


def _sets(texts: DataFrame, ids, width: int) -> DataFrame:
    """Whole sets of documents whose id is in a filter: doc_id, n, name, tokens (sorted 64-bit hashes, packed)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hasher, bits = Hasher(), np.frombuffer(ids.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(may_repeat(bits, batch.column(0).to_numpy().view(np.uint64))))
            out = [shingle_set(word_hashes(text.as_py(), hasher), width) for text in batch.column(1)]
            arrays = [batch.column(0), pa.array([len(x) for x in out], pa.int32()), pa.array([fingerprint(x) for x in out], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "name", "tokens"])

    return texts.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, n int, name long, tokens binary")
