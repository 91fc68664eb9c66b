"""Spelling variants from forward and reversed sorted dictionaries.

Two words one edit apart share their first or their last half. Words are therefore dealt into blocks of a shared prefix
(the forward dictionary) and blocks of a shared suffix (the reversed one), each sorted and scanned range by range; what
meets in a block is verified. A block of more than ``limit`` words is subdivided: what is not shared yet has halves again,
one of which the edit leaves intact. A block whose words differ in one place only cannot be subdivided, but has at most
one word for each letter and one without that letter, so it is never large.

A pair is looked at in one block only: that of the shared prefix wherever the prefix is long enough, at each subdivision.

A block is named by ``m`` (letters of its longer words; the others have one letter less), ``a`` and ``b`` (letters shared
in front and behind), ``cap`` (pairs that share that many letters in front belong elsewhere) and the shared letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, ASCII_UPPER, shuffle_parts, stored

#: Fixed: the letters of words. With A to Z lower-cased, 90 of them are left.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a block that are compared with each other; a block that cannot be subdivided has at most 91.
LIMIT = 128
BLOCK = ["m", "a", "b", "cap", "shared"]


def count_words(docs: DataFrame, min_letters: int = 7, noise: int = 31, id_col: str = "doc_id", text_col: str = "text", held: int = 300_000) -> DataFrame:
    """word, n: runs of letters of whole texts with A to Z lower-cased, ``min_letters`` or more, and their occurrences.

    Where ``noise`` divides the CRC-32 of ``doc_id:run``, the run loses the letter at that number modulo its length
    first; 0 leaves all runs alone, and so does a null id. Null and empty texts have no words; texts and runs may have
    any length; repeated rows count each. Other columns are not read, and no rows give no words.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import zlib
        from collections import Counter

        runs, lower = re.compile(f"[{LETTERS}]{{{min_letters},}}"), str.maketrans(ASCII_UPPER, ASCII_LOWER)
        total: dict[str, int] = {}

        def flat():
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begun = zlib.crc32(f"{doc_id}:".encode()) if noise and doc_id is not None else None
                for run, n in Counter(runs.findall(text.as_py())).items():
                    word = run.translate(lower)
                    if begun is not None and (number := zlib.crc32(word.encode(), begun)) % noise == 0:
                        at = number % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_letters:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > held:
                    yield flat()
        yield flat()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(word: Column, a: Column, b: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), a), F.lit("\u0000"), F.when(b > 0, F.right(word, b)).otherwise(F.lit("")))


def _dictionaries(words: DataFrame) -> DataFrame:
    """Each word in the forward and the reversed dictionary, with words of its length or less and with longer ones."""
    size = F.length("word")
    longer = words.withColumn("m", F.explode(F.array(size, size + 1)))
    half = F.floor(F.col("m") / 2).cast("int")
    zero = F.lit(0)
    sides = F.array(F.struct(half.alias("a"), zero.alias("b"), F.col("m").alias("cap")), F.struct(zero.alias("a"), half.alias("b"), half.alias("cap")))
    dealt = longer.select("word", "n", "m", F.inline(sides))
    return dealt.select("m", "a", "b", "cap", _shared(F.col("word"), F.col("a"), F.col("b")).alias("shared"), "word", "n")


def _subdivided(rows: DataFrame) -> DataFrame:
    """Each word of a large block in the block of a longer shared prefix and in that of a longer shared suffix."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    a, b, cap = F.col("a"), F.col("b"), F.col("cap")
    parts = F.array(F.struct((a + half).alias("a"), b.alias("b"), cap.alias("cap")), F.struct(a.alias("a"), (b + half).alias("b"), F.least(cap, a + half).alias("cap")))
    dealt = rows.select("word", "n", "m", F.explode(parts).alias("p")).where("p.a < p.cap")
    return dealt.select("m", "p.a", "p.b", "p.cap", _shared(F.col("word"), F.col("p.a"), F.col("p.b")).alias("shared"), "word", "n")


def _small_blocks(words: DataFrame, limit: int) -> DataFrame:
    """Words by block, no block with more than ``limit`` words; large blocks are counted first and never shuffled whole."""
    rows, small = _dictionaries(words), None
    while True:
        divisible = F.col("m") - F.col("a") - F.col("b") > 1
        large = stored(rows.where(divisible).groupBy(*BLOCK).agg(F.count("*").alias("size")).where(F.col("size") > limit).drop("size"), "large")
        rest = rows.join(large, BLOCK, "left_anti").select(*BLOCK, "word", "n")
        small = rest if small is None else small.unionByName(rest)
        if large.isEmpty():
            return small
        rows = stored(_subdivided(rows.join(large, BLOCK, "left_semi")), "subdivided")


def _met(m: int, blocks, words: list[bytes], caps, counts):
    """Rows of a run of sorted blocks that have near words: how many, and the place of the nearest by count.

    ``blocks`` numbers the block of each row; rows are compared with the next one of their block, the next but one, and
    so on, all at once.
    """
    import numpy as np

    size = np.fromiter(map(len, words), np.int64, len(words))
    front = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(-1, m)
    back = np.frombuffer(b"".join(w.rjust(m, b"\0")[::-1] for w in words), np.uint8).reshape(-1, m)
    ones, others, at, step = [], [], np.arange(len(words)), 1
    while len(at := at[at < len(words) - step]):
        at = at[blocks[at] == blocks[at + step]]
        for i in np.array_split(at, len(at) * m // 4_000_000 + 1):
            i = i[np.maximum(size[i], size[i + step]) == m]
            j = i + step
            prefix = (front[i] == front[j]).argmin(axis=1)
            suffix = (back[i] == back[j]).argmin(axis=1)
            near = (prefix + suffix >= m - 1) & (prefix < caps[i])
            ones.append(i[near])
            others.append(j[near])
        step += 1
    if not ones:
        return [np.zeros(0, np.int64)] * 3
    one, other = np.concatenate([*ones, *others]), np.concatenate([*others, *ones])
    order = np.lexsort((other, -counts[other], one))  # within a block, places are in the order of words
    one, other = one[order], other[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else one
    return one[first], np.diff(np.r_[first, len(one)]), other[first]


def _near(blocks: DataFrame, rows_at_once: int = 100_000, letters_at_once: int = 8_000_000) -> DataFrame:
    """word, n_near, best (negative count and word of the commonest near word) by block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, last, letters, number = [], None, 0, 0

        def emit():
            rows, n, best = _met(held[0][0], np.array([r[1] for r in held]), [r[3].encode("latin-1") for r in held], np.array([r[2] for r in held]), counts := np.array([r[4] for r in held]))
            found = [pa.array([held[i][3] for i in rows], pa.string()), pa.array(n, pa.int64()), pa.array(-counts[best], pa.int64()), pa.array([held[i][3] for i in best], pa.string())]
            held.clear()
            return pa.RecordBatch.from_arrays(found, names=["word", "n_near", "less", "form"])

        for batch in batches:
            for m, a, b, cap, shared, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block := (m, a, b, cap, shared)) != last:
                    if held and (m != last[0] or len(held) >= rows_at_once or letters >= letters_at_once):
                        yield emit()
                        letters = 0
                    last, number = block, number + 1
                held.append((m, number, cap, word, n))
                letters += m
        if held:
            yield emit()

    dealt = blocks.select(*BLOCK, "word", "n").repartition(shuffle_parts(blocks.sparkSession), *BLOCK).sortWithinPartitions(*BLOCK, "word")
    return dealt.mapInArrow(scan, "word string, n_near long, less long, form string")


def group_spellings(words: DataFrame, ratio: int = 10, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; each word once, of :data:`LETTERS`).

    Words are near if they differ by one letter inserted, deleted or replaced. A word's form is its near word with the
    largest n (ties: the smallest in code-point order), if that n is at least ``ratio`` times its own, else null. The root
    is what following forms leads to; a word without a form is its own. Words are compared whole, however long they are;
    rows without a word or n are left out, other columns are not read, and an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms must be commoner than their words")
    words = words.select("word", "n").where("word IS NOT NULL AND word <> '' AND n IS NOT NULL")
    near = _near(_small_blocks(words, limit)).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct("less", "form").alias("best"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: bigint, form: string>").alias("best"))
    met = own.unionByName(near).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    formed = stored(met.select("word", F.when(common, F.col("best.form")).alias("form"), "n", "n_near", F.when(common, -F.col("best.less")).alias("form_n")), "formed")
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root of words with a form: paths are halved until none is left. Each form is commoner by ``ratio``, so
    there are no circles and paths are short."""
    links = stored(links.select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, min_letters: int = 7, min_count: int = 2, ratio: int = 10, noise: int = 0, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`group_spellings` of the words of ``docs`` (see :func:`count_words`) that occur ``min_count`` times or more."""
    words = stored(count_words(docs, min_letters, noise, id_col, text_col).where(F.col("n") >= min_count), "words")
    return group_spellings(words, ratio, limit)
