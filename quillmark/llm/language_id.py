"""Language identification with bit-sliced Bloom filters of letter trigrams.

For each language the most frequent trigrams that are its own (not many times more frequent elsewhere) enter a Bloom
filter. The filters have one size and the same hash functions and are stored sliced: a slot holds one bit a language,
so the AND of a trigram's slots is the bitmask of all languages that contain it. For a text, the bits of all its
trigrams are counted by language, the counts are corrected for the filters' false positives, and the largest wins.

The model is fitted on a bounded sample of labelled rows: about ``sample_per_language`` rows of each language, taken by
a hash of the id. Prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, tidy

#: Characters handled at once; longer texts are counted piece by piece.
PIECE = 500_000
#: Characters of short texts that are counted together; each takes about 57 bytes meanwhile.
TOGETHER = 100_000


@dataclass
class LanguageModel:
    languages: list[str]
    slots: list  # one array of bit masks for each 64 languages
    false_positive: list[float]
    hashes: int = 2


def _letters():
    """Code point to itself if it is a letter, else 0."""
    import numpy as np

    codes = np.arange(0x110000, dtype=np.uint32)
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(alpha, codes, 0).astype(np.uint32)


def _grams(codes, letters):
    """Trigrams around each letter, packed in 63 bits; what is not a letter is one and the same mark."""
    import numpy as np

    kept = np.zeros(len(codes) + 2, np.uint64)
    kept[1:-1] = letters[codes]
    return kept[1:-1] != 0, kept[:-2] << np.uint64(42) | kept[1:-1] << np.uint64(21) | kept[2:]


def _positions(grams, size: int, hashes: int):
    """``hashes`` slots of each trigram, from one mixed 64-bit value."""
    import numpy as np

    mixed = grams * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    step = (mixed >> np.uint64(40)) | np.uint64(1)
    return [((mixed + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(hashes)]


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 4000, grams_per_language: int = 4000, share: float = 0.2, slots: int = 2**20, most_languages: int = 512) -> LanguageModel:
    """Learn from rows with a text and a language; rows where either or the id is null are left out.

    Every label is learned; more than ``most_languages`` of them are an error, so that dirty labels neither let the model
    grow without a bound nor go unlearned. Repeated rows are all in the sample or all out of it.

    A trigram enters a language's filter when it is among its ``grams_per_language`` most frequent and its relative
    frequency there is at least ``share`` of its largest in any language.
    """
    import numpy as np

    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    labels = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(labels) > most_languages:
        raise ValueError(f"more than {most_languages} labels; clean them or raise most_languages")
    sizes = dict(sorted((r[0], r[1]) for r in labels))
    languages = list(sizes)
    if not languages:
        return LanguageModel([], [], [])
    fraction = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, sample_per_language / n)))])[F.col("lang")]
    number = F.create_map(*[x for n, name in enumerate(languages) for x in (F.lit(name), F.lit(n))])[F.col("lang")]
    uniform = F.pmod(F.xxhash64("id", F.lit(101)), F.lit(2**40)) / float(2**40)
    sample = rows.where(uniform < fraction).select(number.alias("lang"), "text")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            held: dict[int, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, grams = _grams(_codes(text.as_py()), letters)
                held.setdefault(lang, []).append(grams[at])
            for lang, found in held.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), lang, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "grams")  # of the sample, so of a bounded number of texts
    within = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("all")), "lang").withColumn("p", F.col("n") / F.col("all"))
    own = within.withColumn("most", F.max("p").over(Window.partitionBy("gram"))).where(F.col("p") >= share * F.col("most"))
    best = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= grams_per_language)
    chosen = best.select("lang", "gram").toPandas()  # at most languages x grams_per_language
    tables = [np.zeros(slots, np.uint64) for _ in range(-(-len(languages) // 64))]
    for lang in range(len(languages)):
        grams = chosen.gram.to_numpy(np.int64)[chosen.lang.to_numpy() == lang].astype(np.uint64)
        for at in _positions(grams, slots, 2):
            tables[lang // 64][at] |= np.uint64(1 << lang % 64)
    filled = [float(((tables[n // 64] >> np.uint64(n % 64)) & np.uint64(1)).mean()) for n in range(len(languages))]
    if len(languages) <= 8:  # a mask of one byte keeps the slots in the processor's cache
        tables = [tables[0].astype(np.uint8)]
    return LanguageModel(languages, tables, [x**2 for x in filled])


def score_texts(texts: list[str | None], model: tuple, letters) -> tuple[list[str], list[float]]:
    """Language and corrected share of trigrams of each text."""
    import numpy as np

    languages, slots, false_positive, hashes = model
    n, total = len(languages), np.zeros(len(texts), np.int64)
    hits = np.zeros((len(texts), n))

    def add(codes, owners, starts):
        at, grams = _grams(codes, letters)
        total[owners] += np.add.reduceat(at.astype(np.int64), starts)
        for word, table in enumerate(slots):
            mask = None
            for pos in _positions(grams, len(table), hashes):
                mask = table[pos] if mask is None else mask & table[pos]
            mask = np.where(at, mask, mask.dtype.type(0))
            for lang in range(64 * word, min(n, 64 * word + 64)):
                hits[owners, lang] += np.add.reduceat((mask >> mask.dtype.type(lang % 64)) & mask.dtype.type(1), starts, dtype=np.int64)

    held, owners, size = [], [], 0
    for owner, text in enumerate([*texts, None]):
        codes = _codes(text + "\n") if text else None
        if held and (owner == len(texts) or size + (0 if codes is None else len(codes)) > TOGETHER):
            add(np.concatenate(held), np.array(owners), np.cumsum([0, *map(len, held[:-1])]))
            held, owners, size = [], [], 0
        if codes is None:
            continue
        for start in range(0, len(codes), PIECE):  # neighbouring pieces of a very long text share no trigram
            held, owners, size = [*held, codes[start : start + PIECE]], [*owners, owner], size + min(PIECE, len(codes) - start)
            if start + PIECE < len(codes):
                add(np.concatenate(held), np.array(owners), np.cumsum([0, *map(len, held[:-1])]))
                held, owners, size = [], [], 0
    if not n:
        return ["und"] * len(texts), [0.0] * len(texts)
    wrong = np.array(false_positive)
    share = np.clip((hits - total[:, None] * wrong) / (1 - wrong) / np.maximum(total, 1)[:, None], 0, 1)
    best = share.argmax(axis=1)
    names = np.array(languages, object)[best]
    score = np.where(total > 0, share[np.arange(len(texts)), best], 0.0)
    return ["und" if t == 0 else x for x, t in zip(names, total, strict=True)], score.tolist()


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of those names are replaced).

    lang_pred is ``und`` and score 0 where the text is null or has no letter, or where nothing was learned. Ties go to
    the language that comes first by name. Every other column passes through as it is, repeated rows too; a table
    without rows gives none.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast((model.languages, model.slots, model.false_positive, model.hashes))  # slots of a fixed number and one name a language
    at = rest.index(text_col)
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            names, scores = score_texts(batch.column(at).to_pylist(), shared.value, letters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest).mapInArrow(run, schema)


def held_out(doc_id) -> Column:
    """Rows that are never learned from: a quarter, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out.

    Rows without an id are not learned from and count as not held out; they, repeated rows and rows without a label get
    a prediction like any other. Ties go to the language that comes first by name. Texts may have any length. An empty
    table gives an empty result; other columns are not read.
    """
    model = fit(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
