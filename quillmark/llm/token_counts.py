"""Token counts that follow edits.

A document's pre-tokens stand in leaves of :data:`LEAF` pre-tokens, and a segment tree holds the tokens below each node.
An edit re-encodes only the leaves it touches, from the leaf of the character before it and before the white space that
leads up to it (where a pre-token ends depends on the white space after it and on one character more) to the first old leaf border after it where pre-tokens of the new text
end too; from there on both texts cut alike. The new pre-tokens take the places of the old leaves, and only
sums above changed leaves are updated. Where they are more than twice as many as those leaves should hold, the leaves
are split and the sums built anew, so leaves stay small however often a place is edited. The root is the count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Merger, library_classes, read_ranks

LEAF = 32
EDITS = "array<struct<first: int, beyond: int, replacement: string>>"
TREES = "doc_id long, text string, leaf_chars array<int>, tree array<long>"

#: What is replaced before training, and by what; each pattern starts with rare characters, so scanning is fast.
REDACTIONS = [(r"[^\s@]+@[^\s@]+\.[a-z]{2,}", "[EMAIL]", "@"), (r"(?:password|secret|token|api_key)=[^\s,;]+", "[SECRET]", "="), (r"\+\d[\d ()-]{6,}\d", "[PHONE]", "+")]


class Counter(dict):
    """Tokens of a pre-token, remembering short ones; emptied when full."""

    def __init__(self, ranks, limit: int = 300_000):
        super().__init__()
        self.merge, self.limit = Merger(ranks), limit

    def __missing__(self, word: str) -> int:
        n = len(self.merge.encode_word(word.encode()))
        if len(self) > self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def build_tree(leaves: list[int]) -> list[int]:
    """Sums in heap order: node i has children 2 i and 2 i + 1, leaves stand in the second half."""
    size = max(1, 1 << (len(leaves) - 1).bit_length()) if leaves else 1
    tree = [0] * size + list(leaves) + [0] * (size - len(leaves))
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def set_leaf(tree: list[int], leaf: int, tokens: int) -> None:
    at = leaf + len(tree) // 2
    change = tokens - tree[at]
    while at and change:
        tree[at] += change
        at //= 2


def leaves_of(words: list[str], count: Counter) -> tuple[list[int], list[int]]:
    """Characters and tokens of each leaf."""
    import numpy as np

    if not words:
        return [], []
    cuts = np.arange(0, len(words), LEAF)
    chars = np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)), cuts)
    tokens = np.add.reduceat(np.fromiter(map(count.__getitem__, words), np.int64, len(words)), cuts)
    return chars.tolist(), tokens.tolist()


def apply_edits(text: str, leaf_chars: list[int], tree: list[int], edits: list[tuple[int, int, str]], finditer, count: Counter) -> tuple[str, int]:
    """Edit a text and, in place, its leaves and sums; gives the new text and how many pre-tokens were encoded.

    Edits are (first, beyond, replacement) by characters of the text given. They are applied in order of ``first``; one
    that overlaps an earlier edit is left out, as is one that does not lie inside the text.
    """
    chosen, end = [], 0
    for first, beyond, new in sorted(edits):
        if end <= first <= beyond <= len(text):
            chosen.append((first, beyond, new))
            end = beyond
    if not chosen:
        return text, 0
    if not leaf_chars:
        leaf_chars.append(0)
    borders = [0]
    for n in leaf_chars:
        borders.append(borders[-1] + n)
    parts, at = [], 0
    for first, beyond, new in chosen:
        parts += [text[at:first], new]
        at = beyond
    edited = "".join([*parts, text[at:]])
    context = []  # the character before an edit and before the white space that leads up to it
    for first, _, _ in chosen:
        before = first - 1
        while before > 0 and text[before].isspace():
            before -= 1
        context.append(before)
    encoded, k, shift, leaf = 0, 0, 0, 0
    split: list[tuple[int, int, list[int], list[int]]] = []  # leaves that have outgrown their size, with new ones for them
    while k < len(chosen):
        while leaf < len(leaf_chars) - 1 and borders[leaf + 1] <= context[k]:
            leaf += 1
        begin = leaf
        start = borders[begin] + shift
        words, pos, stop = [], start, None
        shift += len(chosen[k][2]) - (chosen[k][1] - chosen[k][0])
        k += 1
        for match in finditer(edited, start):
            if match.start() < pos:
                continue
            words.append(match.group())
            pos = match.end()
            while k < len(chosen) and context[k] + shift < pos:  # the next edit depends on what was cut again
                shift += len(chosen[k][2]) - (chosen[k][1] - chosen[k][0])
                k += 1
            # never before the last edit's end, nor while what was edited may still reach into the pre-token
            if pos - shift < chosen[k - 1][1]:
                continue
            while leaf < len(leaf_chars) and borders[leaf + 1] < pos - shift:
                leaf += 1
            if leaf < len(leaf_chars) and borders[leaf + 1] == pos - shift:
                stop = leaf + 1
                break
        if stop is None:  # the text ended: no edit is left
            stop, k = len(leaf_chars), len(chosen)
        encoded += len(words)
        slots = stop - begin
        per = -(-len(words) // slots) if words else 1
        if per > 2 * LEAF:
            split.append((begin, stop, *leaves_of(words, count)))
        for n in range(slots):
            mine = words[n * per : (n + 1) * per]
            leaf_chars[begin + n] = sum(map(len, mine))
            set_leaf(tree, begin + n, sum(map(count.__getitem__, mine)))
        leaf = min(stop, len(leaf_chars) - 1)
    if split:
        tokens = tree[len(tree) // 2 :][: len(leaf_chars)]
        for begin, stop, new_chars, new_tokens in reversed(split):
            leaf_chars[begin:stop], tokens[begin:stop] = new_chars, new_tokens
        tree[:] = build_tree(tokens)
    return edited, encoded


def _tools(ranks_path: str, pattern: str, spark):
    exact, first = library_classes(pattern)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary file

    def tools():
        import regex

        plain, careful = regex.compile(pattern), regex.compile(exact, regex.V1)
        unsure = re.compile(f"[\\U{min(first, 0x10FFFF):08x}-\U0010ffff]").search
        return (lambda text: careful if unsure(text) else plain), Counter(ranks.value)

    return tools


def token_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, leaf_chars, tree of every row; ``tree[1]`` is the count. A null text is an empty one.

    A text is counted whole, however long; repeated rows and null ids are rows like others. An empty table gives an
    empty result; other columns are not read.
    """
    tools = _tools(ranks_path, pattern, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, count = tools()
        for batch in batches:
            chars, trees = [], []
            for text in batch.column(1):
                text = text.as_py()
                leaf_chars, tokens = leaves_of(cutter(text).findall(text), count)
                chars.append(leaf_chars)
                trees.append(build_tree(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chars, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int64()))], names=["doc_id", "text", "leaf_chars", "tree"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, TREES)


def recount(trees: DataFrame, ranks_path: str, pattern: str, edits_col: str = "edits") -> DataFrame:
    """Apply each row's edits: the columns of :func:`token_trees` for the edited texts, with n_before, n_encoded, n_edits.

    Null edits are none, edits in one place apply by their order, and overlapping ones after the first are left out.
    Rows stay as they are where nothing is edited; an empty table gives an empty result.
    """
    tools = _tools(ranks_path, pattern, trees.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, count = tools()
        for batch in batches:
            texts, chars, sums, before, encoded, n = [], [], [], [], [], []
            for text, leaf_chars, tree, edits in zip(*(batch.column(k) for k in (1, 2, 3, 4)), strict=True):
                text, leaf_chars, tree = text.as_py(), leaf_chars.as_py(), tree.as_py()
                edits = [(e["first"], e["beyond"], e["replacement"]) for e in edits.as_py() or []]
                before.append(tree[1])
                made = 0
                if edits:
                    fine = cutter(text + "".join(e[2] for e in edits))
                    text, made = apply_edits(text, leaf_chars, tree, edits, fine.finditer, count)
                texts.append(text)
                chars.append(leaf_chars)
                sums.append(tree)
                encoded.append(made)
                n.append(len(edits))
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in (before, encoded, n))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "leaf_chars", "tree", "n_before", "n_encoded", "n_edits"])

    rows = trees.select("doc_id", "text", "leaf_chars", "tree", F.col(edits_col).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, TREES + ", n_before long, n_encoded long, n_edits long")


def redactions(trees: DataFrame) -> DataFrame:
    """``trees`` with a column ``edits``: the spans that :data:`REDACTIONS` replace, as one list a row (a column of that name
    is replaced, others pass as they are).

    A null or empty text has no edits. Each rule's spans are listed, in the order of rules; where spans meet, the one that
    begins first is applied, of two that begin together the one that ends first, and what it covers is not edited again.
    """
    trees = trees.drop("edits")
    names = trees.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(re.compile(pattern).finditer, new, mark) for pattern, new, mark in REDACTIONS]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("beyond", pa.int32()), ("replacement", pa.string())]))
        for batch in batches:
            edits = []
            for text in batch.column(at):
                text = text.as_py() or ""
                edits.append([{"first": m.start(), "beyond": m.end(), "replacement": new} for find, new, mark in rules if mark in text for m in find(text)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], names=[*names, "edits"])

    return trees.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in trees.dtypes) + f", edits {EDITS}")
