import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
import regex
import tiktoken
from pyspark.sql import functions as F

from quillmark.llm import token_counts as tc
from quillmark.llm import ann_search
from quillmark.llm.ann_search import nearest
from quillmark.llm.byte_bpe import Merger, decode_ids, encode_documents, merge_words, rank_slots, read_ranks
from quillmark.llm.language_id import fit, held_out, identify, predict
from quillmark.llm.mixing import budgets, mix

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, "<|endoftext|>", "it's  we'll\n\n x", "naïve 12³ 你好 🙂🙂", "a" * 3000, " " * 50 + "x", "՘ \U0003e965's \x1c\x85", "'s" * 300]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_the_library_s(spark, library):
    rows = [(n, t, 1) for n, t in enumerate(ODD)] + [(None, "same", 1), (None, "same", 1)]
    found = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), RANKS, P.PATTERN, with_ids=True).collect()
    assert len(found) == len(rows)
    for r, (_, text, _) in zip(found, rows, strict=True):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert r.n_tokens == len(ids) and bytes(r.ids) == ids.tobytes() and bytes(r.decoded) == (text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_merging_long_words(ranks, library):
    rng, merger = random.Random(1), Merger(ranks)
    for n in (3, 50, 401, 900):
        word = "".join(rng.choice("abeint") for _ in range(n))
        assert merger.encode_word(word.encode()) == merger._encode_long(word.encode()) == library.encode_ordinary(word)


def test_higher_order_form(spark, library):
    words = ["hello", " tokenisation", "zxqv", "é", "ththeheer", "", " \n"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    found = table.crossJoin(F.broadcast(rank_slots(spark, RANKS))).select("word", merge_words(F.col("word").cast("binary"), F.col("slots")).alias("ids")).collect()
    for r in found:
        whole = [library._encode_single_piece(r.word)] if r.word else [[]]
        assert r.ids == whole[0]
    ids = spark.createDataFrame([(1, library.encode_ordinary("naïve 你好")), (2, []), (3, None)], "n int, ids array<int>")
    decoded = {r.n: r.decoded for r in decode_ids(ids, RANKS).collect()}
    assert bytes(decoded[1]).decode() == "naïve 你好" and bytes(decoded[2]) == b"" and decoded[3] is None


def test_edits_keep_counts(ranks):
    count, cut = tc.Counter(ranks), regex.compile(P.PATTERN)
    rng, letters = random.Random(5), "ab c'\n s1.é!  "
    for _ in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 30, 300, 1500])))
        chars, tokens = tc.leaves_of(cut.findall(text), count)
        tree = tc.build_tree(tokens)
        for _ in range(3):
            edits = []
            for _ in range(rng.choice([1, 1, 2, 5])):
                a = rng.randint(0, len(text))
                edits.append((a, min(len(text), a + rng.choice([0, 1, 5, 60, 400])), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 100])))))
            parts, at = [], 0
            for a, b, new in sorted(edits):
                if at <= a <= b:
                    parts, at = [*parts, text[at:a], new], b
            wanted = "".join([*parts, text[at:]])
            text, _ = tc.apply_edits(text, chars, tree, edits, cut.finditer, count)
            words = cut.findall(wanted)
            assert text == wanted and sum(chars) == len(text) and tree[1] == sum(count[w] for w in words)


def test_leaves_stay_small(ranks):
    count, cut = tc.Counter(ranks), regex.compile(P.PATTERN)
    rng, text = random.Random(8), "start "
    chars, tokens = tc.leaves_of(cut.findall(text), count)
    tree = tc.build_tree(tokens)
    made = []
    for n in range(300):  # always at about the same place
        text, encoded = tc.apply_edits(text, chars, tree, [(5, 5, f" word {rng.choice('abc')}{n}, and" * rng.choice([1, 2, 30]))], cut.finditer, count)
        made.append(encoded)
        assert sum(chars) == len(text) and tree[1] == sum(count[w] for w in cut.findall(text))
    borders = np.cumsum([0, *chars])
    assert max(len(cut.findall(text[a:b])) for a, b in zip(borders, borders[1:])) <= 2 * tc.LEAF + 1
    assert max(made) < 400 < len(cut.findall(text)) / 10


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, tree int")
    assert tc.recount(tc.redactions(tc.token_trees(none, RANKS, P.PATTERN)), RANKS, P.PATTERN).count() == 0
    assert encode_documents(none, RANKS, P.PATTERN).count() == 0
    assert identify(none).count() == 0


def test_recount(spark, library):
    rows = [(1, "mail a.b@c.de now, " + "word " * 400 + "password=hunter2 +1 (988) 555-2485 end"), (2, None), (3, "plain"), (None, "x@y.zz"), (3, "plain")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, tree int")
    found = tc.recount(tc.redactions(tc.token_trees(docs, RANKS, P.PATTERN)), RANKS, P.PATTERN).collect()
    assert len(found) == 5
    for r in found:
        assert r.tree[1] == len(library.encode_ordinary(r.text))
    one = found[0]
    assert one.n_edits == 3 and "[EMAIL]" in one.text and "[SECRET]" in one.text and "[PHONE]" in one.text and one.n_before == len(library.encode_ordinary(rows[0][1]))
    assert 0 < one.n_encoded < 300


def brute_nearest(rows, asked, k):
    use = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in use:
        if q in asked:
            scores = [(-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in use if i != q and len(b) == len(a)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scores)[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(n, rng.normal(size=8).tolist()) for n in range(300)]
    rows += [(300 + n, rows[5][1]) for n in range(20)]  # ties go to the smaller id
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, None] * 4), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8), (405, [1.0, 2.0]), (406, [])]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    asked = {i for i, _ in rows if i is not None and i % 50 in (0, 5)}
    for blocks in ({}, {"query_block": 4, "candidate_block": 16}):
        found = nearest(table, table.where("vec_id % 50 in (0, 5)"), k=5, **blocks).orderBy("query_id", "rank").collect()
        got = {}
        for r in found:
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        wanted = brute_nearest([(i, [None if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in rows if i is not None], asked, 5)
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in wanted.items() if v}
        assert all(abs(a[1] - b[1]) < 1e-9 for q in got for a, b in zip(got[q], wanted[q], strict=True))
    assert nearest(table.limit(0), table.limit(0)).count() == 0
    wide = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (3, [-1.0, -1.0]), (4, [3.0, 3.0])], "vec_id long, embedding array<double>")
    found = nearest(wide, wide.where("vec_id = 0"), k=4).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [2, 4, 1, 3] and [r.score for r in found] == pytest.approx([1, 1, 0.5**0.5, -1])


def test_neighbours_without_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(n, rng.normal(size=16).tolist()) for n in range(500)] + [(7, rng.normal(size=16).tolist()), (1000, [1.0, 2.0]), (1001, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = table.where("vec_id % 10 = 0")
    one = nearest(table, asked, k=5, query_block=8, candidate_block=32)
    got = one.orderBy("query_id", "rank").collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastExchange" not in plan
    monkeypatch.setattr(ann_search, "SLICE_ROWS", 16)  # 51 queries in 4 slices
    monkeypatch.setattr(ann_search, "SHARDS", 3)
    assert nearest(table, asked, k=5, query_block=8, candidate_block=32).orderBy("query_id", "rank").collect() == got
    assert len(got) == 251 and [(r.vec_id, r.score) for r in got if r.query_id == 1000] == [(1001, pytest.approx(0.8))]
    # blocks of one candidate each, two of them with the same id
    assert nearest(table, asked, k=5, query_block=1, candidate_block=1).orderBy("query_id", "rank").collect() == got


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() > 0.95 * held.count() > 100
    model = fit(docs)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "a"), (None, docs.where("lang = 'de'").first().text), (5, docs.where("lang = 'fr'").first().text * 2000)]
    got = predict(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string"), model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[0].score == 0.0
    assert got[4].lang_pred == "de" and got[5].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got)
    empty = identify(docs.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in empty} == {("und", 0.0)}


def grams(text):
    """Letter trigrams around each letter, other characters as one mark."""
    kept = [c if c.isalpha() else "\0" for c in text.lower()]
    padded = ["\0", *kept, "\0"]
    return [tuple(padded[i : i + 3]) for i in range(len(kept)) if kept[i] != "\0"]


def test_languages_against_plain_sets(spark):
    """Sets of trigrams instead of filters: the same languages, and scores within what false positives may change."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).collect()}
    counts = {}
    for r in rows:
        if r.doc_id not in held and r.text is not None and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    own = {x: sorted((g for g, p in s.items() if p >= 0.2 * max(t.get(g, 0) for t in share.values())), key=lambda g: (-counts[x][g], (ord(g[0]) * (g[0] != "\0"), ord(g[1]), ord(g[2]) * (g[2] != "\0"))))[:4000] for x, s in share.items()}
    own = {x: set(s) for x, s in own.items()}
    found = {r.doc_id: r for r in identify(docs).collect()}
    assert {i for i, r in found.items() if r.held_out} == held
    for r in rows:
        mine = grams(r.text or "")
        if not mine:
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        scores = {x: sum(g in s for g in mine) / len(mine) for x, s in own.items()}
        best = max(sorted(scores), key=scores.get)
        assert found[r.doc_id].score == pytest.approx(scores[best], abs=0.02)
        assert scores[found[r.doc_id].lang_pred] >= scores[best] - 0.02


def fill(budget, rooms, weights):
    """Water filling by hand: whole numbers, children that cannot take their share first."""
    open_, out = {k for k in rooms if weights[k] > 0 and rooms[k] > 0}, {}
    while True:
        left, total = budget - sum(out.values()), sum(weights[k] for k in open_)
        full = [k for k in open_ if rooms[k] * total <= weights[k] * max(left, 0)]
        if not full:
            return out | {k: weights[k] * left // total for k in open_}
        k = min(full, key=lambda k: (rooms[k] / weights[k], k))
        out[k] = rooms[k]
        open_.discard(k)


def test_budgets(spark):
    rng = random.Random(7)
    stats = [(f"d{d}", f"l{x}", f"s{s}", rng.choice([0, 5, 100, 3000])) for d in range(3) for x in range(3) for s in range(4)]
    weights = {"domain": {"d0": 5, "d1": 1, "d2": 0}, "lang": {"l0": 3}}
    found = {tuple(r[:3]): r.budget for r in budgets(spark.createDataFrame(stats, "domain string, lang string, source string, tokens long"), ["domain", "lang", "source"], weights, 20_000, max_epochs=2).collect()}
    room = lambda *path: 2 * sum(t for *p, t in stats if tuple(p[: len(path)]) == path)
    wanted = {}
    for d, b in fill(20_000, {d: room(d) for d in ("d0", "d1", "d2")}, weights["domain"]).items():
        for x, c in fill(b, {x: room(d, x) for x in ("l0", "l1", "l2")}, {"l0": 3, "l1": 1, "l2": 1}).items():
            for s, e in fill(c, {s: room(d, x, s) for s in ("s0", "s1", "s2", "s3")}, dict.fromkeys(("s0", "s1", "s2", "s3"), 1)).items():
                wanted[d, x, s] = e
    assert found == wanted


def test_mixing(spark):
    rows = [(n, "w " * (n % 13), ["a", "b", None][n % 3], 0) for n in range(400)] + [(5, None, "a", 0), (None, "w w", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, epochs int")
    found = mix(docs, ["lang"], {"lang": {"a": 8, "b": 1}}, budget_percent=60).collect()
    assert len(found) == len(rows)
    total = sum(r.n_tokens for r in found)
    assert abs(sum(r.selected_tokens for r in found) - total * 60 // 100) <= 3
    assert all(0 <= r.extra_tokens <= r.n_tokens for r in found) and {r.lang for r in found} == {"a", "b", "(none)"}
    assert mix(docs.limit(0), ["lang"], {}).count() == 0


def brute_leaf(rows, leaf, epochs, rest, seed=17):
    """(extra_tokens by row) of one leaf: rows in the order of their draws, until ``rest`` is used up."""
    draw = lambda r: hashlib.md5("-".join([str(seed), str(epochs), "" if r[0] is None else str(r[0])]).encode()).hexdigest()
    out = []
    for r in sorted(rows, key=lambda r: (draw(r), -1 if r[0] is None else r[0], r[1])):
        out.append((r[0], r[1], max(min(r[1], rest), 0)))
        rest -= out[-1][2]
    return out


@pytest.mark.parametrize("percent,most", [(35, 4), (90, 3), (250, 6), (300, 2)])
def test_mixing_by_brute_force(spark, percent, most):
    """Several epochs, leaves of thousands of rows, many rows of one draw in the slice where a pass ends."""
    rng = random.Random(percent)
    rows = [(n, rng.randint(0, 9), "ab"[n % 5 == 0]) for n in range(9000)] + [(4, 3, "a")] * 300 + [(4, 2, "a")] * 300 + [(None, 5, "b")] * 200
    docs = spark.createDataFrame([(i, "w " * n, x) for i, n, x in rows], "doc_id long, text string, lang string")
    found = mix(docs, ["lang"], {"lang": {"a": 1, "b": 2}}, budget_percent=percent, max_epochs=most).collect()
    sizes = {x: sum(n for _, n, y in rows if y == x) for x in "ab"}
    given = fill(sum(sizes.values()) * percent // 100, {x: most * s for x, s in sizes.items()}, {"a": 1, "b": 2})
    for leaf in "ab":
        epochs, rest = divmod(given[leaf], sizes[leaf])
        wanted = Counter((i, n, epochs, extra, epochs * n + extra) for i, n, extra in brute_leaf([(i, n) for i, n, x in rows if x == leaf], leaf, epochs, rest))
        assert Counter((r.doc_id, r.n_tokens, r.epochs, r.extra_tokens, r.selected_tokens) for r in found if r.lang == leaf) == wanted


def test_very_long_texts(spark, library):
    """Five megabytes in one text: encoded, decoded, counted and counted again after edits."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(900_000)) + " mail me@here.org " + "y" * 4_000
    assert len(text.encode()) > 5_000_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    ids = np.array(library.encode_ordinary(text), "<u4")
    one = encode_documents(docs, RANKS, P.PATTERN).where("doc_id = 1").first()
    assert one.n_tokens == len(ids) and one.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and one.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    two = tc.recount(tc.redactions(tc.token_trees(docs, RANKS, P.PATTERN)), RANKS, P.PATTERN).where("doc_id = 1").first()
    assert two.n_before == len(ids) and two.n_edits == 1 and two.tree[1] == len(library.encode_ordinary(two.text)) and two.n_encoded < 2000


def test_languages_of_odd_rows(spark):
    """Ties go to the first name, repeated rows and rows without an id get a prediction each, too many labels are an error."""
    rows = [(n, "qqq qqq", x) for n, x in enumerate(["zz", "aa", "mm"] * 4)] + [(1, "qqq qqq", "aa"), (1, "qqq qqq", "aa"), (None, "qqq", "aa"), (None, None, "aa"), (90, "qqq", None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    found = identify(docs).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found} == {"aa", "und"} and sum(r.lang_pred == "und" for r in found) == 1
    assert sum(r.doc_id is None for r in found) == 2 and not any(r.held_out for r in found if r.doc_id is None)
    with pytest.raises(ValueError, match="more than 2 labels"):
        fit(docs, most_languages=2)
    many = spark.createDataFrame([(n, f"w{chr(0x4E00 + n)}{chr(0x4E00 + n)}", f"l{n:03d}") for n in range(150)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in predict(many, fit(many)).collect()} == {(n, f"l{n:03d}") for n in range(150)}


def test_redactions_replace_their_column(spark):
    trees = tc.token_trees(spark.createDataFrame([(1, "a@b.cc"), (2, None)], "doc_id long, text string"), RANKS, P.PATTERN).withColumn("edits", F.lit("old")).withColumn("mark", F.lit(9))
    found = tc.redactions(trees).orderBy("doc_id").collect()
    assert [len(r.edits) for r in found] == [1, 0] and found[0].mark == 9
