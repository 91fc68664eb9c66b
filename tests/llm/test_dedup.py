import hashlib
import random
import re

import numpy as np
import pytest

from quillmark.llm import components, jaccard_join, suffix_dedup, window_dedup
from quillmark.llm.components import connected
from quillmark.llm.exact_dedup import exact_dedup
from quillmark.llm.jaccard_join import differing, jaccard_components, shingle_set, sketch
from quillmark.llm.line_templates import line_dedup
from quillmark.llm.words import split_words

DOCS = "doc_id long, text string, keep_id string, bucket int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


def test_exact(spark):
    rows = [(1, "Aé"), (2, "aé"), (3, "aÉ"), (4, None), (5, ""), (6, "x" * 100_000), (None, "aé"), (7, "only"), (7, "only"), (None, "nobody")]
    for options in ({}, {"max_filter_bits": 2**15, "bits_per_row": 2**14}):
        found = exact_dedup(table(spark, rows), **options).collect()
        assert len(found) == len(rows)
        by = {}
        for r in found:
            by.setdefault(r.text_sha256, set()).add((r.doc_id, r.keep_id, r.group_size, r.kept))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert by[sha("aé")] == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False)}
        assert by[sha("")] == {(4, 5, 2, False), (5, 5, 2, True)}
        assert by[sha("only")] == {(7, 7, 2, True)} and by[sha("nobody")] == {(None, None, 1, True)}
    assert exact_dedup(table(spark, rows), keep="min").where("text_sha256 like '%' and doc_id = 1").first().kept
    assert exact_dedup(table(spark, []).limit(0)).count() == 0
    plan = exact_dedup(table(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    again = rows * 3 + [(None, f"alone {n}") for n in range(40)] + [(n, f"pair {n % 20}") for n in range(40)] * 2
    whole = sorted((tuple(r) for r in exact_dedup(table(spark, again)).collect()), key=str)
    for slices in (5, 60):
        assert sorted((tuple(r) for r in exact_dedup(table(spark, again), max_filter_bits=2**15, bits_per_row=2**15 * slices // len(again)).collect()), key=str) == whole
    many = [(n, f"text {n % 700}") for n in range(1500)]
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(table(spark, many), max_filter_bits=2**15, bits_per_row=100).collect()}
    sizes = {k: len([n for n in range(1500) if n % 700 == k]) for k in range(700)}
    assert found == {n: (max(m for m in range(n % 700, 1500, 700)), sizes[n % 700]) for n in range(1500)}


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)  # small: several blocks, so rounds
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize("short", [48, 8])
def test_jaccard_against_all_pairs(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrst")
    base = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "one two three"), (5, " \t\n")]
    for n in range(40):  # near copies around one base, more than a short list takes
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = word()
        rows.append((100 + n, " ".join(copy)))
    for n in range(30):  # a passage that documents share without being alike
        rows.append((200 + n, " ".join([word() for _ in range(30)] + base[:15] + [word() for _ in range(20)])))
    rows.append((300, " ".join(word() for _ in range(5000))))
    rows.append((301, rows[-1][1].upper() + " more"))
    for width, percent in ((4, 85), (5, 80)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows), width=width, percent=percent, frequent_from=8).collect()}
        assert found == brute_components(rows, width, percent)


def scattered(rng):
    """Copies of two bases that are themselves alike in part, edited so far that many are alike to some copies only."""
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    bases = [[word() for _ in range(50)]]
    bases.append([x if rng.random() < 0.85 else word() for x in bases[0]])
    rows = []
    for n in range(70):
        copy = list(bases[n % 2])
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            copy[rng.randrange(len(copy))] = word()
        rows.append((n, " ".join(copy)))
    rows += [(100, "a")] + [(101 + n, f"a x{n}") for n in range(40)] + [(200 + n, f"a b c{n % 7} d{n}") for n in range(30)]
    return rows


@pytest.mark.parametrize(("percent", "width", "tile", "nearest"), [(30, 2, 7, (1, None)), (50, 1, 4096, (4, 64, None)), (85, 2, 7, (1, 2, None)), (100, 2, 4096, (4, None))])
def test_jaccard_at_any_threshold(spark, monkeypatch, percent, width, tile, nearest):
    monkeypatch.setattr(jaccard_join, "TILE", tile)  # small: several tiles around a hub
    monkeypatch.setattr(jaccard_join, "OUTLINE", 16)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4)
    monkeypatch.setattr(jaccard_join, "NEAREST", nearest)
    rows = scattered(random.Random(percent))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows), width=width, percent=percent, frequent_from=8).collect()}
    assert found == brute_components(rows, width, percent)


def test_long_sets_are_sketched_before_they_are_compared(spark, monkeypatch):
    """Long texts around a hub, of which outlines of 256 bytes rule nothing out."""
    shared = [f"s{k}" for k in range(2000)]
    rows = [(d, " ".join([*shared, *(f"w{d}-{k}" for k in range(4000))])) for d in range(60)]
    rows += [(100, rows[7][1] + " more"), (101, rows[7][1] + " and more")]
    seen, real = [], jaccard_join._verify

    def verify(pairs, *more):
        seen.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(jaccard_join, "_verify", verify)
    found = jaccard_components(table(spark, rows), width=5, percent=80).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: 7 if d in (7, 100, 101) else d for d, _ in rows}
    assert sum(seen) <= 6  # of 1,891 pairs; 16 a row and more in later rounds were compared as whole sets before


def test_jaccard_odd_rows(spark):
    found = jaccard_components(table(spark, [(1, "a b c"), (1, "a b c"), (2, "A B C"), (None, "a b c"), (3, None)]), width=4, percent=85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert jaccard_components(table(spark, []), width=4, percent=85).count() == 0
    found = jaccard_components(table(spark, [(1, "a b c d e"), (2, "A b c d e"), (2, "v w x y z"), (2, "p q r s t"), (None, "a b c d e")]), width=1, percent=80, row_keys=True).collect()
    assert len({r.component for r in found if r.doc_id is not None}) == 3 and [r.component for r in found if r.doc_id is None] == [None]
    with pytest.raises(ValueError):
        jaccard_components(table(spark, []), percent=0)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for n, m, shared in ((10, 12, 5), (500, 480, 450), (3000, 40, 30)):
        common = rng.integers(0, 2**63, shared, dtype=np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, k - shared, dtype=np.uint64)]) for k in (n, m))
        assert differing(sketch(a), sketch(b)) <= len(np.setxor1d(a, b))
    assert len(shingle_set(np.zeros(0, np.uint64), 4)) == 0


def test_lines(spark):
    rows = [(n, f"first words of {'abcdefghijkl'[n]} unique text {'xyz'[n % 3]}\nPosted by user {n} at 10:{n}\n\nlast {'abcdefghijkl'[n]} line") for n in range(12)]
    rows += [(50 + n, "same one\nsame two\nsame three") for n in range(20)]  # copies share their surroundings
    rows += [(90, None), (91, ""), (None, "Posted by user 77 at 11:00"), (92, "Posted by user 99 at 9:9")]
    found = {r.doc_id: r for r in line_dedup(table(spark, rows), min_documents=10).collect()}
    assert all(found[n].n_dropped == 1 and "Posted" not in found[n].kept and found[n].n_lines == 4 for n in range(12))
    assert found[50].n_dropped == 0 and found[50].kept == rows[12][1]
    assert (found[90].n_lines, found[91].kept, found[92].kept, found[None].kept) == (1, "", "", "")
    carried = line_dedup(table(spark, rows), min_documents=10, carry=["keep_id", "text"]).first().carried
    assert carried.keep_id == "x"
    assert line_dedup(table(spark, [])).count() == 0


def test_lines_count_documents(spark):
    word = [f"w{c}{d}" for c in "abcd" for d in "efgh"]
    rows = [(n, f"body {word[n]} own text here\nunsubscribe at any time\nall rights are reserved\nprinted on paper {n}") for n in range(12)]  # a footer of three lines
    rows += [(20 + n, f"\nanother {word[n]} text\n\nread more on page {n}\n\nyet {word[n]} more\n") for n in range(12)]  # blank lines between
    rows += [(40 + n, f"Sent from my own {word[n]} phone") for n in range(12)]  # one line
    rows += [(60 + n, f"copied first line\ncopied line number {n}\ncopied last line") for n in range(20)]  # copies but for numbers
    rows += [(80, "a single copied line")] * 20 + [(81 + n, f"only nine {word[n]}\nrare closing line") for n in range(9)]
    found = {r.doc_id: (r.n_dropped, r.kept) for r in line_dedup(table(spark, rows), min_documents=10).collect()}
    for n in range(12):
        assert found[n] == (3, f"body {word[n]} own text here")
        assert found[20 + n] == (1, f"\nanother {word[n]} text\n\n\nyet {word[n]} more\n")
        assert found[40 + n] == (1, "")
    assert all(found[i] == (0, t) for i, t in rows if i >= 60)


def brute_lines(rows, least):
    """Kept lines by plain Python: templates of documents with ``least`` different sequences go."""

    def path(line):
        words = ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
        return (len(words), tuple(words[:4]), words[-1]) if words else None

    having = {}
    for _, text in rows:
        paths = [p for p in map(path, (text or "").split("\n")) if p]
        for p in paths:
            having.setdefault(p, set()).add(text if len(paths) == 1 else tuple(paths))
    gone = {p for p, documents in having.items() if len(documents) >= least}
    return sorted((i or 0, len(lines := (t or "").split("\n")), sum(path(x) in gone for x in lines), "\n".join(x for x in lines if path(x) not in gone)) for i, t in rows)


def test_lines_against_plain_python(spark):
    rng = random.Random(9)
    stock = [f"{a} {b} line {rng.choice(['of', 'with', '7'])} text" for a in "abcdefgh" for b in "xyz"] + ["", " \t", "alone", "page 5"]
    rows = [(rng.choice([n, n, n, n, None]), "\n".join(rng.choice(stock) for _ in range(rng.choice([1, 1, 3, 8])))) for n in range(150)]
    rows += rows[:20] + [(3, None), (4, ""), (3, "alone\nother"), (900, "\n".join(f"w{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)} own" for n in range(15_000)) + "\nalone")]
    found = line_dedup(table(spark, rows), min_documents=10)
    assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept) for r in found.collect()) == brute_lines(rows, 10)


def brute_windows(rows, width):
    words = {i: split_words(t, lower=False) for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), " ".join(x.decode() for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("strings", "hot"), [(30_000, 100_000), (3, 100_000), (30_000, 12)])
def test_windows(spark, monkeypatch, strings, hot):
    monkeypatch.setattr(window_dedup, "STRINGS", strings)  # small: a bucket outgrows its task
    monkeypatch.setattr(window_dedup, "HOT_FROM", hot)  # small: some minimisers are hot
    used, windows = [], window_dedup._hot_windows
    monkeypatch.setattr(window_dedup, "_hot_windows", lambda *a: used.append(1) or windows(*a))
    rng = random.Random(2)
    passages = [" ".join(rng.choice("abcdé") for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a " * 200)]
    rows += [(10 + n, "  ".join(rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 6)))) for n in range(60)]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in window_dedup.window_dedup(table(spark, rows).coalesce(1), width=13).collect()}
    assert found == brute_windows(rows, 13) and bool(used) == (hot < 100)
    long = " ".join(rng.choice("abcdefgh") for _ in range(60_000))
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in window_dedup.window_dedup(table(spark, [(1, long), (2, "z " + long[:9000])]), width=13).collect()}
    assert found == brute_windows([(1, long), (2, "z " + long[:9000])], 13)
    odd = window_dedup.window_dedup(table(spark, [(7, passages[0] * 3), (7, passages[0] * 3), (None, passages[0] * 3)])).collect()
    assert [r.n_removed for r in odd] == [0, 0, 0] and window_dedup.window_dedup(table(spark, [])).count() == 0


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for k in range(len(r) - length + 1):
            seen[r[k : k + length]] = seen.get(r[k : k + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("size", [300_000, 500])
def test_bytes(spark, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", size)  # small: buckets are dealt anew
    rng = random.Random(4)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 300))) for _ in range(5)]
    texts = [None, "", "ab" * 500, "x" * 39]
    texts += ["".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(table(spark, list(enumerate(texts))), length=40).collect()}
    assert [found[i] for i in range(len(texts))] == brute_bytes(texts, 40)
    odd = suffix_dedup.suffix_dedup(table(spark, [(7, "é" * 30 + "z"), (7, "é" * 30 + "z"), (None, "q" * 20)]), length=40).collect()
    assert sorted(r.n_removed for r in odd) == [0, 61, 61]
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(table(spark, []), length=8)


@pytest.mark.parametrize("deals", [0, 2])
def test_bytes_of_a_bucket_over_a_task(spark, monkeypatch, deals):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "DEALS", deals)
    named, by_name = [], suffix_dedup._by_name
    monkeypatch.setattr(suffix_dedup, "_by_name", lambda *a: named.append(1) or by_name(*a))
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = own(70)
    texts = [own(60) + shared + own(60) for _ in range(60)] + ["ab" * 300, "é" * 40, None, own(500)] + [own(30) + shared] * 3
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(table(spark, list(enumerate(texts))), length=40).collect()}
    assert [found[i] for i in range(len(texts))] == brute_bytes(texts, 40) and named
    odd = suffix_dedup.suffix_dedup(table(spark, [(None, shared)] * 40), length=40).collect()
    assert [r.n_removed for r in odd] == [70] * 40


def test_bytes_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", 100)  # small: texts are cut into many pieces
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcdefghé ") for _ in range(n)) for n in (45, 130, 410)]
    texts = ["".join(rng.choice("ijklmn ") for _ in range(rng.randrange(250))) + s + "".join(rng.choice("ijklmn ") for _ in range(rng.randrange(99))) for s in shared for _ in range(4)]
    texts += ["é" * 300, shared[2] + shared[0], "x" * 5000]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(table(spark, list(enumerate(texts))), length=40).collect()}
    assert [found[i] for i in range(len(texts))] == brute_bytes(texts, 40)
    assert suffix_dedup.suffix_dedup(table(spark, []), length=40).count() == 0


def test_bytes_of_the_query(spark):
    """The whole table of the query against every 400-byte string."""
    from quillmark.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix_dedup"](spark, folder).collect()}
    wanted = {r.doc_id: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for r, x in zip(rows, brute_bytes([r.text for r in rows], 400), strict=True)}
    assert found == wanted and any(x[1] for x in wanted.values())


def test_strings_are_compared_by_their_bytes(monkeypatch):
    """With symbols that are all alike only the bytes can tell."""
    monkeypatch.setattr(suffix_dedup, "symbols_at", lambda words, length: (np.zeros(len(words), np.uint64), 8))
    monkeypatch.setattr(suffix_dedup, "words_at", lambda data: np.zeros(len(data), np.uint64))
    data = np.frombuffer(b"abcdefgh" * 3 + b"x" * 40 + bytes(range(100)), np.uint8)
    starts = np.arange(len(data) - 15)
    strings = [data[s : s + 16].tobytes() for s in starts]
    assert suffix_dedup.repeated_starts(data, starts, 16).tolist() == [strings.count(s) > 1 for s in strings]


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(150):
        length, letters = rng.choice([32, 37, 40, 100, 400]), rng.choice([1, 2, 4, 20])
        parts = [bytes(rng.randrange(letters) for _ in range(rng.randint(1, 300))) for _ in range(rng.randint(1, 4))]
        data = np.frombuffer(b"".join(rng.choice(parts) for _ in range(rng.randint(1, 12))), np.uint8)
        starts = np.arange(max(len(data) - length + 1, 0))
        strings = [data[s : s + length].tobytes() for s in starts]
        assert suffix_dedup.repeated_starts(data, starts, length).tolist() == [strings.count(s) > 1 for s in strings]
