import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.llm.centroids import LARGEST, cluster_vectors
from quillmark.llm.quality_rules import BASE, STATISTICS, Condition, best_condition, decision, labelled_statistics, learn, quality_rules, statistics
from quillmark.llm.spelling import count_words, group_spellings, spelling_variants

from ..conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_clusters(rows, clusters, rounds, dim, scale=1024, seed=3):
    """vec_id, cluster, distance, cluster inertia, inertia, digest, group size of each kept row, in plain Python."""
    kept = [(i, [int(x * scale // 1) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and x - x == 0 for x in v)]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [q for _, q in sorted(kept, key=draw)[:clusters]]

    def assign():
        out = []
        for _, q in kept:
            far = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centres]
            out.append((min(far), far.index(min(far))))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(centres)):
            if mine := [q for (_, q), (_, at) in zip(kept, of, strict=True) if at == c]:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of, same = assign(), Counter(tuple(q) for _, q in kept)
    sums = Counter()
    for far, c in of:
        sums[c] += far
    return [(i, c, far, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest(), same[tuple(q)]) for (i, q), (far, c) in zip(kept, of, strict=True)]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("clusters,rounds,hot_parts", [(3, 10, 1000), (5, 2, 4), (100, 3, 1)])
def test_clusters(spark, clusters, rounds, hot_parts):
    rng = random.Random(clusters)
    rows = [(n, [rng.uniform(-2, 2) for _ in range(3)]) for n in range(60)]
    rows += [(n, [0.5, -0.25, 0.1]) for n in range(100, 140)]  # copies
    rows += [(7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (7, [0.0, 0.0, 0.0]), (None, [1.0, -1.0, 0.0]), (None, [1.0, -1.0, 0.0])]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 2.0]), (205, [1.0, float("inf"), 2.0]), (206, [1.0] * 4)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, name string")
    found = cluster_vectors(table, clusters, rounds, dim=3, hot_parts=hot_parts)
    assert as_rows(found) == sorted(brute_clusters(rows, clusters, rounds, 3), key=str)


def test_clusters_at_the_edges(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert cluster_vectors(table([]), dim=2).count() == 0
    assert cluster_vectors(table([(1, None), (2, [1.0])]), dim=2).count() == 0
    one = cluster_vectors(table([(None, [0.5, -0.001])]), dim=2).first()
    assert (one.vec_id, one.cluster, one.distance, one.group_size) == (None, 0, 0, 1) and one.centroid_sha256 == hashlib.sha256(b"512,-2").hexdigest()
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(table([(1, [float(LARGEST), 0.0])]), dim=2).collect()


def brute_words(rows, min_letters=7, noise=31):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            if noise and i is not None and (h := zlib.crc32(f"{i}:{word}".encode())) % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_letters:
                total[word] += 1
    return total


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, ratio=10):
    of = {}
    for w, n in words.items():
        close = [x for x in words if x != w and near(w, x)]
        best = min(((-words[x], x) for x in close), default=None)
        of[w] = (best[1] if best and -best[0] >= ratio * n else None, n, len(close))
    out = set()
    for w, (form, n, n_near) in of.items():
        root = w
        while of[root][0] is not None:
            root = of[root][0]
        out.add((w, form, root, n, n_near, words[form] if form else None))
    return out


def test_counting_words(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcßéÉ×ZQ") for _ in range(rng.randint(1, 12))) + rng.choice([".", "1", "", "ā", "-"]) for _ in range(200)) for _ in range(30)]
    rows = [*enumerate(texts), (None, texts[0]), (5, texts[5]), (40, None), (41, ""), (42, "1234 ,,,"), (43, "x" * 500_000), (44, "zweimal " * 100_000)]
    table = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    for noise in (31, 2, 0):
        for held in (300_000, 3):
            assert {r.word: r.n for r in count_words(table, noise=noise, held=held).collect()} == brute_words(rows, noise=noise)
    assert count_words(table.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [128, 4, 1])
def test_spellings(spark, limit):
    rng = random.Random(limit)
    words = Counter()
    for letters, size, many in (("ab", 8, 120), ("abé", 7, 150), ("xy", 9, 60), ("ÀàQ", 7, 40)):
        for _ in range(many):
            words["".join(rng.choice(letters) for _ in range(rng.randint(size - 1, size + 1)))] = int(2 * 10 ** rng.uniform(0, 5))
    for at in range(40):  # one crowded prefix, and words that differ in one place only
        words["internation" + chr(97 + at % 26) + ("s" if at > 25 else "")] = 2 + at
    words |= {"a" * 3000: 50, "a" * 3001: 700, "a" * 2999 + "b": 4, "": 9}
    table = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()] + [(None, 4, "x", 1), ("null", None, "x", 1)], "word string, n long, form string, m int")
    found = {tuple(r) for r in group_spellings(table, limit=limit).collect()}
    assert found == brute_forms({w: n for w, n in words.items() if w})


def test_spellings_of_texts(spark):
    rows = [(i, "Grammatik " * 30 + "Gramatik Grammatikk Grammatyk Grammatyk gramm4tik " * (i % 3)) for i in range(12)] + [(None, "Gramatik"), (3, None)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")
    found = {tuple(r) for r in spelling_variants(table).collect()}
    assert found == brute_forms({w: n for w, n in brute_words(rows, noise=0).items() if n >= 2})
    assert ("grammatyk", "grammatik", "grammatik", 24, 1, 360) in found
    assert spelling_variants(table.limit(0)).count() == 0


def brute_base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            inside |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics(spark):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice("a b c dd eé 🙂 # x|y".split()) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    texts += [None, "", " \n\t\x0b\x0c\r ", "one", "a b c d e", "a b c d e a b c d e", "w " * 5, "w " * 6, "x y z", "\n\n\n", "a\nb\na\n b\na", "v w x y z " * 100_000 + "end"]
    table = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)] + [(None, "a a", 1, "s"), (3, texts[3], 1, "s")], "doc_id long, text string, n_words int, hashes string")
    found = statistics(table)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert tuple(r[c] for c in BASE) == brute_base(texts[r.doc_id] if r.doc_id is not None else "a a")
        assert all(0 <= r[s] <= 10_000 for s in STATISTICS)


def test_learning_by_brute_force(spark):
    """Each rule's first condition has the largest gain of all thresholds; lists are learned as planted."""
    rng = random.Random(3)
    histogram = [(s, rng.randrange(30), rng.randrange(5), rng.randrange(5)) for s in STATISTICS for _ in range(20)]
    merged = Counter()
    for s, v, b, g in histogram:
        merged[s, v, "b"] += b
        merged[s, v, "g"] += g
    histogram = [(s, v, merged[s, v, "b"], merged[s, v, "g"]) for s, v in {k[:2] for k in merged}]
    gain, found = best_condition(histogram)
    import math

    def worth(s, at_least, t):
        mine = [h for h in histogram if h[0] == s]
        hit = [h for h in mine if (h[1] >= t if at_least else h[1] <= t)]
        bad, good, p, n = sum(h[2] for h in mine), sum(h[3] for h in mine), sum(h[2] for h in hit), sum(h[3] for h in hit)
        return p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good))) if p else 0

    assert gain == pytest.approx(max(worth(s, a, t) for s in STATISTICS for a in (True, False) for t in range(30))) and gain == pytest.approx(worth(found.statistic, found.at_least, found.threshold))
    rows = []
    for n in range(1200):
        row = {s: rng.randrange(1000) for s in STATISTICS}
        bad = row["symbols"] >= 800 or (row["upper"] <= 300 and row["words"] >= 600)
        rows.append((*row.values(), bad, n % 3 == 0))
    table = spark.createDataFrame(rows, ", ".join(f"{s} long" for s in STATISTICS) + ", bad boolean, prunes boolean")
    rules = learn(table)
    assert {tuple(sorted((c.statistic, c.at_least) for c in r)) for r in rules} == {(("symbols", True),), (("upper", False), ("words", True))}
    judged = table.withColumn("rule", decision(rules))
    assert judged.where("bad = (rule IS NULL)").count() <= 12
    for one_class in (table.where("bad"), table.where("NOT bad"), table.limit(0)):
        assert learn(one_class) == []
    assert str(Condition("symbols", True, 5)) == "symbols >= 5"


def test_rules_of_the_query(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = quality_rules(docs, labels.where(~out))
    rows = found.join(labels.where(out).select("doc_id", "quality"), "doc_id").collect()
    right = sum((r.rule is None) == (r.quality == 1) for r in rows)
    assert right / len(rows) >= 0.97  # held out
    assert sum(r.rule is not None for r in rows if r.quality == 1) <= 1  # clean documents are left alone
    for r in found.limit(200).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and r.rule is None)
    nothing = quality_rules(docs.limit(20), labels.limit(0)).collect()
    assert len(nothing) == 20 and all(r.rule is None and r.rules == "" and r.kept == (not r.base_failed) for r in nothing)
    assert quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_labels(spark):
    found = spark.createDataFrame([(1, *[5] * 9), (1, *[5] * 9), (2, *[6] * 9), (None, *[7] * 9)], "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, 1, "x"), (2, None, "x"), (None, 0, "x"), (9, 0, "x")], "doc_id long, quality int, bad string")
    assert sorted((r.words, r.bad) for r in labelled_statistics(found, labels).collect()) == [(5, True), (5, True), (6, False)]
