import hashlib
import re
import time

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from quillmark.llm import shared
from quillmark.llm.byte_bpe import read_ranks
from quillmark.llm.catalog import QUERIES
from tests.llm.test_dedup import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


ODD = [(10_001, None, "en", "src0", 0), (10_002, "", None, None, None), (10_003, "12 34", "en", "src1", 5), (None, "of the and no id here at all", "en", "src2", 3), (None, "of the and no id here at all", "en", "src2", 3)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, kept = docs.select(*cp.COLUMNS).union(spark.createDataFrame(ODD, docs.schema).select(*cp.COLUMNS)), {}
    for name, stage in cp.STAGES:
        out = stage(spark, at, SF)
        at = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = at.collect()
        if name != "byte_bpe":
            assert at.columns == cp.COLUMNS
    # nothing but texts without a known language go at first, and rows without an id stay
    assert plain(kept["language_id"]) == plain([*docs.select(*cp.COLUMNS).collect(), *ODD[3:]])
    texts = [r.text for r in kept["language_id"]]
    lines = [x[3] for x in brute_lines(list(enumerate(texts)), 10)]  # in the order of the rows
    assert sorted((r.doc_id or 0, r.text) for r in kept["line_templates"]) == sorted((r.doc_id or 0, x) for r, x in zip(kept["language_id"], lines, strict=True) if x.split() or x == r.text)
    rows = [(r.doc_id, r.text) for r in kept["line_templates"] if r.doc_id is not None]
    wanted = {i for i, (_, component) in brute_components(rows, 5, 80).items() if component == i}
    found = [r.doc_id for r in kept["jaccard_join"]]
    assert sorted(i for i in found if i is not None) == sorted(wanted) and len(wanted) < len(rows) and found.count(None) == 2
    assert plain(kept["mixing"]) == plain(brute_mix(kept["jaccard_join"]))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    wanted = sorted((len(ids := library.encode_ordinary(r.text)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in kept["mixing"])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept["byte_bpe"]) == wanted


def brute_mix(rows):
    """What the mixing stage keeps, in plain Python: budgets down the tree, then each leaf's documents by draw."""
    from tests.llm.test_models import fill

    def leaf(r):
        number = re.search("[0-9]+", r.source or "")
        return f"d{int(number[0]) % 4 if number else 0}", r.lang or "(none)", r.source or "(none)"

    count, tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows], {}
    for r, n in zip(rows, count, strict=True):
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + n
    given = {(): sum(count) * 80 // 100}
    for depth, level in enumerate(cp.MIX_LEVELS):
        weights, below = cp.MIX_WEIGHTS.get(level, {}), {}
        for path, budget in given.items():
            rooms = {}
            for x, n in tokens.items():
                if x[:depth] == path and n:
                    rooms[x[depth]] = rooms.get(x[depth], 0) + n
            below |= {(*path, k): v for k, v in fill(budget, rooms, {k: weights.get(k, 1) for k in rooms}).items()}
        given = below
    kept = []
    for x, n in tokens.items():
        budget = given.get(x, 0)
        mine = [(r, k) for r, k in zip(rows, count, strict=True) if leaf(r) == x and k]
        epoch = budget // n if n else 0
        at = 0
        for r, k in sorted(mine, key=lambda m: (hashlib.md5(f"17-{epoch}-{'' if m[0].doc_id is None else m[0].doc_id}".encode()).hexdigest(), m[1])):
            if epoch or at < budget % n:
                kept.append(r)
            at += k
    return kept


def test_rows_with_one_id_have_their_own_fate(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, near, "en", "src0", 1), (2, near + " more", "en", "src0", 2), (2, "quite another text that nobody else has written", "en", "src1", 3), (2, "quite another text that nobody else has written", "en", "src1", 3), (None, near, "en", "src2", 4), (None, near, "en", "src2", 4), (3, None, "en", None, 0), (4, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_copies(spark, docs, SF).collect()
    assert plain(kept) == plain([rows[0], rows[2], *rows[4:]])
    mixed = cp.mix_sources(spark, docs.select("n_chars", *docs.columns[:-1]), SF).collect()
    assert plain(mixed) == plain(brute_mix(docs.collect())) and any(r.doc_id is None for r in mixed)
    lines = cp.drop_template_lines(spark, docs, SF).collect()
    assert plain(lines) == plain(rows)


def test_stages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_rejected_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = docs.select(*cp.COLUMNS).union(docs.limit(1).select(F.lit(9999).cast("long"), F.lit("13 !!"), "lang", "source", "n_chars"))
    assert cp.identify_language(spark, mixed, SF).where("doc_id = 9999").count() == 0


def test_scopes_delete_their_own_tables(spark):
    from quillmark.llm import shared

    outer = shared.stored(spark.range(3), "outer")
    with shared.scope(spark):
        inner = shared.stored(spark.range(4), "inner")
        kept = shared.keep(shared.stored(inner, "kept"))
        with shared.scope(spark):
            shared.stored(inner, "deep")
    there = {p.rsplit("/", 1)[1].split("-")[1] for p in shared._written}
    assert {"outer", "kept"} <= there and not {"inner", "deep"} & there
    assert kept.count() == 4 and outer.count() == 3
    shared.discard(kept)
    shared.discard(outer)


def test_a_run_leaves_one_table_behind(spark):
    from quillmark.llm import shared

    before = set(shared._written)
    assert cp.run(spark, SF).count() > 0
    left = {p.rsplit("/", 1)[1].split("-")[1] for p in shared._written - before}
    assert "mixing" in left and not left & {"language_id", "line_templates", "jaccard_join"}


def test_stored_tables_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(shared.CLEANUP, None)
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    sums = rows.repartition(5, "id").groupBy("k").agg(F.sum("id").alias("s"))
    table = shared.stored(sums, "sums")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(shared.CLEANUP, None) == setting
    # the frame itself can still be read, and again
    assert sorted(table.collect()) == sorted(sums.collect()) == sorted(sums.collect())
    shared.discard(table)


def test_texts_are_shuffled_once_and_only_where_they_may_go(spark, monkeypatch):
    carried = []
    dedup = cp.line_dedup
    monkeypatch.setattr(cp, "line_dedup", lambda *a, **k: carried.extend(k["carry"]) or dedup(*a, **k))
    docs = spark.createDataFrame([(i, f"text of {i} " + " ".join(f"{i}w{j}" for j in range(40)), "en", "src0", 5) for i in range(400)] + [(1000, "text of 7 " + " ".join(f"7w{j}" for j in range(40)), "en", "src0", 5), (1001, None, "en", "src0", 0), (1002, "", "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert plain(cp.drop_template_lines(spark, docs, SF).where("doc_id > 1000").collect()) == plain(docs.where("doc_id > 1000").collect())
    assert "text" not in carried
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cp.drop_near_copies(spark, docs, SF)
        kept = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plain(kept) == plain([r for r in docs.collect() if r.doc_id != 1000])
    assert "getbit" in plan.split("LeftAnti", 1)[1]  # rows that are certainly kept do not meet the join


def test_maybe_is_true_for_every_key(spark):
    from quillmark.llm.exact_dedup import with_maybe

    rows = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.lit("x").alias("other"))
    keys = rows.where("a % 50 = 3").select("a", "b")
    found = with_maybe(rows, keys, ["a", "b"])
    assert found.columns == ["a", "b", "other", "maybe"]
    assert found.where("maybe").join(keys, ["a", "b"]).count() == 400 and found.count() == 20_000
    assert found.where("maybe").count() < 1_500
    assert with_maybe(rows, keys.limit(0), ["a", "b"]).where("maybe").count() == 0
    # a filter too small for its keys lets more rows pass, and no key is lost
    small = with_maybe(rows, rows.select("a", "b"), ["a", "b"], max_filter_bits=1)
    assert small.where("maybe").count() == 20_000


def test_batches_of_long_texts_are_bounded(spark):
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 4_000, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 1_000)).alias("text"))  # 20 MB

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.createDataFrame([(1, "of the and to in", "en", "src0", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for name, stage in cp.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, SF)  # by itself, on a session that was made elsewhere
            found = texts.mapInArrow(sizes, "n long, size long").agg(F.sum("n"), F.max("size")).first()
            assert found[0] == 4_000 and found[1] < 5_000_000, name
    finally:
        spark.conf.set(key, before)


def peak_of(make):
    """Most bytes of Python objects and arrays while ``make`` runs, and what it gives."""
    import tracemalloc

    tracemalloc.start()
    try:
        out = make()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_tokens_are_counted_where_they_are():
    from quillmark.llm.jaccard_join import at_least

    rng = np.random.default_rng(5)
    for size, values in ((0, 1), (7, 1), (8, 1), (9, 2), (5_000, 300), (5_000, 2_000)):
        tokens = rng.integers(0, values, size).astype(np.uint64) << np.uint64(54)
        wanted, n = np.unique(tokens, return_counts=True)
        found, often = at_least(tokens, 8)
        assert found.tolist() == wanted[n >= 8].tolist() and often.tolist() == n[n >= 8].tolist()
    for values in (2**60, 40_000):  # nearly all once, and nearly all often
        tokens = rng.integers(0, values, 1_000_000).astype(np.uint64)
        peak, _ = peak_of(lambda tokens=tokens: at_least(tokens, 8))
        assert peak < tokens.nbytes / 2  # np.unique: 33 and 10 MB of 8


def test_tasks_hold_little(spark):
    """What leaves Python tasks is cut into small batches, and short texts are not all counted together."""
    from types import SimpleNamespace

    import pyarrow as pa

    from quillmark.llm.byte_bpe import OUT_BYTES, encode_documents
    from quillmark.llm.catalog import PATTERN, RANKS
    from quillmark.llm.jaccard_join import INDEXED, _postings
    from quillmark.llm.language_id import score_texts

    seen = []

    class Docs:  # hands the function of the tasks over
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: seen.append(run)

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["of", "the", "and", "to", "in"], 300)) for _ in range(4_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4_000)), "text": texts})
    encode_documents(Docs(), RANKS, PATTERN, with_ids=True)
    out = list(seen[-1](iter([batch])))
    assert max(x.nbytes for x in out) < 2 * OUT_BYTES and len(out) > 3
    whole = pa.Table.from_batches(out)
    assert whole["doc_id"].to_pylist() == list(range(4_000)) and whole["decoded"].to_pylist() == [x.encode() for x in texts]
    texts = [" ".join(map(str, rng.permutation(170))) for _ in range(1_500)]
    from quillmark.llm.jaccard_join import shingle_set
    from quillmark.llm.words import Hasher, word_hashes

    hasher = Hasher()
    frequent = np.unique(np.concatenate([shingle_set(word_hashes(x, hasher), 2) for x in texts]))
    _postings(Docs(), 2, 80, SimpleNamespace(value=(frequent, np.ones(len(frequent), np.int8))))
    out = list(seen[-1](iter([pa.RecordBatch.from_pydict({"doc_id": list(range(1_500)), "text": texts})])))
    assert max(x.num_rows for x in out) < 2 * INDEXED and sum(x.num_rows for x in out) > 3 * INDEXED
    letters, model = np.arange(0x110000, dtype=np.uint32), (["a", "b"], [np.zeros(2**10, np.uint8)], [0.1, 0.1], 2)
    peak, _ = peak_of(lambda: score_texts(["of the and to in " * 60] * 500, model, letters))
    assert peak < 20_000_000  # 500,000 characters at once: 29 MB
