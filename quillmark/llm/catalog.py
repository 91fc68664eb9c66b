"""Queries of the training-data operators over the shared tables, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_search import nearest
from .byte_bpe import encode_documents
from .centroids import cluster_vectors
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .language_id import identify
from .line_templates import line_dedup
from .mixing import mix
from .quality_rules import quality_rules
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup
from .token_counts import recount, redactions, token_trees
from .window_dedup import window_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_table(spark, sf_dir, "documents"), depth=4, min_documents=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_domain(_table(spark, sf_dir, "documents")), MIX_LEVELS, MIX_WEIGHTS, budget_percent=50, max_epochs=4, seed=17)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Target weights of the mixing query; a source's domain is the remainder of its number by four.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.expr("try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)', 1), '') as bigint) % 4")
    return docs.withColumn("domain", F.concat(F.lit("d"), F.coalesce(number, F.lit(0)).cast("string")))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, and again after redaction edits."""
    trees = redactions(token_trees(_table(spark, sf_dir, "documents"), RANKS, PATTERN))
    after = recount(trees, RANKS, PATTERN)
    return after.select("doc_id", "n_before", F.get("tree", F.lit(1)).alias("n_after"), "n_edits", "n_encoded", F.size("leaf_chars").cast("long").alias("n_leaves"), F.sha2("text", 256).alias("edited_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_dedup(_table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(_table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, dim=64, scale=1024, seed=3)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), min_letters=7, min_count=2, ratio=10, noise=31)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_templates": op3_line_templates,
    "op4_mixing": op4_mixing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_window_dedup": op6_window_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ann_search": op8_ann_search,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language_id": op10_language_id,
    "op11_centroids": op11_centroids,
    "op12_spelling": op12_spelling,
    "op13_quality_rules": op13_quality_rules,
}


def _level_sql(path: list[str], level: str, weight: str) -> str:
    """SQL of one level of the budget tree: from node budgets n_<parent> to n_<level>."""
    parent, own = ", ".join(path) or "1", ", ".join([*path, level])
    source = f"n_{path[-1]}" if path else "n_root"
    on = f"USING ({', '.join(path)})" if path else "ON true"
    group = f"PARTITION BY {parent}" if path else ""
    return f"""
r_{level} AS (SELECT {own}, sum(tokens * 4)::BIGINT AS room, {weight} AS weight FROM leaves GROUP BY {own} HAVING sum(tokens) > 0),
o_{level} AS (
  SELECT r.*, p.given,
    p.given - coalesce(sum(room) OVER ({group} ORDER BY room / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(weight) OVER ({group} ORDER BY room / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM r_{level} r JOIN {source} p {on}),
f_{level} AS (SELECT *, room::HUGEINT * open <= weight::HUGEINT * greatest(left_over, 0) AS is_full FROM o_{level}),
s_{level} AS (
  SELECT *, given - coalesce(sum(room) FILTER (is_full) OVER ({group}), 0) AS rest, sum(weight) FILTER (NOT is_full) OVER ({group}) AS sharing
  FROM f_{level}),
n_{level} AS (SELECT {own}, CASE WHEN is_full THEN room ELSE (weight::HUGEINT * rest) // sharing END AS given FROM s_{level})"""


MIX_SQL = (
    r"""
WITH t AS (
  SELECT doc_id, 'd' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)', 1), '') AS BIGINT) % 4, 0) AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
n_root AS (SELECT (sum(tokens) * 50 // 100)::BIGINT AS given FROM leaves),"""
    + ",".join(
        [
            _level_sql([], "domain", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END"),
            _level_sql(["domain"], "lang", "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"),
            _level_sql(["domain", "lang"], "source", "1"),
        ]
    )
    + """,
p AS (SELECT domain, lang, source, given // tokens AS epochs, given % tokens AS rest FROM leaves JOIN n_source USING (domain, lang, source)),
d AS (
  SELECT t.*, coalesce(epochs, 0) AS epochs, rest, md5('17-' || coalesce(epochs, 0) || '-' || doc_id) AS draw
  FROM t LEFT JOIN p USING (domain, lang, source)),
x AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d),
y AS (SELECT *, coalesce(greatest(least(n_tokens, rest - start), 0), 0)::BIGINT AS extra_tokens FROM x)
SELECT doc_id, domain, lang, source, n_tokens, epochs::BIGINT AS epochs, extra_tokens, (epochs * n_tokens + extra_tokens)::BIGINT AS selected_tokens
FROM y
"""
)

def _lloyd_sql(rounds: int = 10, clusters: int = 8) -> str:
    """SQL of the clustering query, each round in full."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(n: int) -> str:
        return f"""
a{n} AS MATERIALIZED (
  SELECT row_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT v.row_id, c.cluster, {distance}::BIGINT AS d FROM v CROSS JOIN c{n} c) GROUP BY row_id)"""

    def moved(n: int) -> str:
        return f"""
s{n} AS (SELECT cluster, i, sum(q[i])::BIGINT AS total, count(*) AS n FROM a{n - 1} JOIN v USING (row_id) CROSS JOIN range(1, 65) r(i) GROUP BY cluster, i),
m{n} AS (SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS q FROM s{n} GROUP BY cluster),
c{n} AS MATERIALIZED (SELECT c.cluster, coalesce(m{n}.q, c.q) AS q FROM c{n - 1} c LEFT JOIN m{n} USING (cluster))"""

    steps = [assigned(0)] + [x for n in range(1, rounds + 1) for x in (moved(n), assigned(n))]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY draw NULLS LAST, q) - 1 AS cluster, q
  FROM (SELECT sha256('3:' || vec_id) AS draw, q FROM v ORDER BY draw NULLS LAST, q LIMIT {clusters})),{",".join(steps)},
f AS (SELECT v.vec_id, v.q, cluster, distance FROM a{rounds} JOIN v USING (row_id))
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY f.q) AS group_size
FROM f JOIN c{rounds} c USING (cluster)
"""


ORACLES = {
    "op11_centroids": _lloyd_sql(),
    "op12_spelling": r"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id || ':' || run, ''))) AS h FROM r),
s AS (  -- each byte, then eight shifts
  SELECT *, flatten([[('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(0, length(h) // 2)]) AS steps
  FROM b),
k AS (
  SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, steps), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS crc
  FROM s),
w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN doc_id IS NOT NULL AND crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM k)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM w, unnest(range(1, length(word) + 1)) u(i)),
p AS (
  SELECT x.word, y.word AS other, y.n FROM d x JOIN d y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.head || d.tail = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.head || d.tail = w.word),
q AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, min(other) FILTER (n = most) AS best
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS most FROM p) GROUP BY word),
f AS MATERIALIZED (
  SELECT w.word, CASE WHEN best_n >= 10 * w.n THEN best END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM w LEFT JOIN q USING (word)),
t AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n
FROM f JOIN t ON t.word = f.word JOIN f g ON g.word = t.root WHERE g.form IS NULL
""",
    "op3_line_templates": r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
m AS (
  SELECT doc_id, body,
    [regexp_replace(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') FOR x IN ls] AS ns
  FROM l),
p AS (
  SELECT doc_id, body, [CASE WHEN x <> '' THEN len(string_split(x, ' ')) || chr(10) || array_to_string(string_split(x, ' ')[1:4], ' ') || chr(10) || string_split(x, ' ')[-1] END FOR x IN ns] AS ps
  FROM m),
q AS (SELECT doc_id, body, ps, [x FOR x IN ps IF x IS NOT NULL] AS seq FROM p),
u AS (SELECT doc_id, ps, CASE WHEN len(seq) = 1 THEN 't' || body ELSE 's' || array_to_string(seq, chr(1)) END AS document, unnest(range(1, len(ps) + 1)) AS i FROM q),
a AS (SELECT doc_id, i, document, ps[i] AS path FROM u),
c AS (SELECT path FROM (SELECT DISTINCT path, document FROM a WHERE path IS NOT NULL) GROUP BY path HAVING count(*) >= 10),
g AS (SELECT doc_id, list(i) AS gone FROM a WHERE path IN (SELECT path FROM c) GROUP BY doc_id)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
       sha256(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], chr(10))) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id)
""",
    "op4_mixing": MIX_SQL,
    "op6_window_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM v),
d AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM k),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM d WHERE doc_id > least),
g AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
""",
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh
  FROM w),
c AS (SELECT list_sort(sh) AS sh, min(doc_id) AS class_id FROM s WHERE len(sh) > 0 GROUP BY ALL),
e AS (SELECT class_id, len(sh) AS n, unnest(sh) AS g FROM c),
l AS (
  SELECT a.class_id AS x, b.class_id AS y
  FROM e a JOIN e b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (
  SELECT class_id AS x, class_id AS y FROM c
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.class_id, s.doc_id) AS class_id,
       coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN m ON m.x = c.class_id
""",
    "op8_ann_search": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
""",
}
