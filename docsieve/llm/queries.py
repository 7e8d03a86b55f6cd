"""The driver's queries over the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import alignment, class_lm, decontaminate, kd_search, lang_id, line_dedup, near_dedup, packing, prefix_trie, quality, sharding, surrogates, token_count
from docsieve.llm.common import crc_mod, table

#: The key of the surrogates in op8. A real run takes its own from a secret store.
DEMO_KEY = "demo-key"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = lang_id.fit_on(docs.filter(~held_out))
    return lang_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = surrogates.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    return done.select("doc_id", F.col("_entities").alias("n_entities"), F.col("_types").alias("types"), "text")


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_class_lm, op3_decontaminate, op4_quality_rules, op5_packing, op6_token_counts, op7_language, op8_surrogates, op9_line_spread, op10_sharding, op11_top_k, op12_alignment, op13_prefix_trie)
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c ON c.doc_id = s.doc_id
""",
    "op3_decontaminate": rf"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, i, d.k, item_id FROM doc_windows d JOIN item_windows USING (k, g)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places p USING (doc_id) LEFT JOIN items i USING (doc_id)
""",
    "op9_line_spread": f"""
WITH lines AS (
  SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), placed AS (
  SELECT doc_id, source, line, lag(line) OVER w AS above, lead(line) OVER w AS below FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), boilerplate AS (
  SELECT line, min(doc_id) AS holder FROM placed WHERE length(line) >= {line_dedup.MIN_CHARS}
  GROUP BY line HAVING CASE WHEN length(line) - length(replace(line, ' ', '')) >= {line_dedup.LONG_SPACES}
    THEN count(DISTINCT row(above, below)) >= {line_dedup.SURROUNDINGS} ELSE count(DISTINCT coalesce(source, '')) >= {line_dedup.SITES} END
), marked AS (
  SELECT doc_id, pos, l.line, b.line IS NOT NULL AND b.holder <> doc_id AS gone FROM lines l LEFT JOIN boilerplate b ON b.line = l.line
), left_over AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM marked GROUP BY 1
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(removed, 0)::BIGINT AS n_removed, length(t)::BIGINT AS n_chars, sha256(t) AS text_sha256
FROM documents d LEFT JOIN left_over USING (doc_id)
""",
    "op11_top_k": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, conv_id::VARCHAR AS id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT *, xor(list_reduce([4294967295] || range(8 * len(id)), lambda c, i: CASE
    WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ascii(id[i // 8 + 1])::BIGINT) ELSE c END) & 1 = 1
    THEN xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(id[i // 8 + 1])::BIGINT) ELSE c END) >> 1, 3988292384)
    ELSE (CASE WHEN i % 8 = 0 THEN xor(c, ascii(id[i // 8 + 1])::BIGINT) ELSE c END) >> 1 END), 4294967295) % 4 AS h FROM own
), seq AS (
  SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS s FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, s[1:d] AS p, s[d].t AS t, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)
), nodes AS (
  SELECT d, p, min(conv_id) AS c, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(t), ''), '[^\x20\x09-\x0D]+')) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY d, p
), families AS (
  SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), counted AS (
  SELECT x.*, coalesce(f.n, 0) AS kids FROM nodes x LEFT JOIN families f USING (d, p)
), sums AS (
  SELECT a AS d, p[1:a] AS p, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY 1, 2
)
SELECT x.c AS conv_id, x.d AS depth, y.c AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM counted x JOIN sums s ON s.d = x.d AND s.p = x.p LEFT JOIN nodes y ON y.d = x.d - 1 AND y.p = x.p[1:x.d - 1]
""",
}
