"""The queries of these operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytecnn, interaction, licences, linecrf
from .bagminhash import near_duplicates
from .common import table
from .infill import fill_in_middle, restored
from .layout import extract
from .merkle import audit
from .packing import pack
from .snapshots import collapse
from .tokencount import count_tokens
from .topk import top_k
from .winnow import contamination


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, held against a replica of them that is damaged here and there."""
    pages = table(spark, sf_dir, "pages").select(
        F.format_string("warc-%06d", F.floor(F.col("page_id") / 4096)).alias("file"), F.col("page_id").alias("place"), "url", "html"
    )
    mark = F.conv(F.substring(F.md5(F.col("place").cast("string")), 1, 4), 16, 10).cast("int") % 101
    turned = F.when(mark == 11, F.concat(F.col("html"), F.lit("."))).otherwise(F.col("html"))
    lost = pages.withColumn("html", turned).where(F.coalesce(mark != 7, F.lit(True)))
    replica = lost.unionByName(lost.where(mark == 13).withColumn("url", F.concat("url", F.lit("#"))))
    found = audit(pages, replica, "file", "place", ["url", "html"])
    return found.select(F.col("file").alias("warc_file"), F.col("offset").alias("page_id"), "leaf", "kind", "n_primary", "n_replica", "primary_sha256", "replica_sha256")


OP1_SQL = """
WITH base AS (
  SELECT 'warc-' || lpad(CAST(page_id // 4096 AS VARCHAR), 6, '0') AS file, page_id, url, html,
    CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS INTEGER) % 101 AS mark FROM pages
), lost AS (
  SELECT file, page_id, url, CASE WHEN mark = 11 THEN html || '.' ELSE html END AS html, mark FROM base WHERE mark <> 7
), every AS (
  SELECT 'p' AS side, file, page_id, url, html FROM base
  UNION ALL SELECT 'r', file, page_id, url, html FROM lost
  UNION ALL SELECT 'r', file, page_id, url || '#', html FROM lost WHERE mark = 13
), hashed AS (
  SELECT side, file, page_id, sha256(strlen(file) || ':' || file || '|' || strlen(CAST(page_id AS VARCHAR)) || ':' || page_id || '|'
    || coalesce(strlen(url) || ':' || url, '-') || '|' || coalesce(strlen(html) || ':' || html, '-')) AS h FROM every
), uneven AS (
  SELECT file, page_id, h, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM hashed GROUP BY ALL
), spot AS (
  SELECT file, page_id, CAST(sum(p) AS BIGINT) AS n_primary, CAST(sum(r) AS BIGINT) AS n_replica,
    min(h) FILTER (p > r) AS primary_sha256, min(h) FILTER (r > p) AS replica_sha256 FROM uneven GROUP BY ALL HAVING bool_or(p <> r)
)
SELECT file AS warc_file, page_id, page_id // 64 AS leaf, CASE WHEN primary_sha256 IS NULL THEN 'extra' WHEN replica_sha256 IS NULL
  THEN 'missing' ELSE 'changed' END AS kind, n_primary, n_replica, primary_sha256, replica_sha256 FROM spot
"""


def op2_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "rendered")


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE said AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), bag AS (
  SELECT r, s, count(*) AS c FROM (
    SELECT r, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM said WHERE len(w) > 0)
  ) GROUP BY r, s
), total AS (SELECT r, sum(c) AS t FROM bag GROUP BY r),
shared AS (
  SELECT x.r AS a, y.r AS b, sum(least(x.c, y.c)) AS n FROM bag x JOIN bag y USING (s) WHERE x.r < y.r GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN total ta ON ta.r = a JOIN total tb ON tb.r = b WHERE n >= 0.8 * (ta.t + tb.t - n)
  UNION ALL
  SELECT x.r, y.r FROM said x JOIN said y ON x.text = y.text AND x.r < y.r WHERE len(x.w) = 0
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT r AS a, r AS b FROM said UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a
), roots AS (SELECT a AS r, min(b) AS root FROM reach GROUP BY a),
classes AS (SELECT root, min(doc_id) AS class_id, count(*) AS class_size FROM roots JOIN said USING (r) GROUP BY root)
SELECT doc_id, class_id, class_size FROM said JOIN roots USING (r) JOIN classes USING (root)
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    found = bytecnn.identify(docs, bytecnn.trained(docs, rest != 2))
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


OP6_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 20
"""


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = """
WITH said AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), spots AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS said
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM said, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT r, item_id, spots.n, i FROM spots JOIN windows USING (n, said)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM said LEFT JOIN places USING (r) LEFT JOIN names USING (r)
"""


def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH turns AS (
  SELECT *, coalesce(turn // 512, -1099511627776) AS block,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY nth) AS l FROM turns GROUP BY conv_id
), same AS (SELECT min(conv_id) AS conv_id, n, l, count(*) AS n_copies FROM whole GROUP BY n, l),
kept AS (
  SELECT conv_id, n AS n_turns, n_copies FROM same a
  WHERE NOT EXISTS (SELECT 1 FROM same b WHERE b.n > a.n AND b.l[1:a.n] = a.l)
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS INTEGER) AS part, n_turns, n_copies,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY nth) AS rendered
FROM turns JOIN kept USING (conv_id) GROUP BY conv_id, block, n_turns, n_copies
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    found = linecrf.score_quality(docs, linecrf.trained(docs, table(spark, sf_dir, "labels"), rest != 1))
    return found.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x, 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = """
WITH said AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t FROM documents
), drawn AS (
  SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM said
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(t[greatest(a, b) + 1:n], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.interactions(interaction.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = """
WITH said AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), least AS (SELECT text, min(doc_id) AS first FROM said GROUP BY text),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f
  FROM said JOIN least USING (text) LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END,
    CASE WHEN f.E THEN 'E' ELSE '' END) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
told AS (
  SELECT part, filter_order, step, filter_order[step] AS l, n, good, toxic, fails, contains(fails, filter_order[step]) AS failing,
    len(list_filter(range(1, step), lambda k: contains(fails, filter_order[k]))) > 0 AS gone FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, l, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (fails = l), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, l
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM summed
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("notices", lambda x: x["phrase"].isin(*licences.BASE))["word"]
    return licences.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_merkle_audit,
            op2_layout_text,
            op3_bagminhash,
            op4_best_fit_packing,
            op5_byte_cnn,
            op6_norm_sorted_top_k,
            op7_winnowing,
            op8_snapshot_collapse,
            op9_token_counts,
            op10_line_crf,
            op11_fill_in_middle,
            op12_filter_interactions,
            op13_license_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_audit": OP1_SQL,
        "op3_bagminhash": OP3_SQL,
        "op6_norm_sorted_top_k": OP6_SQL,
        "op7_winnowing": OP7_SQL,
        "op8_snapshot_collapse": OP8_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_filter_interactions": OP12_SQL,
    }
