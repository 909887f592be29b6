"""The operators of this subpackage as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, linededup, mixing, pii, quality, sharding, simhash, substring, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation whose texts hold control strings, beside those of the table.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string"))
    return chat.digest(chat.format_chats(rows))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"), digest=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_groups(_table(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_topk(rows.filter(F.col("vec_id") % 20 == 0), rows)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"), digest=True).drop("intervals")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.plan_copies(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_line_dedup, op3_simhash, op4_pii, op5_topk, op6_sharding, op7_quality, op8_substring, op9_mixing, op10_decontamination)}


ORACLES = {
    "op1_chat": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), r AS (
          SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
            row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
            regexp_replace(text, '(</?s|\[/?ROLE|\[/?INST|\[SEP)(\\*)([>\]])', '\1\\\2\3', 'g') AS told,
            regexp_replace(role, '(</?s|\[/?ROLE|\[/?INST|\[SEP)(\\*)([>\]])', '\1\\\2\3', 'g') AS named
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
          CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(length(told)
            + CASE WHEN i > 1 AND before = role THEN length('[SEP]') ELSE length('<s>[ROLE][/ROLE]') + length(named) END
            + CASE WHEN i < n AND after = role THEN 0 ELSE length('</s>') END) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op2_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
          FROM documents
        ), k AS (
          SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM l
        ), c AS (
          SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), j AS (
          SELECT k.*, (c.key IS NOT NULL AND k.doc_id <> c.largest) AS gone FROM k LEFT JOIN c ON k.key = c.key
        )
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op5_topk": r"""
        WITH v AS (
          SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND vec_id IS NOT NULL
        ), s AS (
          SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
          FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op8_substring": r"""
        WITH t AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents
        ), s AS (
          SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20
        ), f AS (
          SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS place FROM s
        ), c AS (
          SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE place > 1
        ), x AS (
          SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t
        ), j AS (
          SELECT x.*, c.p IS NOT NULL AS gone FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p
        ), k AS (
          SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM j GROUP BY doc_id
        )
        SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON t.doc_id = k.doc_id""",
    "op9_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size FROM documents
        ), s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
        ), b AS (
          SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - 3 * coalesce(sum(source_size) OVER p, 0) AS spare,
            sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS behind
          FROM s WINDOW p AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), f AS (
          SELECT arg_max(spare / CAST(behind AS DOUBLE), behind) AS lv FROM b WHERE spare / CAST(behind AS DOUBLE) * w <= 3.0 * source_size
        ), g AS (
          SELECT source, source_size, least(3.0 * CAST(source_size AS DOUBLE), coalesce((SELECT lv FROM f) * w, 0.0::DOUBLE)) AS target FROM s
        ), r AS (
          SELECT d.doc_id, d.size, g.source_size, CAST(g.target AS DOUBLE) AS target,
            CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
            CAST(('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, '')))), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS chance
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        )
        SELECT doc_id, size, source_size, target,
          CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM r""",
    "op10_decontamination": r"""
        WITH b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bi AS (
          SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
        ), bw AS (
          SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi
        ), d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), di AS (
          SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
        ), h AS (
          SELECT doc_id, i, di.n, item_id FROM di JOIN bw ON bw.n = di.n AND bw.win = array_to_string(w[i:i + di.n - 1], ' ')
        ), p AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
        ), m AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""",
}
