"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nervemap.runtime import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer lies; the package of that name is looked for under /opt/tokenizers too."""
    import importlib.util

    if (found := importlib.util.find_spec("public_tokenizers")) is not None and found.origin:
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"/opt/tokenizers/{name}"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer(), capacity=4096, end_id=1)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.topk_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=20, scale=64, every=20)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.html_extraction import extract_articles

    return extract_articles(_table(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.preferences import format_preferences, preference_pairs

    made = format_preferences(preference_pairs(_table(spark, sf_dir, "conversations")))
    spans = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",") for c in ("chosen_spans", "rejected_spans")}
    return made.withColumns(spans)


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.language_model import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), folds=7, held_fold=2)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.quality import fit, held_out, with_score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels"), sample=20_000, folds=5, fold=0)
    return with_score(docs, model, threshold=0.3).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.decontamination import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.sharding import shard_rows

    return shard_rows(_table(spark, sf_dir, "documents"), shards=16, seed=0)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.substring_dedup import repeated_spans

    found = repeated_spans(_table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.conversations import audit_damaged

    return audit_damaged(_table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.lexical_search import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nervemap.llm.quality import held_out
    from nervemap.llm.toxicity import fit, with_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels"), sample=60_000, folds=4, fold=2)
    return with_toxicity(docs, model, threshold=0.3).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


_OP8 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bs AS (
  SELECT item, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[s + 1:s + n], ' ') AS run FROM bs
), ds AS (
  SELECT rid, n, w, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
), dw AS (
  SELECT rid, n, s, array_to_string(w[s + 1:s + n], ' ') AS run FROM ds
), hits AS (
  SELECT rid, n, s, run FROM dw SEMI JOIN bw USING (n, run)
), hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rid, item FROM hits JOIN bw USING (n, run)) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


_OP2 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP5 = r"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), t AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS own FROM d
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t
), e AS (
  SELECT conv_id, own, max(i) FILTER (role = 'assistant') AS last, count(*) FILTER (role = 'assistant') AS replies,
         arg_min(coalesce(text, ''), i) FILTER (role = 'assistant') AS first_text, arg_max(text, i) FILTER (role = 'assistant') AS last_text
  FROM n GROUP BY conv_id, own
), m AS (
  SELECT n.conv_id, n.own, n.i, '<|' || replace(coalesce(n.role, ''), '<|', '< |') || '|>' || chr(10) AS head,
         replace(coalesce(n.text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body,
         CASE WHEN e.replies > 1 AND e.first_text IS DISTINCT FROM e.last_text THEN replace(e.first_text, '<|', '< |') ELSE '' END || '<|end|>' || chr(10) AS other,
         (coalesce(n.i = e.last, false) AND (CASE WHEN e.replies > 1 AND e.first_text IS DISTINCT FROM e.last_text THEN e.first_text ELSE '' END) IS DISTINCT FROM n.text) AS differs
  FROM n JOIN e ON n.conv_id IS NOT DISTINCT FROM e.conv_id AND n.own = e.own AND n.i <= coalesce(e.last, n.i)
)
SELECT conv_id, CAST(count(*) FILTER (NOT differs) AS INTEGER) AS n_prompt_turns, coalesce(string_agg(head || body, '' ORDER BY i) FILTER (NOT differs), '') AS prompt,
       coalesce(max(head || body) FILTER (differs), '') AS chosen_completion,
       coalesce(max(length(head) || ':' || length(head || body)) FILTER (differs), '') AS chosen_spans,
       coalesce(max(head || other) FILTER (differs), '') AS rejected_completion,
       coalesce(max(length(head) || ':' || length(head || other)) FILTER (differs), '') AS rejected_spans
FROM m GROUP BY conv_id, own
"""


_OP11 = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295::BIGINT, list_reduce(
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT)) % 20 AS kind
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM k WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS prev, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)
), f AS (
  SELECT *, substr(role, 1, 1) AS r, count(*) OVER (PARTITION BY conv_id) - i AS left_,
         CASE WHEN ends = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
              WHEN right(ends, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         prev IS NOT NULL AND prev || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM n
), t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS size
  FROM f GROUP BY conv_id
), dp AS (
  SELECT conv_id, size, 0::BIGINT AS done, {'c': 0::BIGINT, 'a': '', 'm': ''} AS s0, {'c': 6::BIGINT, 'a': 'II', 'm': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1,
         {'c': 3::BIGINT, 'a': 'I', 'm': chr(10) || 'assistant:'} AS s2, {'c': 0::BIGINT, 'a': '', 'm': ''} AS s3
  FROM t
  UNION ALL
  SELECT conv_id, size, done + 1,
         list_sort([n0, {'c': 3 + n2.c, 'a': 'I' || n2.a, 'm': chr(10) || 'user:' || n2.m}, {'c': 6 + n3.c, 'a': 'II' || n3.a, 'm': chr(10) || 'user:' || chr(10) || 'assistant:' || n3.m}])[1],
         list_sort([n1, {'c': 3 + n2.c, 'a': 'I' || n2.a, 'm': chr(10) || 'user:' || n2.m}, {'c': 6 + n3.c, 'a': 'II' || n3.a, 'm': chr(10) || 'user:' || chr(10) || 'assistant:' || n3.m}])[1],
         list_sort([n2, {'c': 3 + n3.c, 'a': 'I' || n3.a, 'm': chr(10) || 'assistant:' || n3.m}])[1],
         list_sort([n3, {'c': 3 + n2.c, 'a': 'I' || n2.a, 'm': chr(10) || 'user:' || n2.m}])[1]
  FROM (
    SELECT dp.conv_id, size, done,
           list_sort([{'c': 4 + s0.c, 'a': 'D' || s0.a, 'm': s0.m},
             CASE r WHEN 's' THEN {'c': keep + s1.c, 'a': 'K' || s1.a, 'm': line || s1.m} WHEN 'u' THEN {'c': keep + s2.c, 'a': 'K' || s2.a, 'm': line || s2.m} ELSE {'c': 999999999, 'a': '', 'm': ''} END,
             {'c': keep + 3 + s2.c, 'a': 'R' || s2.a, 'm': chr(10) || 'user:' || text || s2.m}])[1] AS n0,
           list_sort([{'c': 4 + s1.c, 'a': 'D' || s1.a, 'm': s1.m},
             CASE r WHEN 'u' THEN {'c': keep + s2.c, 'a': 'K' || s2.a, 'm': line || s2.m} ELSE {'c': 999999999, 'a': '', 'm': ''} END,
             {'c': keep + 3 + s2.c, 'a': 'R' || s2.a, 'm': chr(10) || 'user:' || text || s2.m}])[1] AS n1,
           list_sort([{'c': 4 + s2.c, 'a': 'D' || s2.a, 'm': s2.m},
             CASE r WHEN 'a' THEN {'c': keep + s3.c, 'a': 'K' || s3.a, 'm': line || s3.m} ELSE {'c': 999999999, 'a': '', 'm': ''} END,
             {'c': keep + 3 + s3.c, 'a': 'R' || s3.a, 'm': chr(10) || 'assistant:' || text || s3.m}])[1] AS n2,
           list_sort([{'c': 4 + s3.c, 'a': 'D' || s3.a, 'm': s3.m},
             CASE r WHEN 'u' THEN {'c': keep + s2.c, 'a': 'K' || s2.a, 'm': line || s2.m} ELSE {'c': 999999999, 'a': '', 'm': ''} END,
             {'c': keep + 3 + s2.c, 'a': 'R' || s2.a, 'm': chr(10) || 'user:' || text || s2.m}])[1] AS n3
    FROM dp JOIN (
      SELECT conv_id, left_, r, text, chr(10) || role || ':' || text AS line, (CASE fault WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 999999999 END)::BIGINT AS keep FROM f
    ) f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.left_ = dp.done
  )
), best AS (
  SELECT conv_id, s0.c AS cost, s0.a AS audit, sha256(substr(s0.m, 2)) AS repaired_sha256 FROM dp WHERE done = size
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


_OP12 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0
), p AS (
  SELECT rid, doc_id, term, count(*)::BIGINT AS tf, any_value(n) AS n FROM (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY rid, doc_id, term
), t AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s GROUP BY term
), q AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
), scored AS (
  SELECT item, item_id, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN p USING (term), s GROUP BY item, item_id, rid, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_exact_topk, op3_html_extraction, op4_simhash_near_dedup, op5_preference_formatting,
        op6_hidden_markov, op7_quality_classifier, op8_benchmark_decontamination, op9_sharding, op10_suffix_array_dedup, op11_conversation_repair, op12_ranked_search,
        op13_toxicity,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": _OP2, "op5_preference_formatting": _OP5, "op8_benchmark_decontamination": _OP8, "op11_conversation_repair": _OP11, "op12_ranked_search": _OP12}
