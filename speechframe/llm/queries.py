"""The corpus operators' registered queries, and DuckDB SQL where it can express them."""

from __future__ import annotations

from speechframe.llm import bpe, decontaminate, exact_substrings, fuzzy_passages, importance, licenses, near_duplicates, product_codes, pseudonyms, quality, token_counts, token_files, top_k
from speechframe.llm.common import table

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _values(rows: list[tuple]) -> str:
    """Rows of a DuckDB VALUES list: a text as a list of words, then the rest."""
    return ", ".join(f"(string_split('{' '.join(licenses.tokens_of(text))}', ' '), {', '.join(map(repr, rest))})" for text, *rest in rows)


def _product_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds, all distances each, a pair of steps a round."""
    steps = [
        f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM piece JOIN first USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min({{'d': {far}, 'e': e}}) AS m FROM piece JOIN book{r} USING (p) GROUP BY vec_id, label, p)")
        if r < rounds:
            mean = f"SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM near{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL) GROUP BY p, e"
            steps.append(f"mean{r} AS ({mean}), book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, e))")
    return (
        ",\n".join(steps)
        + f""",
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, i, c[i] AS n FROM book{rounds}, unnest(range(1, len(c) + 1)) t(i)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""
    )


def op1_top_k(spark, sf_dir):
    return top_k.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op2_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_of_pages(spark, sf_dir):
    return quality.page_digest(*(table(spark, sf_dir, name) for name in ("pages", "documents", "labels")))


def op4_pseudonyms(spark, sf_dir):
    return pseudonyms.digest(table(spark, sf_dir, "documents"), pseudonyms.session_key(spark))


def op5_exact_substrings(spark, sf_dir):
    return exact_substrings.digest(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_fuzzy_passages(spark, sf_dir):
    return fuzzy_passages.passages(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    return near_duplicates.digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.over_limit(table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


def op11_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark, sf_dir):
    return token_files.digest(table(spark, sf_dir, "documents"))


def op13_product_codes(spark, sf_dir):
    return product_codes.codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality": op3_quality,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_exact_substrings": op5_exact_substrings,
    "op6_decontaminate": op6_decontaminate,
    "op7_fuzzy_passages": op7_fuzzy_passages,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "op11_importance": op11_importance,
    "op12_token_files": op12_token_files,
    "op13_product_codes": op13_product_codes,
    "quality_of_pages": quality_of_pages,
}

ORACLES = {
    "op1_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op6_decontaminate": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win
        FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
dwin AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM dw, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_license_scan": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
phrase(words, label) AS (VALUES {_values(list(licenses.PHRASES.items()))}),
template(words, label, step, length) AS (VALUES {_values([(" ".join(licenses.tokens_of(text)), label, *licenses.windows_of(licenses.class_of(text))) for label, text in licenses.TEMPLATES.items()])}),
place AS (SELECT doc_id, i - 1 AS p, label FROM d, unnest(range(1, len(w) + 1)) t(i), phrase WHERE list_slice(w, i, i + len(words) - 1) = words),
block AS (SELECT DISTINCT step, length, doc_id, list_slice(w, k * step + 1, k * step + length) AS w
          FROM d, (SELECT DISTINCT step, length FROM template), unnest(range(0, greatest(0, ceil((len(w) - length) / step)::BIGINT) + 1)) t(k)),
hit AS (SELECT doc_id, label, len(list_intersect(w, words)) / len(list_distinct(words)) AS score FROM block JOIN template USING (step, length)
        WHERE len(list_intersect(w, words)) >= ceil(0.9 * len(list_distinct(words)) - 1e-9)),
base AS (SELECT doc_id, count(*) AS n, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM hit) GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)""",
    "op11_importance": f"""
WITH RECURSIVE step AS (SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
              UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS l FROM step WHERE k = 8),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
feature AS (SELECT doc_id, unnest(w) AS word FROM dw),
aimed AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM feature UNION SELECT word FROM aimed)),
hashed AS (SELECT word, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(h), 2), lambda p: ('0x' || substr(h, p, 2))::UBIGINT)),
                             lambda c, b: xor(c >> 8, l[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000)::INTEGER AS bucket FROM vocabulary, crcs),
source AS (SELECT bucket, count(*) AS s FROM feature JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM aimed JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM source)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(target.t, 0) + 1)::DOUBLE * (total.s + 10000) / ((source.s + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain
         FROM source LEFT JOIN target USING (bucket), total),
gained AS (SELECT doc_id, sum(gain)::BIGINT AS gained FROM feature JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(gained / len(w)) END::BIGINT AS weight,
                  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM dw LEFT JOIN gained USING (doc_id)),
noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM noisy LEFT JOIN placed USING (doc_id)""",
    "op13_product_codes": _product_codes_sql(),
}
