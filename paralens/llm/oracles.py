"""DuckDB SQL for the queries that SQL can express."""

SPACED = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACED}')) AS l
    FROM documents
), words AS (
    SELECT row_id, unnest(w) AS w1, generate_subscripts(w, 1) AS p FROM d
), windows AS (
    SELECT row_id, p, concat_ws(' ', w1, lead(w1, 1) OVER x, lead(w1, 2) OVER x, lead(w1, 3) OVER x, lead(w1, 4) OVER x) AS five,
           lead(w1, 4) OVER x AS w5
    FROM words WINDOW x AS (PARTITION BY row_id ORDER BY p)
), found AS (
    SELECT row_id, p, count(*) OVER (PARTITION BY row_id, five) AS times FROM windows WHERE w5 IS NOT NULL
), hit AS (
    SELECT row_id, count(DISTINCT p + k) AS n FROM found, (SELECT unnest(range(0, 5)) AS k) WHERE times > 1 GROUP BY row_id
), m AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(string_split(t, chr(10)))::BIGINT AS n_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN hit USING (row_id)
), bits AS (
    SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
             + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
             + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
             + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM bits
"""

#: Lower-cased words of documents (d) and benchmark items (i), one row a word.
OP1 = r"""
WITH d AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), i AS (
    SELECT row_number() OVER () AS item_row, item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL
), dw AS (
    SELECT row_id, unnest(w) AS w1, generate_subscripts(w, 1) AS p FROM d
), iw AS (
    SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[k:k + 7], ' ') AS window_text
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), eights AS (
    SELECT row_id, p, [w1, lead(w1, 1) OVER x, lead(w1, 2) OVER x, lead(w1, 3) OVER x, lead(w1, 4) OVER x, lead(w1, 5) OVER x, lead(w1, 6) OVER x, lead(w1, 7) OVER x] AS ws
    FROM dw WINDOW x AS (PARTITION BY row_id ORDER BY p)
), grams AS (
    SELECT row_id, p, n, array_to_string(ws[1:n], ' ') AS gram FROM eights, (SELECT DISTINCT n FROM iw) WHERE ws[n] IS NOT NULL
), hits AS (
    SELECT row_id, p, iw.n, item_id FROM grams JOIN iw ON iw.n = grams.n AND gram = window_text
), n_hit AS (
    SELECT row_id, count(DISTINCT q) AS n_hit FROM (SELECT row_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY row_id
), per_doc AS (
    SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM hits) GROUP BY row_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n_hit USING (row_id) LEFT JOIN per_doc USING (row_id)
"""

OP8 = rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::BIGINT AS n_tokens FROM documents
), sums AS (
    SELECT source, sum(n_tokens)::BIGINT AS held FROM sized GROUP BY source
), one AS (
    SELECT list(held ORDER BY held) AS helds, sum(held)::BIGINT AS total FROM sums WHERE held > 0
), shared AS (
    SELECT *, list_transform(helds, lambda h: h::DOUBLE / total) AS shares FROM one
), bisect AS (
    SELECT 0 AS step, 0::DOUBLE AS e_lo, 1::DOUBLE AS e_hi, 0::DOUBLE AS r_lo, 1::DOUBLE AS r_hi
    UNION ALL
    SELECT step + 1, CASE WHEN enough THEN e ELSE e_lo END, CASE WHEN enough THEN e_hi ELSE e END,
           CASE WHEN within THEN r_lo ELSE r END, CASE WHEN within THEN r ELSE r_hi END
    FROM (
        SELECT b.*, (e_lo + e_hi) / 2 AS e, (r_lo + r_hi) / 2 AS r,
               ln(list_sum(list_transform(shares, lambda p: pow(p, (e_lo + e_hi) / 2))))
                 - (e_lo + e_hi) / 2 * list_sum(list_transform(shares, lambda p: pow(p, (e_lo + e_hi) / 2) * ln(p)))
                   / list_sum(list_transform(shares, lambda p: pow(p, (e_lo + e_hi) / 2))) >= 0.98::DOUBLE * ln(len(shares)) AS enough,
               pow(list_min(shares), (r_lo + r_hi) / 2 - 1) / list_sum(list_transform(shares, lambda p: pow(p, (r_lo + r_hi) / 2))) <= 4 AS within
        FROM bisect b, shared WHERE step < 40
    )
), found AS (
    SELECT greatest(
        CASE WHEN ln(list_sum(shares)) - list_sum(list_transform(shares, lambda p: p * ln(p))) / list_sum(shares) >= 0.98::DOUBLE * ln(len(shares)) THEN 1 ELSE e_lo END,
        CASE WHEN pow(list_min(shares), -1) / len(shares) <= 4 THEN 0 ELSE r_hi END) AS alpha, shares, total
    FROM bisect, shared WHERE step = 40
), plan AS (
    SELECT source, held, alpha, total,
           CASE WHEN held > 0 THEN pow(held::DOUBLE / total, alpha) / list_sum(list_transform(shares, lambda p: pow(p, alpha))) ELSE 0 END AS weight
    FROM sums, found
), quotas AS (
    SELECT *, floor(weight * total + 0.5)::BIGINT AS quota, greatest(1, ceil(total / 100000))::BIGINT AS blocks FROM plan
), passes AS (
    SELECT *, CASE WHEN held > 0 THEN quota // held ELSE 1 END AS whole, CASE WHEN held > 0 THEN quota % held ELSE 0 END AS rest FROM quotas
), taken AS (
    SELECT s.doc_id, s.n_tokens, p.*, e.epoch, md5('8001|' || e.epoch || '|' || s.doc_id) AS place
    FROM sized s JOIN passes p USING (source), LATERAL (SELECT unnest(range(0, whole + (rest > 0)::INT)) AS epoch) e
), placed AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS at_token FROM taken
)
SELECT source, doc_id, n_tokens, epoch::INTEGER AS epoch,
       least(blocks - 1, ((epoch * held + at_token) * blocks) // greatest(quota, 1))::BIGINT AS block,
       round(alpha, 6) AS alpha, round(weight, 6) AS weight
FROM placed WHERE epoch < whole OR at_token < rest
"""

#: Bytes as two hexadecimal digits each; windows start at byte k.
OP7 = """
WITH d AS (
    SELECT row_number() OVER () AS row_id, coalesce(doc_id, 9223372036854775807) AS id, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
    SELECT row_id, id, k, substr(x, 2 * k + 1, 100) AS w FROM (SELECT row_id, id, x, unnest(range(0, len(x) // 2 - 49)) AS k FROM d)
), covered AS (
    SELECT row_id, k FROM (SELECT row_id, id, k, min(id) OVER (PARTITION BY w) AS first_id FROM windows) WHERE first_id < id
), marked AS (
    SELECT row_id, k, coalesce(k > lag(k) OVER r + 50, true)::INT AS fresh FROM covered WINDOW r AS (PARTITION BY row_id ORDER BY k)
), spans AS (
    SELECT row_id, min(k) AS low, max(k) + 50 AS high
    FROM (SELECT row_id, k, sum(fresh) OVER (PARTITION BY row_id ORDER BY k) AS span FROM marked) GROUP BY row_id, span
), gaps AS (
    SELECT row_id, low, high, coalesce(lag(high) OVER (PARTITION BY row_id ORDER BY low), 0) AS after FROM spans
), cut AS (
    SELECT row_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, max(high) AS final,
           string_agg(substr(x, 2 * after + 1, 2 * (low - after)), '' ORDER BY low) AS kept
    FROM gaps JOIN d USING (row_id) GROUP BY row_id
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * final + 1), x))) AS kept_sha256
FROM d LEFT JOIN cut USING (row_id)
"""

#: CRC-32 of short ASCII strings, a byte at a time: the low eight bits pick what is folded in.
_FOLD = "list_reduce([c] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"

LM_BASE = rf"""
WITH RECURSIVE ids AS (
    SELECT DISTINCT doc_id, doc_id::VARCHAR AS t FROM documents WHERE doc_id IS NOT NULL
), crc AS (
    SELECT doc_id, t, 4294967295::BIGINT AS c FROM ids
    UNION ALL
    SELECT doc_id, t[2:], {_FOLD.replace('[c]', '[xor(c, ascii(t)::BIGINT)]')} FROM crc WHERE t <> ''
), held AS (
    SELECT doc_id, xor(c, 4294967295) % 7 = 2 AS held_out FROM crc WHERE t = ''
), d AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(held_out, true) AS held_out,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACED}') || [' '] AS w
    FROM documents LEFT JOIN held USING (doc_id)
), tokens AS (
    SELECT row_id, held_out, unnest(w) AS token FROM d
), counts AS (
    SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token
), sums AS (
    SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts
), scored AS (
    SELECT row_id, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)) AS base
    FROM tokens LEFT JOIN counts USING (token), sums GROUP BY row_id
)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 3) AS base_score FROM d JOIN scored USING (row_id), sums
"""

ORACLES: dict[str, str] = {
    "lm_base_scores": LM_BASE,
    "op7_suffix_dedup": OP7,
    "op1_decontamination": OP1,
    "op2_quality_rules": OP2,
    "op8_mixing": OP8,
}
