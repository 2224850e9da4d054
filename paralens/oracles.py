"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from .functions import fixed
from .queries import DONE, HOURS, PERMUTATIONS, SHUFFLES, SPLITS
from .sources.tables import RESPONSES, TEMPLATES
from .tasks import get

GRADED = rf"""
responses AS (SELECT {RESPONSES} FROM lineitem),
found AS (SELECT *, regexp_extract_all(regexp_replace(regexp_replace(r, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '[0-9]+') AS cs FROM responses),
graded AS (
    SELECT p, i, cs[-1] AS prediction,
           CASE WHEN r IS NULL THEN 'error' WHEN len(cs) = 0 THEN 'unparseable' WHEN ltrim(cs[-1], '0') = ltrim(answer, '0') THEN 'correct' ELSE 'wrong' END AS outcome,
           coalesce(list_bool_or(list_transform(cs, lambda c: ltrim(c, '0') = ltrim(answer, '0'))), false) AS lenient
    FROM found
)"""
COUNTS = """count(*) AS attempts, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong,
    count(*) FILTER (outcome = 'unparseable') AS unparseable, count(*) FILTER (outcome = 'error') AS error, count(*) FILTER (lenient) AS lenient_correct"""


def accounts(source: str = "graded", name: str = "accounts") -> str:
    return f"""counted AS (SELECT p, {COUNTS} FROM {source} GROUP BY p),
{name} AS (
    SELECT *, correct / nullif(attempts - error, 0)::DOUBLE AS strict_accuracy, correct / nullif(correct + wrong, 0)::DOUBLE AS parsed_accuracy,
           lenient_correct / nullif(attempts - error, 0)::DOUBLE AS lenient_accuracy
    FROM counted
)"""


def described(column: str, digits: int = 9) -> str:
    q = lambda x: f"quantile_cont({column}, {x})"
    parts = {
        "mean": f"avg({column})", "sd": f"stddev_pop({column})", "min": f"min({column})", "max": f"max({column})", "range": f"max({column}) - min({column})",
        "p05": q(0.05), "p25": q(0.25), "median": q(0.5), "p75": q(0.75), "p95": q(0.95), "iqr": f"{q(0.75)} - {q(0.25)}",
    }
    return f"count({column}) AS n, " + ", ".join(f'round({v}, {digits}) AS "{k}"' for k, v in parts.items())


DENSE = "dense AS (SELECT user_id AS p, event_type AS i, (max(value) >= 97)::INT AS c FROM events GROUP BY 1, 2)"
SPARSE = f"""sparse AS (SELECT user_id AS p, hour(ts)::INT AS i, (max(value) >= 60)::INT AS c FROM events GROUP BY 1, 2),
whole AS (SELECT * FROM sparse WHERE p IN (SELECT p FROM sparse GROUP BY p HAVING count(DISTINCT i) = {HOURS}))"""


def cochran(cells: str) -> str:
    return f"""margins AS (
    SELECT k, b, sum_g, squares_g, sum_l, squares_l
    FROM (SELECT count(*) AS k, sum(g)::BIGINT AS sum_g, sum(g * g)::BIGINT AS squares_g FROM (SELECT sum(c)::BIGINT AS g FROM {cells} GROUP BY p)),
         (SELECT count(*) AS b, sum(l)::BIGINT AS sum_l, sum(l * l)::BIGINT AS squares_l FROM (SELECT sum(c)::BIGINT AS l FROM {cells} GROUP BY i))
)"""


Q = "CASE WHEN k >= 2 AND k * sum_l <> squares_l THEN (k - 1) * (k * squares_g - sum_g * sum_g) / (k * sum_l - squares_l)::DOUBLE END"


def null_distribution(cells: str) -> str:
    return f"""{cochran(cells)}, drawn AS (
    SELECT rep, p, i, l FROM {cells} JOIN (SELECT i, sum(c) AS l FROM {cells} GROUP BY i) USING (i), (SELECT unnest(range(0, {PERMUTATIONS}))::INT AS rep)
), chosen AS (
    SELECT rep, p, (row_number() OVER (PARTITION BY rep, i ORDER BY md5(concat_ws('|', '{fixed.SEED_PERMUTATION}', rep, i, p)), p) <= l)::INT AS c FROM drawn
), sums AS (
    SELECT rep, p, sum(c)::BIGINT AS g FROM chosen GROUP BY ALL
), reps AS (
    SELECT rep, count(*) AS k, sum(g)::BIGINT AS sum_g, sum(g * g)::BIGINT AS squares_g, max(g) AS most, min(g) AS least FROM sums GROUP BY rep
), null_values AS (
    SELECT rep, coalesce({Q.replace('k ', 'r.k ').replace('k)', 'r.k)').replace('sum_g', 'r.sum_g').replace('squares_g', 'r.squares_g')}, 0) AS q,
           sqrt((r.k * r.squares_g - r.sum_g * r.sum_g)::DOUBLE) / (r.k * b)::DOUBLE AS sd, (most - least) / b::DOUBLE AS range
    FROM reps r, margins
)"""


def halves(cells: str) -> str:
    return f"""drawn AS (
    SELECT rep, i, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '{fixed.SEED_SPLIT}', rep, i)), i) AS nth, count(*) OVER (PARTITION BY rep) // 2 AS size
    FROM (SELECT DISTINCT i FROM {cells}), (SELECT unnest(range(0, {SPLITS}))::INT AS rep)
), scored AS (
    SELECT rep, p, sum(CASE WHEN nth <= size THEN c ELSE 0 END)::BIGINT AS a, sum(CASE WHEN nth > size AND nth <= 2 * size THEN c ELSE 0 END)::BIGINT AS b
    FROM {cells} JOIN drawn USING (i) GROUP BY rep, p
), tops AS (
    SELECT rep, count(*) AS n, (count(*) * sum(a * b) - sum(a) * sum(b))::DOUBLE AS top,
           (count(*) * sum(a * a) - sum(a) * sum(a))::DOUBLE AS va, (count(*) * sum(b * b) - sum(b) * sum(b))::DOUBLE AS vb
    FROM scored GROUP BY rep
), splits AS (
    SELECT rep, top / (sqrt(va) * sqrt(vb)) AS r FROM tops WHERE n >= 3 AND va > 0 AND vb > 0
), corrected AS (
    SELECT rep, r, CASE WHEN r > -1 THEN 2 * r / (1 + r) END AS corrected FROM splits
)"""


_any = lambda p: f"regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}')::INT::DOUBLE"
_format = fixed.FORMAT.replace("'", "''")
FEATURES = rf"""
templates AS (SELECT {TEMPLATES} FROM documents),
features AS (
    SELECT p, length(text)::DOUBLE AS chars, len(regexp_extract_all(text, '\S+'))::DOUBLE AS words, len(regexp_extract_all(text, '{fixed.SENTENCE_END}'))::DOUBLE AS sentences,
           contains(text, '?')::INT::DOUBLE AS is_question, regexp_matches(trim(text), '(?i){fixed.ROLE}')::INT::DOUBLE AS role_frame,
           {_any(fixed.THINK)} AS think_cue, {_any(fixed.IMMEDIATE)} AS immediate_cue, {_any(fixed.FORMAT)} AS format_instruction, {_any(fixed.POLITE)} AS politeness,
           regexp_matches(text, '{fixed.MARKDOWN}')::INT::DOUBLE AS markdown, {_any(fixed.NUMBERED)} AS numbered_list,
           (len(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{3,}}'))) >= 2)::INT::DOUBLE AS shouty_caps,
           CASE WHEN regexp_matches(text, '{fixed.SLOT}') THEN length(regexp_extract(text, '(?s)^(.*?){fixed.SLOT}', 1)) / length(text)::DOUBLE ELSE 0 END AS slot_position,
           (regexp_matches(text, '(?i){_format}') AND regexp_matches(text, '{fixed.SLOT}')
            AND length(regexp_extract(text, '(?is)^(.*?)({_format})', 1)) < length(regexp_extract(text, '(?s)^(.*?){fixed.SLOT}', 1)))::INT::DOUBLE AS format_before_slot
    FROM templates
)"""
NAMES = "chars words sentences is_question role_frame think_cue immediate_cue format_instruction politeness markdown numbered_list shouty_caps slot_position format_before_slot".split()
RANKED = f"""{FEATURES}, long AS (
    SELECT f.p, name, list_position({NAMES}, name) - 1 AS ord, x, (n_chars % 25) / 24::DOUBLE AS y
    FROM (UNPIVOT features ON {', '.join(NAMES)} INTO NAME name VALUE x) f JOIN documents ON doc_id = f.p
), pairs AS (
    SELECT *, (2 * rank() OVER (PARTITION BY name ORDER BY x) + count(*) OVER (PARTITION BY name, x) - 1)::BIGINT AS rx,
           (2 * rank() OVER (PARTITION BY name ORDER BY y) + count(*) OVER (PARTITION BY name, y) - 1)::BIGINT AS ry
    FROM long
), sums AS (
    SELECT ord, name, count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * ry) AS xy, sum(rx * rx) AS xx, sum(ry * ry) AS yy FROM pairs GROUP BY ord, name
), rhos AS (
    SELECT ord, name, n, sx, sy, n * xy - sx * sy AS cov,
           CASE WHEN n >= 3 AND n * xx > sx * sx AND n * yy > sy * sy
                THEN (n * xy - sx * sy)::DOUBLE / (sqrt((n * xx - sx * sx)::DOUBLE) * sqrt((n * yy - sy * sy)::DOUBLE)) END AS rho
    FROM sums
)"""
TESTED = f"""{RANKED}, base AS (
    SELECT p, ry FROM pairs WHERE name = 'chars'
), shuffled AS (
    SELECT rep, p, ry, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '{fixed.SEED_SPEARMAN}', rep, p)), p) AS nth, row_number() OVER (PARTITION BY rep ORDER BY p) AS k
    FROM base, (SELECT unnest(range(0, {SHUFFLES}))::INT AS rep)
), moved AS (
    SELECT a.rep, a.p, b.ry AS other FROM shuffled a JOIN shuffled b ON a.rep = b.rep AND a.k = b.nth
), products AS (
    SELECT rep, name, sum(rx * other) AS xy FROM pairs JOIN moved USING (p) GROUP BY rep, name
), tested AS (
    SELECT name, any_value(ord) AS ord, any_value(rho) AS rho,
           CASE WHEN any_value(rho) IS NOT NULL THEN (count(*) FILTER (abs(n * products.xy - sx * sy) >= abs(cov)) + 1) / {SHUFFLES + 1}::DOUBLE END AS p
    FROM products JOIN rhos USING (name) GROUP BY name
)"""
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9{{}} ]+', ' ', 'g'), ' +', ' ', 'g'))"
REPLIES = """replies AS (
    SELECT doc_id AS id, CASE quality WHEN 1 THEN concat(' equivalent ; same question, ', toxic) WHEN 0 THEN 'Different;drops the task' END AS reply, text
    FROM documents LEFT JOIN labels USING (doc_id)
), judged AS (
    SELECT id, coalesce(substr(upper(trim(split_part(reply, ';', 1))), 1, 12), 'UNJUDGED') AS verdict,
           coalesce(substr(trim(CASE WHEN contains(reply, ';') THEN substr(reply, strpos(reply, ';') + 1) ELSE '' END), 1, 200), '') AS reason
    FROM replies
)"""
TALLY = "count(*) AS n, count(*) FILTER (verdict LIKE 'EQUIV%') AS equivalent"
RATE = "round(count(*) FILTER (verdict LIKE 'EQUIV%') / nullif(count(*), 0)::DOUBLE, 9) AS rate"
TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def reasons(slots: list[str], rest: str) -> str:
    times = "".join(f"WHEN len(list_filter(f, lambda x: x = '{{{s}}}')) <> 1 THEN concat('placeholder {{{s}}} appears ', len(list_filter(f, lambda x: x = '{{{s}}}')), ' times') " for s in slots)
    wanted = ", ".join(f"'{{{s}}}'" for s in slots)
    others = f"list_filter(f, lambda x: x NOT IN ({wanted}))"
    return rf"""SELECT p, text, CASE WHEN t = '' THEN 'empty' WHEN contains(t, chr(10)) THEN 'multiline'
    WHEN length(t) < 20 OR length(t) > 700 THEN concat('length ', length(t), ' outside 20..700') {times}
    WHEN len({others}) > 0 THEN concat('unexpected placeholder(s) [', array_to_string(list_transform({others}, lambda x: concat('''', x, '''')), ', '), ']') {rest} END AS reason
FROM (SELECT p, text, t, regexp_extract_all(t, '\{{[^}}]*\}}') AS f FROM (SELECT p, text, {TRIMMED} AS t FROM candidates))"""


MULT_REASONS = f"WITH candidates AS (SELECT {TEMPLATES} FROM documents), checked AS ({reasons(['a', 'b'], chr(10) + chr(32) * 4 + 'WHEN regexp_matches(t, ' + repr('[0-9]{3,}') + ') THEN ' + repr('contains a 3+ digit number, which could be a leaked answer'))})"
ENTAIL_REASONS = f"""WITH candidates AS (
    SELECT doc_id AS p, replace(concat('{{rule}} {{fact}} {{target}} YES no ', text, CASE WHEN doc_id % 2 = 0 THEN ' Unknown?' ELSE '{{x}}' END), chr(10), ' ') AS text FROM documents
) SELECT p, reason FROM ({reasons(['rule', 'fact', 'target'], ''.join(f"WHEN NOT regexp_matches(lower(t), {chr(39)}{chr(92)}b{w}{chr(92)}b{chr(39)}) THEN {chr(39)}does not name the option {chr(39) * 2}{w}{chr(39) * 3} " for w in fixed.LABEL_WORDS))})"""
PAIRS = """pairs AS (
    SELECT conv_id AS p, turn::VARCHAR AS i, text AS first, CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 5 = 0 THEN concat(text, '!') ELSE text END AS second,
           CASE WHEN conv_id % 7 = 0 THEN 'timeout' END AS e
    FROM conversations
)"""
MULT_VALUES = ", ".join(f"({k}, {x.slots['a']}, {x.slots['b']})" for k, x in enumerate(get("mult").items))
CONTENT = ", ".join(f"({k}, '{p}', '{q}')" for k, (p, q) in enumerate(fixed.CONDITIONALS))

ORACLES: dict[str, str] = {
    "grade_outcomes": f"WITH {GRADED} SELECT p, i, prediction, outcome, lenient FROM graded",
    "grade_by_wording": f"WITH {GRADED}, {accounts()} SELECT p, attempts, correct, wrong, unparseable, error, lenient_correct, round(strict_accuracy, 9) AS strict_accuracy, round(parsed_accuracy, 9) AS parsed_accuracy, round(lenient_accuracy, 9) AS lenient_accuracy FROM accounts",
    "label_extract": r"""WITH f AS (SELECT doc_id, regexp_extract_all(lower(text), '\b(yes|no|unknown)\b', 1) AS l, CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS answer FROM documents)
SELECT doc_id, array_to_string(l, ',') AS labels, CASE WHEN l IS NULL THEN 'error' WHEN len(l) = 0 THEN 'unparseable' WHEN l[-1] = answer THEN 'correct' ELSE 'wrong' END AS outcome, coalesce(list_contains(l, answer), false) AS lenient FROM f""",
    "accounting_totals": f"WITH {GRADED}, {accounts()} SELECT count(*) AS wordings, sum(attempts)::BIGINT AS attempts, sum(correct)::BIGINT AS correct, sum(wrong)::BIGINT AS wrong, sum(unparseable)::BIGINT AS unparseable, sum(error)::BIGINT AS error, sum(lenient_correct)::BIGINT AS lenient_correct FROM accounts",
    "usable_wordings": f"WITH {GRADED} SELECT p, count(*) AS attempts, count(*) FILTER (outcome = 'error') AS failed, count(*) FILTER (outcome = 'error') = 0 AS kept FROM graded GROUP BY p HAVING count(*) >= 20",
    "complete_wordings": f"WITH {SPARSE} SELECT p, i, c FROM whole",
    "duplicates_check": "SELECT sum(n)::BIGINT AS responses, count(*) AS pairs, (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "describe_strict": f"WITH {GRADED}, {accounts()} SELECT {described('strict_accuracy')} FROM accounts",
    "describe_parsed": f"WITH {GRADED}, {accounts()} SELECT {described('parsed_accuracy')} FROM accounts",
    "describe_groups": f"SELECT o_orderpriority, {described('o_totalprice', 4)} FROM orders GROUP BY 1",
    "histogram_scores": f"""WITH {SPARSE}, accs AS (SELECT p, avg(c) AS acc FROM whole GROUP BY p),
counts AS (SELECT least(greatest(trunc((acc + 0.5 / {HOURS}) / (1 + 1.0 / {HOURS}) * {HOURS + 1}), 0), {HOURS})::BIGINT AS bin, count(*) AS n FROM accs GROUP BY 1)
SELECT b AS bin, round((-0.5 / {HOURS})::DOUBLE + (1 + 1.0 / {HOURS})::DOUBLE * b / {HOURS + 1}, 9) AS low, round((-0.5 / {HOURS})::DOUBLE + (1 + 1.0 / {HOURS})::DOUBLE * (b + 1) / {HOURS + 1}, 9) AS high, coalesce(n, 0) AS n
FROM (SELECT unnest(range(0, {HOURS + 1})) AS b) LEFT JOIN counts ON b = bin""",
    "histogram_clamped": """WITH counts AS (SELECT least(greatest(trunc((value - 1) / 89 * 20), 0), 19)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT b AS bin, round(1 + 89 * b / 20::DOUBLE, 9) AS low, round(1 + 89 * (b + 1) / 20::DOUBLE, 9) AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS b) LEFT JOIN counts ON b = bin""",
    "best_worst": f"""WITH {GRADED}, {accounts()}, a AS (SELECT * FROM accounts WHERE strict_accuracy IS NOT NULL)
SELECT (SELECT p FROM a ORDER BY strict_accuracy DESC, p LIMIT 1) AS best, round(max(strict_accuracy), 9) AS best_value, (SELECT p FROM a ORDER BY strict_accuracy, p LIMIT 1) AS worst, round(min(strict_accuracy), 9) AS worst_value FROM a""",
    "canonical_rank": f"""WITH {SPARSE}, {DENSE}, own AS (SELECT avg(c) AS a FROM dense WHERE p = 1), kept AS (SELECT p, avg(c) AS acc FROM whole GROUP BY p)
SELECT round(max(a), 9) AS canonical_accuracy, round(avg((acc <= a)::INT), 9) AS canonical_percentile FROM kept, own""",
    "cochran_q": f"WITH {DENSE}, {cochran('dense')} SELECT k, b, round({Q}, 9) AS q FROM margins",
    "cochran_q_sparse": f"WITH {SPARSE}, {cochran('whole')} SELECT k, b, round({Q}, 9) AS q FROM margins",
    "permutation_null": f"WITH {DENSE}, {null_distribution('dense')} SELECT rep, round(q, 9) AS q, round(sd, 9) AS sd, round(range, 9) AS range FROM null_values",
    "spread_test": f"""WITH {SPARSE}, {null_distribution('whole')}, seen AS (
    SELECT m.k, m.b, {Q.replace('k ', 'm.k ').replace('k)', 'm.k)')} AS oq, sqrt((m.k * squares_g - sum_g * sum_g)::DOUBLE) / (m.k * m.b)::DOUBLE AS osd,
           (SELECT (max(g) - min(g)) FROM (SELECT sum(c) AS g FROM whole GROUP BY p)) / m.b::DOUBLE AS orange FROM margins m
)
SELECT max(k) AS k_wordings, max(b) AS b_items, round(max(oq), 9) AS cochran_q, round((count(*) FILTER (q >= oq - abs(oq) * 1e-12) + 1) / (count(*) + 1)::DOUBLE, 9) AS q_p_value,
    round(max(osd), 9) AS observed_sd, round(avg(sd), 9) AS null_sd_mean, round(quantile_cont(sd, 0.95), 9) AS null_sd_p95, round((count(*) FILTER (sd >= osd - abs(osd) * 1e-12) + 1) / (count(*) + 1)::DOUBLE, 9) AS sd_p_value,
    round(max(orange), 9) AS observed_range, round(avg(range), 9) AS null_range_mean, round(quantile_cont(range, 0.95), 9) AS null_range_p95, round((count(*) FILTER (range >= orange - abs(orange) * 1e-12) + 1) / (count(*) + 1)::DOUBLE, 9) AS range_p_value,
    count(*) AS permutations
FROM null_values, seen""",
    "split_half": f"WITH {DENSE}, {halves('dense')} SELECT rep, round(r, 9) AS r, round(corrected, 9) AS corrected FROM corrected",
    "split_half_reliability": f"WITH {SPARSE}, {halves('whole')} SELECT count(*) AS splits, round(avg(r), 9) AS half_correlation, round(avg(corrected), 9) AS spearman_brown FROM corrected",
    "feature_values": f"WITH {FEATURES} SELECT p, {', '.join(f'round({n}, 9) AS {n}' for n in NAMES)} FROM features",
    "feature_spearman": f"WITH {RANKED} SELECT name, n, round(rho, 9) AS rho FROM rhos",
    "spearman_perm_p": f"WITH {TESTED} SELECT name, round(rho, 9) AS rho, round(p, 9) AS p FROM tested",
    "feature_table": f"""WITH {TESTED}, kinds AS (
    SELECT name, count(DISTINCT x) AS n_values, min(y) = max(y) AS flat, CASE WHEN bool_and(x IN (0, 1)) THEN avg(x) END AS share_with_feature FROM long GROUP BY name
), ps AS (
    SELECT ord, name, rho, CASE WHEN flat THEN NULL WHEN n_values < 2 THEN 1 ELSE p END AS p, share_with_feature FROM tested JOIN kinds USING (name)
), stepped AS (
    SELECT *, least(1, (count(p) OVER () - row_number() OVER (ORDER BY p, ord) + 1) * p) AS step FROM ps WHERE p IS NOT NULL
)
SELECT ord::INT AS ord, name, round(rho, 9) AS rho, round(p, 9) AS p, round(share_with_feature, 9) AS share_with_feature, round(max(step) OVER (ORDER BY p, ord ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM stepped
UNION ALL SELECT ord::INT, name, round(rho, 9), p, round(share_with_feature, 9), NULL FROM ps WHERE p IS NULL""",
    "holm": """WITH t AS (SELECT p_partkey AS ord, p_name AS name, p_size / 2000::DOUBLE AS p, p_brand FROM part),
s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, ord) + 1) * p) AS step FROM t)
SELECT ord, name, round(p, 9) AS p, p_brand, round(max(step) OVER (PARTITION BY p_brand ORDER BY p, ord ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s""",
    "normalise_dedup": f"SELECT min(doc_id) AS id, norm, count(*) AS copies FROM (SELECT doc_id, {NORM.format('text')} AS norm FROM documents) GROUP BY norm",
    "candidate_lines": r"""WITH l AS (SELECT doc_id, list_filter(string_split(concat('- 1) ', text), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)
SELECT doc_id, (generate_subscripts(ls, 1) - 1)::INT AS line, trim(ltrim(trim(unnest(ls)), '-*0123456789.) ')) AS text FROM l""",
    "validate_reasons": f"{MULT_REASONS} SELECT p, reason FROM checked",
    "validate_label_reasons": ENTAIL_REASONS,
    "rejected_candidates": f"{MULT_REASONS} SELECT substr(text, 1, 300) AS text, reason FROM checked WHERE reason IS NOT NULL",
    "pool_extend": f"""WITH d AS (SELECT *, {NORM.format('text')} AS norm FROM documents), old AS (SELECT * FROM d WHERE doc_id % 4 = 0),
firsts AS (SELECT norm, min(doc_id) AS doc_id FROM d WHERE doc_id % 4 <> 0 AND norm NOT IN (SELECT norm FROM old) GROUP BY norm)
SELECT doc_id AS id, lang AS style, 'author' AS source, md5(text) AS text_md5 FROM old
UNION ALL SELECT (SELECT max(doc_id) FROM old) + row_number() OVER (ORDER BY doc_id), lang, 'generated', md5(text) FROM firsts JOIN documents USING (doc_id)""",
    "sample_without_replacement": "SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', '17', doc_id)), doc_id LIMIT 40",
    "style_combinations": f"""WITH combos AS (SELECT style, axis, row_number() OVER (ORDER BY md5(concat_ws('|', '{fixed.SEED_GENERATE}', style, axis)), style, axis) - 1 AS nth
    FROM (SELECT DISTINCT lang AS style FROM documents), (SELECT DISTINCT source AS axis FROM documents))
SELECT k AS call, style, axis FROM (SELECT unnest(range(0, 200)) AS k) JOIN combos ON nth = k % (SELECT count(*) FROM combos)""",
    "equivalence_rate": f"WITH {REPLIES} SELECT {TALLY}, count(*) FILTER (verdict = 'UNJUDGED') AS unjudged, {RATE} FROM judged",
    "round_trip_rate": f"WITH {REPLIES} SELECT {TALLY}, {RATE}, count(*) FILTER (id % 5 = 0) AS slots_survived FROM judged",
    "verdict_parse": f"WITH {REPLIES} SELECT id, verdict, reason FROM judged",
    "equivalence_filter": f"WITH {REPLIES}, {GRADED}, {accounts()} SELECT p, attempts, round(strict_accuracy, 9) AS strict_accuracy FROM accounts WHERE p = 0 OR p IN (SELECT id FROM judged WHERE verdict LIKE 'EQUIV%')",
    "work_list": f"""WITH t AS (SELECT {TEMPLATES} FROM documents), items AS (SELECT * FROM (VALUES {MULT_VALUES}) AS v(ord, a, b)),
every AS (SELECT p, concat('mult-', a, 'x', b) AS i, concat('What is ', a, ' times ', b, '? ', text) AS raw, a, b, ord FROM t, items)
SELECT p, i, replace(replace(raw, '{{a}}', a::VARCHAR), '{{b}}', b::VARCHAR) AS prompt, md5(concat_ws('|', '{fixed.SEED_ORDER}', p)) AS turn, ord FROM every
WHERE NOT EXISTS (FROM labels WHERE doc_id = p AND i = {list(DONE)}[doc_id % {len(DONE)} + 1])""",
    "render_prompt": f"WITH t AS (SELECT {TEMPLATES} FROM documents) SELECT p, replace(replace(text, '{{a}}', p::VARCHAR), '{{b}}', '{{a}}') AS prompt FROM t",
    "repeat_agreement": f"WITH {PAIRS} SELECT count(*) AS n, count(*) FILTER (first = second) AS identical, count(e) AS failed, round(count(*) FILTER (first = second) / nullif(count(*), 0)::DOUBLE, 9) AS rate FROM pairs",
    "repeat_disagreements": f"WITH {PAIRS} SELECT p, i, substr(first, 1, 160) AS first, substr(second, 1, 160) AS second FROM pairs WHERE e IS NULL AND first <> second ORDER BY p, i LIMIT 12",
    "discover_runs": """WITH found AS (SELECT DISTINCT lang AS task, translate(source, '1', '-') AS slug FROM documents),
metas AS (SELECT DISTINCT lang AS task, translate(source, '1', ':') AS model FROM documents),
known AS (SELECT task, translate(model, ':/', '--') AS slug, min(model) AS model FROM metas GROUP BY 1, 2)
SELECT task, coalesce(model, slug) AS model, slug FROM found LEFT JOIN known USING (task, slug)""",
    "mult_items": f"SELECT ord, concat('mult-', a, 'x', b) AS key, (a * b)::VARCHAR AS answer, a::VARCHAR AS a, b::VARCHAR AS b FROM (VALUES {MULT_VALUES}) AS v(ord, a, b)",
    "entail_items": f"""WITH c AS (SELECT *, concat(upper(substr(p, 1, 1)), substr(p, 2)) AS pu, concat(upper(substr(q, 1, 1)), substr(q, 2)) AS qu FROM (VALUES {CONTENT}) AS v(k, p, q)),
f AS (SELECT k * 4 AS ord, 'mp' AS form, p, q, pu AS fact, qu AS target, 'yes' AS answer FROM c UNION ALL SELECT k * 4 + 1, 'mt', p, q, concat('It is not the case that ', q), pu, 'no' FROM c
    UNION ALL SELECT k * 4 + 2, 'ac', p, q, qu, pu, 'unknown' FROM c UNION ALL SELECT k * 4 + 3, 'da', p, q, concat('It is not the case that ', p), qu, 'unknown' FROM c)
SELECT ord, concat(form, '-', ord) AS key, answer, concat('If ', p, ', then ', q, '.') AS rule, concat(fact, '.') AS fact, target FROM f""",
    "analysis_summary": f"""WITH {GRADED}, good AS (SELECT p FROM graded GROUP BY p HAVING count(*) >= 20 AND count(*) FILTER (outcome = 'error') * 3 < count(*)),
kept AS (SELECT * FROM graded WHERE p IN (SELECT p FROM good)), {accounts('kept')}
SELECT 'strict' AS measure, {described('strict_accuracy')} FROM accounts UNION ALL SELECT 'parsed', {described('parsed_accuracy')} FROM accounts UNION ALL SELECT 'lenient', {described('lenient_accuracy')} FROM accounts""",
}
