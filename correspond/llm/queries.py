"""The registered queries of this subpackage, and SQL for those that SQL can express."""

import functools

from correspond.llm import chat, decontaminate, imatch, language, mixing, pii, quality, resample, rules, search, simhash, tokens, urls

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality, pii.op2_pii, rules.op3_rules, chat.op4_chat, urls.op5_urls, simhash.op6_simhash, mixing.op7_mix, tokens.op8_token_output,
        decontaminate.op9_decontaminate, language.op10_language, search.op11_search, resample.op12_resample, imatch.op13_imatch,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(column: str) -> str:
    for plain, coded in chat.ESCAPES:
        column = f"replace({column}, '{plain}', '{coded}')"
    return column


_FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The remainders of the sixteen half bytes under the reflected polynomial of crc32.
_CRC_NIBBLES = [functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), n) for n in range(16)]

ORACLE_SQL = {
    "op3_rules": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT r, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS s FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*\z'))) AS n_open_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*([-*]|\x{2022})[\x20\x09]'))) AS n_listed_lines
  FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 50 * n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 2 * n_lettered < n_words OR 10 * n_open_lines > 3 * n_lines OR 10 * n_listed_lines > 9 * n_lines) AS kept
FROM b""",
    "op4_chat": f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn) AS said,
         coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS learnt,
         sum(length('{chat.TURN}{chat.TEXT}{chat.END}') + length({_escaped("role")}) + length({_escaped("t")}))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens FROM g""",
    "op5_urls": rf"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT h.*, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY r ORDER BY length(r_host) + length(r_path) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op9_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, i, x.n, item_id FROM x JOIN bw ON bw.n = x.n AND bw.s = x.s),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
runs AS (
  SELECT r, min(p) AS a, max(p) AS b FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits))
  GROUP BY r, run),
pieces AS (SELECT r, list_transform(regexp_extract_all(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: length(x)) AS l, w FROM d WHERE r IN (SELECT r FROM hits)),
spans AS (
  SELECT r, string_agg((list_sum(l[1:a]) - length(w[a]))::BIGINT || ':' || list_sum(l[1:b])::BIGINT, ',' ORDER BY a) AS spans FROM runs JOIN pieces USING (r) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r) LEFT JOIN spans USING (r)""",
    "op11_search": rf"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_FOLDED} AS w FROM documents) WHERE len(w) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (SELECT row_number() OVER () AS r, item_id, {_FOLDED} AS w FROM benchmark),
qt AS (SELECT r, t, count(*) AS times FROM (SELECT r, unnest(w) AS t FROM q) GROUP BY r, t),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT row_number() OVER () AS k, unnest(w) AS t FROM d) GROUP BY k, t),
own AS (SELECT row_number() OVER () AS k, doc_id, 25 + (75 * n * n_docs) // n_terms AS m, n_docs FROM d, whole),
tw AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, whole WHERE t IN (SELECT t FROM qt) GROUP BY t),
s AS (SELECT r, k, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM qt JOIN tw USING (t) JOIN p USING (t) JOIN own USING (k) GROUP BY r, k),
o AS (SELECT r, doc_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id) AS rank FROM s JOIN own USING (k) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o JOIN q USING (r) WHERE rank <= 10""",
    "op12_resample": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
terms AS (SELECT DISTINCT unnest(w) AS t FROM d UNION SELECT DISTINCT unnest({_FOLDED}) AS t FROM benchmark),
nibbles AS (SELECT t, list_transform(range(2 * octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), i + 2 * (1 - i % 2), 1))::BIGINT) AS b FROM terms),
-- crc32 by half bytes, the lower one first
crc AS (
  SELECT t, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 4, ([{", ".join(map(str, _CRC_NIBBLES))}])[1 + (xor(c, x) & 15)])), 4294967295) % {resample.BUCKETS} AS bucket
  FROM nibbles),
raw AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(w) AS t FROM d) JOIN crc USING (t) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM (SELECT unnest({_FOLDED}) AS t FROM benchmark) JOIN crc USING (t) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw)::BIGINT + {resample.BUCKETS} AS all_s, (SELECT coalesce(sum(t), 0) FROM target)::BIGINT + {resample.BUCKETS} AS all_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(target.t, 0) + 1) * all_s / ((s + 1) * all_t)))::BIGINT AS gain
  FROM raw LEFT JOIN target USING (bucket), sums),
heavy AS (SELECT r, sum(gain)::BIGINT AS weight FROM (SELECT r, unnest(w) AS t FROM d) JOIN crc USING (t) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN heavy USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {resample.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= ({resample.PERCENT} * n) // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (r)""",
}
