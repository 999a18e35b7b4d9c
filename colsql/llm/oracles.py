"""DuckDB SQL of those queries that SQL can express."""

import public_tokenizers

from . import spotsigs

_WORD = r"[^\x20\x09-\x0D]"

OP2_QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t),
pos AS (SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM m),
nxt AS (SELECT r, i, w, lead(w) OVER o AS a, lead(w, 2) OVER o AS b, lead(w, 3) OVER o AS c, lead(w, 4) OVER o AS d, lead(w, 5) OVER o AS e, lead(w, 6) OVER o AS f, lead(w, 7) OVER o AS g FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, a, b, c, d, e, f, g) AS n FROM nxt WHERE g IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM win, range(0, 8) AS o(k) WHERE n > 1 GROUP BY r),
stut AS (SELECT r, len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n FROM m),
s AS (SELECT m.r, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(lines) AS n_lines, stut.n AS n_stutters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
  FROM m JOIN stut ON m.r = stut.r LEFT JOIN rep ON m.r = rep.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words)
  OR 5 * n_stutters > n_words OR (2 * n_upper > n_upper + n_lower AND n_upper + n_lower > 0) OR 5 * n_shouts > n_words) AS kept FROM b"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spotsigs(words: str) -> str:
    """The signatures of a list of words, as in .spotsigs."""
    listed = "[" + ", ".join(f"'{a}'" for a in dict.fromkeys(spotsigs.ANCHORS)) + "]"
    spots = "[" + ", ".join(f"'{x}'" for x in spotsigs.SPOTS) + "]"

    def chains(is_anchor) -> str:
        content = f"list_filter({words}[i + 1:i + {spotsigs.REACH}], lambda x: NOT {is_anchor('x')})"
        return f"list_transform(list_filter(range(1, len({words}) + 1), lambda i: {is_anchor(f'{words}[i]')} AND len({content}) > 0), lambda i: left(md5({words}[i] || ' ' || array_to_string(({content})[1:{spotsigs.CHAIN}], ' ')), 8))"

    own, other = chains(lambda w: f"list_contains({listed}, {w})"), chains(lambda w: f"list_contains({spots}, left(md5({w}), 1))")
    whole = f"[left(md5(array_to_string(list_concat([''], {words}), ' ')), 8)]"
    return f"(CASE WHEN len({own}) > 0 THEN list_sort(list_distinct({own})) WHEN len({other}) > 0 THEN list_sort(list_distinct({other})) ELSE {whole} END)"


def _jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CAST({shared} AS DOUBLE) / (len({a}) + len({b}) - {shared})"


OP6_SPOTSIGS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM t),
e AS (SELECT *, left(text, n - n // 2) || left(next, n // 2) AS edited FROM p),
w AS (SELECT doc_id, n, edited, regexp_extract_all({_LOWER.format("text")}, '{_WORD}+') AS w0, regexp_extract_all({_LOWER.format("edited")}, '{_WORD}+') AS w1, regexp_extract_all({_LOWER.format("next")}, '{_WORD}+') AS w2 FROM e),
s AS (SELECT doc_id, n, edited, {_spotsigs("w0")} AS s0, {_spotsigs("w1")} AS s1, {_spotsigs("w2")} AS s2 FROM w)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s0, '') AS fingerprint, array_to_string(s1, '') AS edited_fingerprint,
  {_jaccard("s0", "s1")} AS near_edited, {_jaccard("s0", "s2")} AS near_next FROM s"""

#: Words and pieces as hex digits of their bytes, ! after the last byte of a word and of a piece that marks an end.
OP8_TOKEN_COUNTS = rf"""
WITH RECURSIVE b AS (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS plain FROM range(256) r(b)),
letters AS (SELECT CASE WHEN plain THEN chr(b::INT) ELSE chr((255 + row_number() OVER (PARTITION BY plain ORDER BY b))::INT) END AS letter, lower(printf('%02x', b)) AS hex FROM b),
file AS (SELECT unnest(json_keys(content, '$.model.vocab')) AS piece FROM read_text('{public_tokenizers.path("word_bpe_49k.json")}')),
body AS (SELECT DISTINCT piece, ends_with(piece, '</w>') AS marked, CASE WHEN ends_with(piece, '</w>') THEN left(piece, length(piece) - 4) ELSE piece END AS body FROM file),
spread AS (SELECT piece, marked, unnest(string_split(body, '')) AS letter, unnest(range(1, length(body) + 1)) AS i, length(body) AS n FROM body WHERE length(body) > 0),
pieces AS (SELECT DISTINCT string_agg(hex, '' ORDER BY i) || CASE WHEN any_value(marked) THEN '!' ELSE '' END AS p FROM spread JOIN letters USING (letter) GROUP BY piece HAVING count(*) = any_value(n)),
longest AS (SELECT max(length(p)) AS most FROM pieces),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}+') AS words FROM documents),
flat AS (SELECT r, unnest(words) AS w FROM d),
ws AS (SELECT w, lower(hex(encode(w))) || '!' AS h FROM (SELECT DISTINCT w FROM flat)),
spot AS (SELECT w, h, unnest(range(1, length(h), 2)) AS i FROM ws),
part AS (SELECT w, h, i, unnest(list_concat(range(2, least(length(h) - i, most + 1), 2), [length(h) - i + 1])) AS n FROM spot, longest WHERE i < length(h)),
found AS (SELECT w, i, max(n) AS n FROM part JOIN pieces ON p = substring(h, i::BIGINT, n::BIGINT) WHERE n % 2 = 1 OR substring(h, (i + n)::BIGINT, 1) <> '!' GROUP BY w, i),
walk(w, i, n) AS (SELECT w, 1::BIGINT, 0::BIGINT FROM ws UNION ALL SELECT walk.w, (walk.i + found.n)::BIGINT, walk.n + 1 FROM walk JOIN found ON walk.w = found.w AND walk.i = found.i),
cut AS (SELECT ws.w, max(walk.n) FILTER (walk.i > length(h)) AS n FROM ws JOIN walk ON ws.w = walk.w GROUP BY ws.w)
SELECT doc_id, len(words) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_tokens, CAST(coalesce(s.u, 0) AS BIGINT) AS n_unknown, CAST(coalesce(s.m, 0) AS BIGINT) AS longest
FROM d LEFT JOIN (SELECT r, sum(coalesce(n, 1)) AS n, count(*) FILTER (n IS NULL) AS u, max(coalesce(n, 1)) AS m FROM flat JOIN cut USING (w) GROUP BY r) s ON d.r = s.r"""

ORACLES: dict[str, str] = {"op2_quality": OP2_QUALITY, "op6_spotsigs": OP6_SPOTSIGS, "op8_token_counts": OP8_TOKEN_COUNTS}
