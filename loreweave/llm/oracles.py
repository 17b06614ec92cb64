"""DuckDB SQL for the dealt operators that SQL can express."""

from __future__ import annotations

from .licenses import RULES, SENTENCES, _wildcard, normal_sentence
from .quality import STOP_WORDS

_CODES = r"replace(replace(replace(replace({0}, '\', '\e'), '###', '\h'), '</turn>', '\t'), '<same/>', '\s')"

CHAT = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
    SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length({_CODES.format('text')}) + CASE WHEN same THEN 7 ELSE 14 + length({_CODES.format('role')}) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""


def _draw(shard: int) -> str:
    return f"(('0x' || substr(md5(k || ':{shard // 4}'), {8 * (shard % 4) + 1}, 8))::BIGINT)"


# The checksum's table follows from its polynomial, the register is folded over the bytes.
SHARDS = f"""
WITH bits AS (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda x: 0::BIGINT), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i)
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits),
docs AS (
    SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
    SELECT doc_id, k, length(h) // 2 + 1 AS size,
        list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM docs
), sized AS (
    SELECT doc_id, k, size, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32
    FROM bytes, crc
), drawn AS (SELECT *, [{', '.join(_draw(s) for s in range(16))}] AS d, {_draw(16)} AS more FROM sized),
chosen AS (
    SELECT doc_id, k, size, text_crc32, CAST(list_position(d, list_max(d)) - 1 AS INTEGER) AS shard, more > list_max(d) AS moves,
        (('0x' || substr(md5(concat_ws(':', k, size, text_crc32)), 1, 8))::BIGINT) % (SELECT greatest(64, (count(*) + 799999) // 800000) FROM documents) AS part
    FROM drawn
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, size, text_crc32) - 1 AS slot,
    CASE WHEN moves THEN 16 ELSE shard END AS grown_shard
FROM chosen"""

_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop FROM (
        SELECT doc_id, m, v, CAST(sum(length(a)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (
            SELECT doc_id, unnest(f) AS m, unnest(vs) AS v, unnest(parts[:len(f)]) AS a, unnest(range(len(f))) AS i
            FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS f, regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS parts FROM docs)
        ) WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    ) WHERE length(v) >= {least}"""


SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans('assign', 0, _ASSIGN, 1, 6)} UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_spans('hex', 2, '[0-9a-f]+', 0, 24)}),
per AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s
    FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM docs d LEFT JOIN per USING (doc_id)"""

_STOPS = ", ".join(f"'{w}', '{w[0].upper() + w[1:]}'" for w in sorted(set(STOP_WORDS.split())))

QUALITY = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
), windows AS (
    SELECT doc_id, unnest(range(len(w) - 2)) AS i, unnest(list_transform(range(len(w) - 2), lambda x: w[x + 1] || ' ' || w[x + 2] || ' ' || w[x + 3])) AS s FROM docs WHERE len(w) >= 3
), again AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY doc_id),
counts AS (
    SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
    FROM docs LEFT JOIN covered USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND n_words <= 100000 AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND n_symbols <= 0.1 * n_words
    AND n_stop_words >= 0.06 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_bullet_lines <= 0.9 * n_lines AND n_ellipsis_lines <= 0.3 * n_lines AS kept
FROM judged"""

def _licences() -> str:
    """No cuts here: the known sentences are searched for in the normalised text, longer ones first."""
    known = sorted(((_wildcard(v) if "{}" in v else normal_sentence(v), k) for k, v in SENTENCES.items()), key=lambda x: (-len(x[0]), x[0]))
    plain = ", ".join(f"('{v}', '{k}')" for v, k in known if "[" not in v)
    open_ = "".join(f" WHEN regexp_full_match(f, '{v}') THEN '{k}'" for v, k in known if "[" in v)
    pattern = r"\b(?:" + "|".join(v for v, _ in known) + r")\b"
    steps, last = [], "read"
    for k, r in enumerate(RULES):
        steps.append(f"r{k} AS (SELECT doc_id, identifiers, regexp_replace(rest, '{r.pattern}', '<?>', 'g') AS rest, CASE WHEN regexp_matches(rest, '{r.pattern}') AND NOT list_contains(found, '{r.licence}') THEN list_append(found, '{r.licence}') ELSE found END AS found FROM {last})")
        last = f"r{k}"
    count = "len(regexp_extract_all({0}, '<[^?>]'))"
    return rf"""
WITH known(norm, id) AS (VALUES {plain}),
docs AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents),
hits AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS fs, string_split_regex(t, '{pattern}') AS gaps FROM docs WHERE regexp_matches(t, '{pattern}')),
each AS (SELECT doc_id, len(gaps) AS n, unnest(gaps) AS gap, unnest(list_append(fs, NULL)) AS f, unnest(range(len(gaps))) AS i FROM hits),
named AS (SELECT doc_id, string_agg(CASE WHEN trim(gap) <> '' THEN '<?>' ELSE '' END || coalesce('<' || coalesce(id, CASE{open_} END) || '>', ''), '' ORDER BY i) AS ids FROM each LEFT JOIN known ON f = norm GROUP BY doc_id),
read AS (SELECT d.doc_id, coalesce(ids, '') AS identifiers, coalesce(ids, '') AS rest, CAST([] AS VARCHAR[]) AS found FROM documents d LEFT JOIN named USING (doc_id)),
{', '.join(steps)}
SELECT doc_id, identifiers, array_to_string(found, ',') AS licences, {count.format('identifiers')} AS n_known, {count.format('rest')} AS n_left FROM {last}"""


REVISITS = r"""
WITH cut AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM pages),
parts AS (
    SELECT *, regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^www\.|:(?:80|443)$', '', 'g') || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
        regexp_replace(regexp_replace(regexp_extract(r, '\?(.*)$', 1), '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS q
    FROM cut
),
named AS (SELECT page_id, md5(html) AS tag, sha1(html) AS sha, octet_length(encode(html)) AS n, page || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM parts),
joined AS (
    SELECT 2 * v.page_id + 1 AS record_id, v.canonical, v.tag AS mine, f.*
    FROM named v ASOF LEFT JOIN (SELECT page_id AS page, canonical AS c, tag, sha, n FROM named) f ON v.canonical = f.c AND v.page_id + 6000 > f.page
)
SELECT record_id, canonical, CASE WHEN page IS NULL THEN 'no response' WHEN mine <> tag THEN 'validators differ' ELSE 'resolved' END AS verdict,
    CASE WHEN mine = tag THEN 2 * page END AS response_id, CASE WHEN mine = tag THEN sha END AS payload_digest,
    CASE WHEN mine = tag THEN 'cache-control: max-age=600; content-length: ' || n || '; content-type: text/html; etag: W/' || mine END AS headers
FROM joined"""

DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
each AS (SELECT r, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS ln FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(ln) AS lt FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, k.ln, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
    FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS t FROM dense GROUP BY ALL),
ps AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (t + 5 * v) AS p, 1 + (1000000000 * (ln + 5)) // (lt + 5 * v) AS q
    FROM dense JOIN totals USING (lang, source) JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM ps x JOIN ps y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
        ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM ps WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

TRIE = r"""
WITH bits AS (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda x: 0::BIGINT), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i)
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits),
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), counted AS (SELECT conv_id, count(*) AS own FROM turns GROUP BY conv_id),
hashed AS (
    SELECT conv_id, own, conv_id - conv_id % 5 AS base,
        xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295) % 9 AS h
    FROM counted, crc
), convs AS (SELECT a.conv_id, a.own, a.base, a.h, least(a.h, coalesce(b.own, 0)) AS given FROM hashed a LEFT JOIN counted b ON b.conv_id = a.base),
rebuilt AS (
    SELECT c.conv_id, t.place + 1 AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.given
    UNION ALL SELECT c.conv_id, given + place - h + 1, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= h
), lengths AS (SELECT conv_id, given + greatest(own - h, 0) AS length FROM convs),
paths AS (
    SELECT conv_id, 0 AS depth, '' AS node, '' AS parent, 0 AS size FROM convs
    UNION ALL
    SELECT r.conv_id, r.depth, sha256(string_agg(length(p.role) || ':' || p.role || length(p.text) || ':' || p.text, '' ORDER BY p.depth)),
        CASE WHEN r.depth = 1 THEN '' ELSE sha256(string_agg(length(p.role) || ':' || p.role || length(p.text) || ':' || p.text, '' ORDER BY p.depth) FILTER (p.depth < r.depth)) END,
        any_value(octet_length(encode(r.text)))
    FROM rebuilt r JOIN rebuilt p ON p.conv_id = r.conv_id AND p.depth <= r.depth GROUP BY r.conv_id, r.depth
), nodes AS (SELECT node, min(depth) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved FROM paths GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, d.node FROM paths a JOIN paths d ON d.conv_id = a.conv_id AND d.depth >= a.depth),
sums AS (SELECT top, count(*) FILTER (c.n IS NULL) AS n_leaves, sum(saved) AS saved_tokens FROM below JOIN nodes USING (node) LEFT JOIN children c USING (node) GROUP BY top),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths JOIN lengths USING (conv_id) WHERE depth = length GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node LEFT JOIN nodes p ON p.node = n.parent AND n.depth > 0 LEFT JOIN children c ON c.node = n.node LEFT JOIN ends e ON e.node = n.node"""

ORACLES = {
    "op1_chat_format": CHAT.strip(),
    "op2_rendezvous_shards": SHARDS.strip(),
    "op4_license_scan": _licences().strip(),
    "op5_secret_scan": SECRETS.strip(),
    "op8_warc_revisits": REVISITS.strip(),
    "op9_quality_rules": QUALITY.strip(),
    "op11_source_divergence": DIVERGENCE.strip(),
    "op13_prefix_trie": TRIE.strip(),
}
