"""SQL twins of the queries of this subpackage, for DuckDB.

Left out: BPE, token files, the fitted toxicity model and the approximate search, which SQL can't express, and mixing, whose
bisected exponent would have to agree to the last bit. Tests compare those with brute force.
"""

from __future__ import annotations

from rateweave.llm import licences, quality, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "[\\x20\\x09-\\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lower_ascii(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def words(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '{BLANKS}'), lambda w: w <> '')"


def op2_minhash() -> str:
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, {words(lower_ascii("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM docs
),
single AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.other, s.doc_id)) AS kept
FROM sets s LEFT JOIN least l ON s.doc_id = l.doc_id
"""


def op5_warc() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
d AS (SELECT page_id, n, sha1(payload) AS digest, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS winner FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  nullif(winner, page_id) AS refers_to
FROM d
"""


def op7_url_filter() -> str:
    u, rules = url_filter, sorted(url_filter.RULES, key=lambda r: (-len(r.name), -len(r.host), r.name))

    def fits(r):
        return f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)})"

    name = "CASE " + " ".join(f"WHEN {fits(r)} THEN {quoted(r.name)}" for r in rules) + " END"
    label = "CASE " + " ".join(f"WHEN {fits(r)} THEN {quoted(r.verdict)}" for r in rules) + " END"
    held = ", ".join(map(quoted, u.HELD_OUT))
    levels = []
    for k in range(u.ORDER + 1):
        shorter = f"JOIN p{k - 1} q ON q.gram = right(l.gram, {k})" if k else ""
        q = {c: f"q.q_{c}" if k else f"{1.0 / u.ALPHABET!r}::DOUBLE" for c in "ab"}
        p = ", ".join(
            f"CASE WHEN seen_{c} = 0 THEN {q[c]} ELSE (n_{c} + kinds_{c} * {q[c]}) / (seen_{c} + kinds_{c}) END AS q_{c}" for c in "ab"
        )
        levels.append(f"""
l{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b FROM counted GROUP BY 1),
c{k} AS (SELECT left(gram, {k}) AS context, sum(n_a)::BIGINT AS seen_a, sum(n_b)::BIGINT AS seen_b,
  count(*) FILTER (n_a > 0) AS kinds_a, count(*) FILTER (n_b > 0) AS kinds_b FROM l{k} GROUP BY 1),
p{k} AS (SELECT l.gram, {p} FROM l{k} l JOIN c{k} c ON c.context = left(l.gram, {k}) {shorter})""")
    return f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rests),
placed AS (SELECT page_id, {lower_ascii('h')} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut),
judged AS (SELECT *, host || path AS text, {name} AS rule, {label} AS label FROM placed),
texts AS (SELECT DISTINCT text, label, substr(md5(text), 1, 1) IN ({held}) AS held_out FROM judged),
grams AS (
  SELECT text, label, held_out, unnest(list_transform(range(1, length(text) + 2),
    lambda i: substr(repeat(chr(2), {u.ORDER}) || text || chr(3), i, {u.ORDER + 1}))) AS gram FROM texts
),
counted AS (
  SELECT gram, count(*) FILTER (label = 'allow' AND NOT held_out) AS n_a, count(*) FILTER (label = 'block' AND NOT held_out) AS n_b
  FROM grams GROUP BY 1
),{",".join(levels)},
ratios AS (SELECT gram, round(ln(q_a / q_b) * 1e6)::BIGINT AS ratio FROM p{u.ORDER}),
summed AS (SELECT text, any_value(label) AS label, any_value(held_out) AS held_out, sum(ratio)::BIGINT AS total FROM grams JOIN ratios USING (gram) GROUP BY 1),
scored AS (SELECT *, trunc(total / (length(text) + 1))::BIGINT AS score FROM summed),
bins AS (
  SELECT floor(score / 10000.0)::BIGINT AS bin, count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label = 'block') AS b
  FROM scored WHERE held_out AND label IS NOT NULL GROUP BY 1
),
rated AS (
  SELECT bin, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b,
    coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a_below,
    coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_below FROM bins
),
best AS (
  SELECT bin FROM rated WHERE all_a > 0 AND all_b > 0
  ORDER BY (all_a - a_below) * all_b + b_below * all_a DESC, abs(bin), bin LIMIT 1
)
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.label, CASE WHEN floor(s.score / 10000.0) >= coalesce((SELECT bin FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict,
  s.score / 1e6 AS score
FROM judged j LEFT JOIN scored s ON s.text = j.text
"""


def op8_licences() -> str:
    def cut(column: str) -> str:
        return f"list_filter(string_split(regexp_replace({lower_ascii(column)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"

    bigrams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    t = licences.THRESHOLD_PERCENT
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(licences.TEMPLATES))
    return f"""
WITH templates AS (
  SELECT template, licence, {bigrams} AS t
  FROM (SELECT template, licence, {cut('body')} AS w FROM (VALUES {values}) v(template, licence, body))
),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS unit FROM split
  UNION ALL SELECT doc_id, -1, text FROM split WHERE len(lines) > 1
),
coded AS (SELECT doc_id, line_no, {bigrams} AS o FROM (SELECT doc_id, line_no, {cut('unit')} AS w FROM units)),
compared AS (
  SELECT doc_id, line_no, licence, template, len(list_intersect(o, t)) AS shared, len(o) + len(t) AS total
  FROM coded JOIN templates ON {t} * len(t) <= {200 - t} * len(o) AND {t} * len(o) <= {200 - t} * len(t)
)
SELECT doc_id, line_no::INTEGER AS line_no, licence, template, shared::INTEGER AS shared, 2 * shared / total AS dice
FROM compared WHERE 200 * shared >= {t} * total
"""


def op9_quality() -> str:
    r = quality.Rules()
    stock = rf"\b(?:{'|'.join(quality.STOCK_PHRASES)})\b"
    dividers = ", ".join(map(quoted, sorted(quality.DIVIDERS)))
    n, w = "len(w)", "w"
    marks = f"len(list_filter({w}, lambda x: x IN ({dividers})))"
    fails = " OR ".join((
        f"len(list_filter({w}, lambda x: regexp_matches(x, '{quality.SYMBOL_RUN.pattern}'))) > {r.symbol_share} * {n}",
        f"({n} >= {r.unpunctuated_words} AND NOT regexp_matches(line, '{quality.PUNCTUATION.pattern}'))",
        f"({marks} >= {r.nav_items - 1} AND {n} - {marks} <= {r.nav_item_words} * ({marks} + 1))",
        f"({n} <= {r.stock_line_words} AND regexp_matches({lower_ascii('line')}, '{stock}'))",
        f"({n} >= {r.one_word_least} AND list_max(map_values(list_histogram({w}))) > {r.one_word_share} * {n})",
        f"({n} >= {r.one_word_least} AND len(list_filter(range(1, {n}), lambda i: {w}[i] = {w}[i + 1])) > {r.beside_share} * {n})",
    ))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT rid, doc_id, text, {words('text')} AS w FROM docs),
lines AS (
  SELECT rid, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM (SELECT rid, string_split(text, chr(10)) AS l FROM docs)
),
worded AS (SELECT * FROM (SELECT rid, no, line, {words('line')} AS w FROM lines) WHERE len(w) > 0),
rated AS (SELECT rid, w, row_number() OVER (PARTITION BY rid, line ORDER BY no) > 1 AS dup, ({fails}) AS fails FROM worded),
by_line AS (
  SELECT rid, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(len(w)) FILTER (dup OR fails), 0)::BIGINT AS lost FROM rated GROUP BY 1
),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS times FROM windows) WHERE times > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
counted AS (
  SELECT b.doc_id, len(b.w)::BIGINT AS n_words, length(array_to_string(b.w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(b.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(l.lost, 0)::BIGINT AS n_lost_words
  FROM base b LEFT JOIN by_line l USING (rid) LEFT JOIN repeated p USING (rid)
),
failed AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_lost_words <= {r.max_lost} * n_words AS kept FROM failed
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def op11_ranked_search() -> str:
    found = f"unnest(regexp_extract_all({lower_ascii('text')}, '{TERM}')) AS term"
    return f"""
WITH doc_terms AS (SELECT rid, doc_id, {found} FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
lengths AS (SELECT rid, count(*) AS n FROM doc_terms GROUP BY rid),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, {found} FROM benchmark WHERE item_id IS NOT NULL),
scores AS (
  SELECT a.item_id, t.doc_id, sum(w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + (50 * l.n * z.docs) // z.total))))::BIGINT AS score
  FROM asked a JOIN tf t USING (term) JOIN weights USING (term) JOIN lengths l USING (rid), totals z
  WHERE t.doc_id IS NOT NULL GROUP BY a.item_id, t.rid, t.doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""


def op12_line_dedup() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH lines AS (
  SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
keyed AS (SELECT *, {lower_ascii(f"trim(line, {blanks})")} AS line_key FROM lines),
common AS (
  SELECT line_key, max(doc_id) AS last_doc FROM keyed WHERE length(line_key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
  SELECT k.*, coalesce(c.line_key IS NOT NULL AND k.doc_id <> c.last_doc, false) AS gone FROM keyed k LEFT JOIN common c USING (line_key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""


def op13_merkle() -> str:
    """Trees as lists of nodes that shrink to a third; crc32 from its table of 256 remainders."""

    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        parts = (f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields)
        return f"sha256({' || '.join(parts)})"

    def grown(name: str, key: str) -> str:
        """Each tree's nodes by level, until one remains."""
        return f"""
{name} AS (
  SELECT {key}, 0 AS level, nodes FROM {name}_leaves
  UNION ALL
  SELECT {key}, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], '')))
  FROM {name} WHERE len(nodes) > 1
)"""

    def path(rank: str, name: str, key: str) -> str:
        """``before|after`` of each level, from the leaf up."""
        return f"""
SELECT l.{key}, l.{rank}, list(
  array_to_string(t.nodes[3 * (l.{rank} // (3 ** t.level)::BIGINT // 3) + 1:(l.{rank} // (3 ** t.level)::BIGINT)], '') || '|' ||
  array_to_string(t.nodes[(l.{rank} // (3 ** t.level)::BIGINT) + 2:3 * (l.{rank} // (3 ** t.level)::BIGINT // 3) + 3], '') ORDER BY t.level
) FILTER (len(t.nodes) > 1) AS path
FROM {name}_ranked l JOIN {name} t ON l.{key} IS NOT DISTINCT FROM t.{key} GROUP BY 1, 2"""

    cut = leaf("replace(text, chr(10), '')")
    return f"""
WITH RECURSIVE remainders(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM remainders WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS t FROM remainders WHERE k = 8),
tree_ranked AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1 AS rank,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) & 1 = 0 THEN {cut} ELSE {leaf('text')} END AS claimed
  FROM documents, crc
),
tree_leaves AS (SELECT source, list(leaf ORDER BY rank) AS nodes FROM tree_ranked GROUP BY source),
{grown('tree', 'source')},
subroots AS (SELECT source, nodes[1] AS subroot FROM tree WHERE len(nodes) = 1),
top_ranked AS (SELECT 1 AS one, source, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM subroots),
top_leaves AS (SELECT 1 AS one, list(subroot ORDER BY place) AS nodes FROM top_ranked),
{grown('top', 'one')},
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
paths AS ({path('rank', 'tree', 'source')}),
top_paths AS ({path('place', 'top', 'one')}),
proofs AS (
  SELECT l.doc_id, l.leaf, l.claimed, s.subroot, r.root, list_concat(coalesce(p.path, []), coalesce(u.path, [])) AS path
  FROM tree_ranked l JOIN paths p ON l.source IS NOT DISTINCT FROM p.source AND l.rank = p.rank
  JOIN top_ranked s ON l.source IS NOT DISTINCT FROM s.source JOIN top_paths u ON u.place = s.place, root r
),
folded AS (
  SELECT *, list_reduce(list_prepend(claimed, path), lambda node, p: sha256(replace(p, '|', node))) AS folded_root FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (op2_minhash, op5_warc, op7_url_filter, op8_licences, op9_quality, op11_ranked_search, op12_line_dedup, op13_merkle)}
