"""DuckDB SQL for the queries of this subpackage that SQL can express.

``op2`` (keyed permutations), ``op4``, ``op7`` and ``op9`` (public tokenizers),
``op6`` (a learnt model) and ``pipeline`` are beyond
it; tests hold them against brute force.
"""

from __future__ import annotations

from .line_cleaning import BOILERPLATE, LineRules

_RULES = LineRules()

OP1 = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h,
    CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size
  FROM documents
), keyed AS (
  SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST RANGE UNBOUNDED PRECEDING) - sum(size) OVER (PARTITION BY h, doc_id) AS before,
    sum(size) OVER () AS total
  FROM d
), placed AS (
  SELECT *, CAST(before * 8 // total AS INTEGER) AS shard FROM keyed
)
SELECT doc_id, size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(t)), lambda i: CAST('0x' || substr(hex(t), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32,
  'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM placed, crc
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT r, i, words[i:i + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), hit AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), lines AS (
  SELECT r, ln, regexp_extract_all(ln, '[^\x20\x09-\x0D]+') AS words, pos
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
), judged AS (
  SELECT r, list_sum(list_transform(words, lambda w: strlen(w))) AS size, len(words) AS n,
    row_number() OVER (PARTITION BY r, ln ORDER BY pos) > 1
    OR strlen(regexp_replace(ln, '[^#*$%&<>{{}}\[\]=~^\\]', '', 'g')) > CAST({_RULES.max_symbols} AS DOUBLE) * len(words)
    OR len(words) >= {_RULES.min_words} AND (
      len(list_filter(words, lambda w: suffix(w, '!') OR suffix(w, '?'))) > CAST({_RULES.max_bangs} AS DOUBLE) * len(words)
      OR len(list_filter(words, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) > CAST({_RULES.max_upper} AS DOUBLE) * len(words))
    OR len(list_filter(words, lambda w: w IN ('|', '>', '»'))) > CAST({_RULES.max_bars} AS DOUBLE) * len(words)
    OR len(list_filter(words, lambda w: prefix(w, 'http://') OR prefix(w, 'https://') OR prefix(w, 'www.'))) > CAST({_RULES.max_links} AS DOUBLE) * len(words)
    OR len(words) >= 8 AND list_max(map_values(list_aggregate(words, 'histogram'))) > CAST({_RULES.max_same} AS DOUBLE) * len(words)
    OR regexp_matches(lower(ln), '{"|".join(BOILERPLATE)}') AS gone
  FROM lines WHERE len(words) > 0
), loss AS (
  SELECT r, sum(size) AS before, coalesce(sum(size) FILTER (WHERE NOT gone), 0) AS after FROM judged GROUP BY r
), based AS (
  SELECT doc_id, r, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS with_words,
    len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS different,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN hit USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(with_words - different AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < {_RULES.min_doc_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_RULES.min_doc_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words)
    AND coalesce(after, 0) >= CAST({_RULES.min_kept} AS DOUBLE) * coalesce(before, 0) AS kept,
  CAST(coalesce(before, 0) - coalesce(after, 0) AS BIGINT) AS removed_bytes
FROM based LEFT JOIN loss USING (r)
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(words[i:i + 3], ' ') AS s
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 0) + 2)) AS i FROM d WHERE len(words) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON c.a = x.r JOIN sizes y ON c.b = y.r WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), ends AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT r AS a, r AS b FROM d
  UNION
  SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (r) JOIN (SELECT a, min(o.doc_id) AS component_id FROM reach JOIN d o ON reach.b = o.r GROUP BY 1) c ON d.r = c.a
"""

_OP8_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_OP8_WORDS} AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, words[i:i + least(len(words), 10) - 1] AS w
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM items WHERE len(words) > 0)
), docs AS (
  SELECT doc_id, row_number() OVER () AS r, {_OP8_WORDS} AS words FROM documents
), spans AS (
  SELECT r, i, n, words[i:i + n - 1] AS w
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)
), found AS (
  SELECT r, i, n, item FROM spans JOIN windows USING (n, w)
), covered AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# a tree's levels are lists of nodes; what stands beside a node is at the position that differs in the last bit
OP11 = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS other,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT))),
      lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0 AS hit
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d
), levels AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM leaves GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM levels WHERE len(nodes) > 1
), subroots AS (
  SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM levels WHERE len(nodes) = 1
), upper AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM upper WHERE len(nodes) > 1
), inner_steps AS (
  SELECT l.tree, l.idx, v.level, coalesce(v.nodes[xor(l.idx >> v.level, 1) + 1], '') AS beside, (l.idx >> v.level) & 1 AS is_right
  FROM leaves l JOIN levels v ON l.tree = v.tree WHERE len(v.nodes) > 1
), upper_steps AS (
  SELECT s.tree, v.level, coalesce(v.nodes[xor(s.pos >> v.level, 1) + 1], '') AS beside, (s.pos >> v.level) & 1 AS is_right FROM subroots s, upper v WHERE len(v.nodes) > 1
), paths AS (
  SELECT l.tree, l.idx,
    coalesce((SELECT list(struct_pack(b := beside, r := is_right) ORDER BY level) FROM inner_steps i WHERE i.tree = l.tree AND i.idx = l.idx), [])
    || coalesce((SELECT list(struct_pack(b := beside, r := is_right) ORDER BY level) FROM upper_steps u WHERE u.tree = l.tree), []) AS path
  FROM leaves l
), whole AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM upper WHERE len(nodes) = 1) AS root, path,
    CASE WHEN hit THEN other ELSE leaf END AS start
  FROM leaves JOIN subroots USING (tree) JOIN paths USING (tree, idx)
), proved AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.b), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(b := start, r := CAST(0 AS BIGINT)), path),
      lambda z, s: struct_pack(b := sha256(CASE WHEN s.r = 1 THEN s.b || z.b ELSE z.b || s.b END), r := CAST(0 AS BIGINT))).b AS folded_root
  FROM whole
)
SELECT *, folded_root = root AS verified FROM proved
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT g.lang, g.source, k.term, k.n AS of_lang, count(w.r) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL
), parts AS (
  SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (of_lang + 5) // (total + 5 * v) AS BIGINT) AS q
  FROM counts JOIN langs USING (lang)
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce((
    SELECT sum(abs(x.p - y.p)) FROM parts x JOIN parts y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = g.lang AND x.source = g.source AND y.source = o.source), 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
), more AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM parts WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM more) WHERE rank <= 50
"""

OP13 = (
    OP5.replace("words[i:i + 3]", "words[i:i + 1]").replace("greatest(len(words) - 4, 0)", "greatest(len(words) - 2, 0)").replace(">= 85 *", ">= 80 *")
    .replace("component_id\nFROM", "component_id, doc_id = component_id AS kept\nFROM")
)


def _plain(x: str) -> str:
    return f"replace(replace({x}, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')"


OP10 = """
WITH chats AS (
  SELECT conv_id, list((role, text) ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, k, len(turns) AS n,
    list_reduce(list_prepend('', list_transform(turns[1:k], lambda t: hex(t[1]) || chr(31) || t[2])), lambda c, t: sha256(c || chr(31) || t)) AS chain
  FROM (SELECT conv_id, turns, unnest(range(1, len(turns) + 1)) AS k FROM chats)
), whole AS (
  SELECT chain, min(conv_id) AS conv_id, min(n) AS n FROM prefixes WHERE k = n GROUP BY chain
)
SELECT w.conv_id, CAST(n AS INTEGER) AS n_turns, chain,
  list_aggregate(list_transform(turns, lambda t: '<|im_start|>' || {t1} || chr(10) || {t2} || '<|im_end|>' || chr(10)), 'string_agg', '') AS text
FROM whole w JOIN chats c ON w.conv_id = c.conv_id
WHERE chain NOT IN (SELECT chain FROM prefixes WHERE k < n)
""".format(t1=_plain("t[1]"), t2=_plain("t[2]"))

ORACLES = {"op1_histogram_shards": OP1, "op3_line_cleaning": OP3, "op5_signature_join": OP5, "op8_decontamination": OP8, "op10_chat_snapshots": OP10, "op11_merkle_manifest": OP11, "op12_source_divergence": OP12, "op13_bayes_minhash": OP13}
