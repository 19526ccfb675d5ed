"""DuckDB SQL for the corpus queries that SQL can express: op1, op5, op7, op11 and op13."""

from __future__ import annotations

from . import merkle, pii, secret_scan



def _hits(kind: str, regex: str, group: int = 0) -> str:
    """One row for each match: its number, the gap before it, the match and a group of it."""
    regex = regex.replace("'", "''")
    return f"""
  SELECT rn, '{kind}' AS kind, i, length(g[i]) AS gap, h[i] AS hit, p[i] AS part
  FROM (SELECT rn, regexp_split_to_array(t, '{regex}') AS g, regexp_extract_all(t, '{regex}') AS h, regexp_extract_all(t, '{regex}', {group}) AS p
        FROM d WHERE regexp_matches(t, '{regex}')) x, LATERAL (SELECT unnest(generate_series(1, len(h))) AS i) y"""


_SPANS = """
located AS (
  SELECT rn, kind, i, hit, part, sum(gap + length(hit)) OVER (PARTITION BY rn, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop,
         stop - length(hit) AS start
  FROM hits)"""

_KINDS = "CASE kind " + " ".join(f"WHEN '{r.kind}' THEN {i}" for i, r in enumerate(secret_scan.RULES + secret_scan.MORE_RULES)) + " END"
_MORE = "".join(f" UNION ALL {_hits(r.kind, r.pattern, r.group)}" for r in secret_scan.MORE_RULES)

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({_hits('assign', secret_scan.RULES[0].pattern, 2)}
  UNION ALL {_hits('access', 'AKIA[A-Z0-9]+')}
  UNION ALL {_hits('hex', '[0-9a-f]+')}{_MORE}),{_SPANS},
kept AS (
  SELECT rn, kind, start, stop, {_KINDS} AS rank
  FROM located WHERE length(part) >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 WHEN 'hex' THEN 16 ELSE 1 END),
joined AS (
  SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < 3) AS base
  FROM kept GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (rn)
"""

_LUHN = """list_sum(list_transform(generate_series(1, length(n)), lambda j:
    CASE WHEN (length(n) - j) % 2 = 0 THEN n[j]::INT ELSE n[j]::INT * 2 - CASE WHEN n[j]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(b[5:] || b[1:4], ''), lambda c: ascii(c)::BIGINT)), lambda a, v:
    CASE WHEN v >= 65 THEN (a * 100 + v - 55) % 97 ELSE (a * 10 + v - 48) % 97 END) = 1"""

_USUAL = "CASE " + " ".join(f"WHEN t[i:i+1] IN ({', '.join(map(repr, names.split()))}) THEN {n}" for n, names in pii.IBAN_CHARS.items()) + " ELSE 0 END"
_RANK = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {i}" for i, k in enumerate(pii.KINDS)) + " END"
_NEAR = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN CASE WHEN regexp_matches(b, '{pii.near(k)}') THEN {0.5 + k.prior / 2} ELSE {k.prior} END" for k in pii.KINDS) + " END"

# Accounts: every place where one may start, every end that it may have.
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({_hits('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')}
  UNION ALL {_hits('ip', '[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)')}
  UNION ALL {_hits('card', '[0-9]([ -]?[0-9])+')}
  UNION ALL {_hits('phone', '[+][0-9][ ().0-9-]+[0-9]')}),{_SPANS},
clean AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS n FROM located),
base AS (
  SELECT rn, kind, start::BIGINT AS start, stop::BIGINT AS stop FROM clean WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(hit, '.'), lambda x: x::HUGEINT)) <= 255
    WHEN 'card' THEN CASE WHEN length(n) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END
    ELSE length(n) BETWEEN 8 AND 15 END),
begins AS (SELECT rn, t, i FROM (SELECT rn, t, unnest(generate_series(1, length(t))) AS i FROM d WHERE regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}}'))
  WHERE regexp_full_match(t[i:i+3], '[A-Z]{{2}}[0-9]{{2}}') AND NOT regexp_full_match(coalesce(t[i-1:i-1], ''), '[A-Z0-9]')),
ends AS (SELECT rn, i, n, {_USUAL} = length(b) AS usual FROM (SELECT *, substring(t, i, n) AS p, replace(substring(t, i, n), ' ', '') AS b FROM (SELECT *, unnest(generate_series(15, 68)) AS n FROM begins))
  WHERE length(p) = n AND regexp_full_match(p, '[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9])+') AND NOT regexp_full_match(t[i+n:i+n], '[A-Z0-9]')
    AND CASE WHEN length(b) BETWEEN 15 AND 34 THEN {_MOD97} ELSE false END),
accounts AS (SELECT rn, i, arg_max(n, ROW(usual, n)) AS n FROM ends GROUP BY rn, i),
apart AS (SELECT rn, i, n, max(i + n) OVER (PARTITION BY rn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM accounts),
kept AS (SELECT * FROM base UNION ALL SELECT rn, 'iban', i - 1, i - 1 + n FROM apart WHERE reach IS NULL OR reach <= i),
scored AS (SELECT *, {_RANK} AS rank, {_NEAR} AS score FROM (SELECT k.*, lower(substring(d.t, greatest(k.start - {pii.CONTEXT}, 0) + 1, least(k.start, {pii.CONTEXT}))) AS b FROM kept k JOIN d USING (rn))),
joined AS (
  SELECT rn, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card,
         count(*) FILTER (rank = 3) AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans,
         string_agg(printf('%.3f', score), ',' ORDER BY rank, start) AS scores,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (rank < 4) AS base
  FROM scored GROUP BY rn)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
       coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN joined USING (rn)
"""


def _tree(text: str) -> str:
    """A list with each paragraph's text, leaf hashes and hash."""
    paragraphs = f"regexp_extract_all({text}, '{merkle.PARAGRAPH}')"
    leaves = f"list_transform(regexp_extract_all(p, '{merkle.LEAF}'), lambda q: md5(q))"
    return f"list_transform({paragraphs}, lambda p: struct_pack(p := p, leaves := {leaves}, h := md5(array_to_string({leaves}, ''))))"


_LIKE = """CASE WHEN {a}.root = {b}.root THEN 1.0
     WHEN greatest(len(list_distinct({a}.leaves)), len(list_distinct({b}.leaves))) = 0 THEN 0.0
     ELSE round(least(len(list_intersect(list_distinct({a}.leaves), list_distinct({b}.leaves)))::DOUBLE / greatest(len(list_distinct({a}.leaves)), len(list_distinct({b}.leaves))),
       1 - 1::DOUBLE / (1 + greatest(len(list_distinct({a}.leaves)), len(list_distinct({b}.leaves))))), 6) END::DOUBLE"""


def _sections(tree: str) -> str:
    ends = f"trim(x.p, ' ') IN ('', chr(10), chr(13) || chr(10)) OR x.h[1] IN ({', '.join(repr(c) for c in merkle.CUT)})"
    joined = f"array_to_string(list_transform({tree}, lambda x: x.h || CASE WHEN {ends} THEN '|' ELSE '' END), '')"
    return f"list_transform(list_filter(string_split({joined}, '|'), lambda s: s <> ''), lambda s: md5(s))"


def _struct(name: str) -> str:
    leaves = f"flatten(list_transform({name}_tree, lambda x: x.leaves))"
    return f"struct_pack(root := sha256(array_to_string({name}s, '')), leaves := list_transform({leaves}, lambda h: h[1:{merkle.LEAF_DIGITS}]))"


# The place of an edit is found here by comparing all phrases in a row, without the tree.
OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, length(t) AS n, length(t) // 4 AS k,
             coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT *, left(t, n - k) || left(nt, k) AS et FROM o),
trees AS (SELECT *, {_tree('t')} AS o_tree, {_tree('et')} AS e_tree, {_tree('nt')} AS n_tree FROM e),
cut AS (SELECT *, {_sections('o_tree')} AS os, {_sections('e_tree')} AS es, {_sections('n_tree')} AS ns,
  flatten(list_transform(regexp_extract_all(t, '{merkle.PARAGRAPH}'), lambda p: regexp_extract_all(p, '{merkle.LEAF}'))) AS ot,
  flatten(list_transform(regexp_extract_all(et, '{merkle.PARAGRAPH}'), lambda p: regexp_extract_all(p, '{merkle.LEAF}'))) AS ett FROM trees),
made AS (SELECT *, {_struct('o')} AS a, {_struct('e')} AS b, {_struct('n')} AS c,
  list_filter(generate_series(1, least(len(ot), len(ett)) + 1), lambda i: i > least(len(ot), len(ett)) OR ot[i] <> ett[i])[1] AS place FROM cut)
SELECT doc_id, n::BIGINT AS n_chars, sha256(et) AS edited_sha256,
       a.root || ':' || array_to_string(list_transform(os, lambda h: h[1:{merkle.SECTION_DIGITS}]), '.') || ':' || array_to_string(a.leaves, '.') AS fingerprint,
       b.root || ':' || array_to_string(list_transform(es, lambda h: h[1:{merkle.SECTION_DIGITS}]), '.') || ':' || array_to_string(b.leaves, '.') AS edited_fingerprint,
       {_LIKE.format(a='a', b='b')} AS near_edited, {_LIKE.format(a='a', b='c')} AS near_next,
       len(list_distinct(list_filter(es, lambda s: NOT list_contains(os, s))))::BIGINT AS edit_sections,
       CASE WHEN t <> et THEN coalesce(list_sum(list_transform(ot[1:place - 1], lambda x: length(x))), 0)::BIGINT END AS edit_start
FROM made
"""

# Every phrase is counted directly here.
OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: w[i:i + k - 1])) AS g FROM words, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= 30),
held AS (SELECT lang, a, n, unnest(list_transform(generate_series(1, k - n + 1), lambda i: g[i:i + n - 1])) AS g FROM f, (VALUES (2), (3)) AS v(n) WHERE n < k),
longest AS (SELECT lang, g, max(a) AS longer FROM held GROUP BY lang, g),
kept AS (SELECT f.* FROM f LEFT JOIN longest USING (lang, g) WHERE k > 1 AND (longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)),
cuts AS (SELECT kept.lang, kept.k, kept.g, kept.a, c, x.a AS l, y.a AS r, (2000000::HUGEINT * kept.a // (x.a + y.a))::BIGINT AS score
  FROM kept, (VALUES (1), (2), (3)) AS v(c), f x, f y
  WHERE c < kept.k AND x.lang = kept.lang AND x.g = kept.g[1:c] AND y.lang = kept.lang AND y.g = kept.g[c + 1:kept.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

_FIELD = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR END"
_LEAF = lambda n: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", n, "text"))) + ")"
# DuckDB has no CRC-32: the remainders' table, folded over the id's digits.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(a >> 8, crcs[(xor(a, c) & 255) + 1]))"
_ROUNDS = "list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"

# Levels by recursion, each node with its group, place and the level's nodes; then each leaf's path, folded level by level.
OP13 = f"""
WITH RECURSIVE remainders AS (SELECT list({_ROUNDS} ORDER BY i) AS crcs FROM range(256) t(i)),
d AS (SELECT row_number() OVER () AS rn, *, {_LEAF('n_chars')} AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_LEAF('(n_chars + 1)')} ELSE {_LEAF('n_chars')} END AS changed FROM documents, remainders),
placed AS (SELECT *, coalesce('+' || lang, '-') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
inner_levels(grp, level, pos, n, h) AS (
  SELECT grp, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM inner_levels WHERE n > 1 GROUP BY grp, level, pos // 2, n),
subroots AS (SELECT grp, h AS subroot FROM inner_levels WHERE n = 1),
tops AS (SELECT grp, subroot, row_number() OVER (ORDER BY grp = '-' DESC, encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM subroots),
outer_levels(level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM outer_levels WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT rn, 0 AS part, i.level, p.pos >> i.level AS node, s.h AS sibling
  FROM placed p JOIN inner_levels i ON i.grp = p.grp AND i.pos = p.pos >> i.level AND i.n > 1
  LEFT JOIN inner_levels s ON s.grp = i.grp AND s.level = i.level AND s.pos = xor(i.pos, 1)
  UNION ALL
  SELECT rn, 1, o.level, t.pos >> o.level, s.h
  FROM placed p JOIN tops t USING (grp) JOIN outer_levels o ON o.pos = t.pos >> o.level AND o.n > 1
  LEFT JOIN outer_levels s ON s.level = o.level AND s.pos = xor(o.pos, 1)),
paths AS (SELECT rn, row_number() OVER (PARTITION BY rn ORDER BY part, level) AS i, node % 2 = 1 AS is_right, coalesce(sibling, '') AS sibling FROM steps),
proofs AS (SELECT rn, string_agg(sibling, '' ORDER BY i) AS proof, count(*) AS high FROM paths GROUP BY rn),
folded(rn, i, h) AS (
  SELECT rn, 0::BIGINT, changed FROM placed
  UNION ALL
  SELECT f.rn, f.i + 1, sha256(CASE WHEN is_right THEN sibling || h ELSE h || sibling END) FROM folded f JOIN paths p ON p.rn = f.rn AND p.i = f.i + 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed JOIN subroots USING (grp) LEFT JOIN proofs USING (rn) JOIN folded f ON f.rn = placed.rn AND f.i = coalesce(high, 0),
     (SELECT h AS root FROM outer_levels WHERE n = 1) r
"""

ORACLES = {"op1_secret_scan": OP1, "op5_merkle_fingerprints": OP5, "op7_pii": OP7, "op11_collocations": OP11, "op13_merkle_manifest": OP13}
