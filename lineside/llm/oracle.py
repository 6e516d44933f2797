"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


_REACH = """
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS MATERIALIZED (SELECT node, min(other) AS root FROM reach GROUP BY 1)"""

SUBSTRING = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_words('text')} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
hit AS MATERIALIZED (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
cut AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit),
word AS MATERIALIZED (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word LEFT JOIN cut USING (doc_id, p) WHERE cut.doc_id IS NULL GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""

VECTORS = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON node = vec_id"""

MINHASH = f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs),
cls AS MATERIALIZED (SELECT min(doc_id) AS rep, s FROM sets WHERE len(s) > 0 GROUP BY s),
inv AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS g FROM cls),
two AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM inv a JOIN inv b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM two UNION ALL SELECT b, a FROM two),{_REACH}
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(root, rep, doc_id) AS component_id, coalesce(root, rep, doc_id) = doc_id AS kept
FROM sets LEFT JOIN cls ON cls.s = sets.s LEFT JOIN comp ON node = rep"""


def _crc32(text: str) -> str:
    """The checksum of an ASCII text, eight shifts for each character."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), "
            "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)")


def _ways(ways: str, cost: str, step: str, line: str = "''") -> str:
    """Each of a list of ways (cost, audit, output) with one more edit."""
    return f"list_transform({ways}, lambda x: {{'c': x.c + {cost}, 'a': x.a || '{step}', 'o': x.o || {line}}})"


def _known(*states: str) -> str:
    return f"list_filter([{', '.join(states)}], lambda x: x.c IS NOT NULL)"


_KEEP, _AS_USER, _AS_ASSISTANT = "chr(10) || r.role || ':' || r.text", "chr(10) || 'user:' || r.text", "chr(10) || 'assistant:' || r.text"
_INTO_USER = f"list_concat({_known('w.u')}, {_ways(_known('w.e', 'w.s', 'w.v'), '5', 'I', 'chr(10) || ' + chr(39) + 'user:' + chr(39))})"
_INTO_ASSISTANT = f"list_concat({_known('w.v')}, {_ways(_known('w.u'), '5', 'I', 'chr(10) || ' + chr(39) + 'assistant:' + chr(39))})"
_BEFORE_USER = f"list_concat({_known('w.e', 'w.s')}, {_INTO_ASSISTANT})"

REPAIR = f"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS MATERIALIZED (SELECT *, {_crc32('k')} % 20 AS code FROM base),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS again FROM coded WHERE code <> 0),
told AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS two,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS MATERIALIZED (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS wrong FROM told),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS e, {{'c': NULL::INTEGER, 'a': '', 'o': ''}} AS s,
    {{'c': NULL::INTEGER, 'a': '', 'o': ''}} AS u, {{'c': NULL::INTEGER, 'a': '', 'o': ''}} AS v FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, r.i, list_min({_ways('[w.e]', '2', 'D')}),
    list_min(list_concat({_ways(_known('w.s'), '2', 'D')}, CASE WHEN r.ini = 's' AND r.wrong IN ('', 'truncated') THEN {_ways('[w.e]', "if(r.wrong = '', 0, 5)", 'K', _KEEP)} ELSE [] END)),
    list_min(list_concat(list_concat({_ways(_INTO_USER, '2', 'D')},
      CASE WHEN r.wrong IN ('', 'truncated') THEN {_ways(_BEFORE_USER, "if(r.wrong = '', 1, 6)", 'R', _AS_USER)} ELSE [] END),
      CASE WHEN r.ini = 'u' AND r.wrong IN ('', 'truncated') THEN {_ways(_BEFORE_USER, "if(r.wrong = '', 0, 5)", 'K', _KEEP)} ELSE [] END)),
    list_min(list_concat(list_concat({_ways(_INTO_ASSISTANT, '2', 'D')},
      CASE WHEN r.wrong IN ('', 'truncated') THEN {_ways(_INTO_USER, "if(r.wrong = '', 1, 6)", 'R', _AS_ASSISTANT)} ELSE [] END),
      CASE WHEN r.ini = 'a' AND r.wrong IN ('', 'truncated') THEN {_ways(_INTO_USER, "if(r.wrong = '', 0, 5)", 'K', _KEEP)} ELSE [] END))
  FROM walk w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
ended AS (SELECT conv_id, list_min(list_concat({_known('w.e', 'w.v')}, {_ways(_known('w.u'), '5', 'I', 'chr(10) || ' + chr(39) + 'assistant:' + chr(39))})) AS z
  FROM walk w WHERE i = (SELECT count(*) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM w.conv_id)),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (wrong = 'blank') AS blank,
  count(*) FILTER (wrong = 'duplicate') AS duplicate, count(*) FILTER (wrong = 'truncated') AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, z.c::BIGINT AS cost, z.a AS audit, sha256(substr(z.o, 2)) AS repaired_sha256
FROM ended LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM ended.conv_id"""

_MARKED = r"\### Assistant: </turn> ok"


def _escaped(text: str, more: str = "") -> str:
    return rf"regexp_replace({text}, '(\\|### |</turn>{more})', '\\\1', 'g')"


CHAT = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_MARKED}'), (-7, 1, 'assistant', '{_MARKED}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped('role', '|:')}) + length({_escaped('text')}) + 14)::BIGINT AS formatted_chars
FROM turns GROUP BY 1"""

ORACLE = {
    "op1_substring_dedup": SUBSTRING, "op7_embedding_dedup": VECTORS, "op8_minhash_dedup": MINHASH,
    "op11_conversation_repair": REPAIR, "op12_chat_formatting": CHAT,
}
