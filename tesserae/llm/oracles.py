"""SQL of the queries that DuckDB can express over the same tables."""

_TOP_K = """
WITH codes AS (
    SELECT vec_id AS id, list_reduce(list_concat([0::HUGEINT], list_transform(embedding, lambda x: (CASE WHEN x > 0 THEN 1 ELSE 0 END)::HUGEINT)), lambda s, x: s * 2 + x) AS code
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
near AS (
    SELECT q.id AS query, c.id AS neighbor, bit_count(xor(q.code, c.code))::INTEGER AS distance
    FROM codes q, codes c WHERE q.id % 50 = 0 AND q.id <> c.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor)::INTEGER AS rank FROM near)
SELECT query, rank, neighbor, distance FROM ranked WHERE rank <= 10
"""

_SHINGLES = r"""list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)"""
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LEAKS = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents)),
i AS (SELECT item_id, len(list) AS n, unnest(list) AS s FROM (SELECT item_id, {_SHINGLES} AS list FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))),
m AS (SELECT doc_id, item_id, count(*)::BIGINT AS shared, any_value(n)::BIGINT AS shingles FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, shingles, shared::DOUBLE / shingles AS containment FROM m WHERE shared >= 0.8 * shingles - 1e-9
"""

_ESCAPED = r"""regexp_replace({x}, '([<\[])(\\*)(\|[a-z_]{{1,20}}\|>|/?s>|</?SYS>>|/?INST\])', '\1\2\\\3', 'g')"""
_CHAT = rf"""
WITH t AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
    sum(8 + 8 + 7 + length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES = {"op1_chat_formatting": _CHAT, "op4_top_k": _TOP_K, "op8_decontamination": _LEAKS}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_scan() -> str:
    """Gaps and matches in turn, as in the operator; their lengths add up to the places."""
    from .secrets import BASE, RULES

    found, spans = [], []
    for k, r in enumerate(RULES):
        whole = _quoted(f"(?s)(.*?)({r.pattern})")
        found.append(f"regexp_extract_all(t, {whole}, 1) AS g{k}, regexp_extract_all(t, {whole}, 2) AS m{k}")
        start = f"(list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0))::BIGINT"
        spans.append(f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: length(regexp_extract(m{k}[i], {_quoted(r.pattern)}, {r.value})) >= {r.least}), lambda i: {{'s': {start}, 'o': {k}, 'k': '{r.kind}', 'e': {start} + length(m{k}[i])}})")
    said = lambda x: f"array_to_string(list_transform({x}, lambda s: s.k || ':' || s.s || ':' || s.e), ',')"
    base = f"list_filter(a, lambda s: s.o < {len(BASE)})"
    of = ", ".join(f"len(list_filter(a, lambda s: s.k = '{k}'))::BIGINT AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH f AS (SELECT doc_id, {", ".join(found)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
s AS (SELECT doc_id, list_sort(list_concat({", ".join(spans)})) AS a FROM f)
SELECT doc_id, {of}, sha256({said(base)}) AS base_sha256, {said("a")} AS spans FROM s
"""


def _license_scan() -> str:
    """Letters past ASCII become Z, so that word bounds are ASCII ones; suppression looks at the furthest end so far."""
    from .licenses import BASE, SIGNATURES

    rules = ", ".join(f"({_quoted(s.label)}, {_quoted(s.keyword)}, {_quoted('(.*?)(' + chr(92) + 'b(?:' + s.pattern + ')' + chr(92) + 'b)')}, {s.priority})" for s in SIGNATURES)
    base = _quoted("(.*?)(\\b(?:" + "|".join(BASE) + ")\\b)")
    starts = "list_transform(range(1, len(m) + 1), lambda i: {'s': (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT, 'n': length(m[i])::BIGINT, 'm': m[i]})"
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    label = " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in BASE.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), '[^ -~]', 'Z', 'g') AS w FROM documents),
rules(label, keyword, pattern, priority) AS (VALUES {rules}),
hit AS (SELECT r, w, label, priority, unnest({starts}) AS x FROM (SELECT r, w, label, priority, regexp_extract_all(w, pattern, 1) AS g, regexp_extract_all(w, pattern, 2) AS m FROM d JOIN rules ON contains(w, keyword))),
one AS (SELECT r, label, priority, x.s AS s, x.s + x.n AS e, {spaces("x.m")} + 1 AS words, row_number() OVER (PARTITION BY r ORDER BY x.s, x.n DESC, priority DESC, label) AS n FROM hit),
seen AS (SELECT *, coalesce(max(e) OVER b, -1) AS far, coalesce(arg_max(priority, e * 1000000 - n) OVER b, -1) AS first_priority FROM one WINDOW b AS (PARTITION BY r ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT r, list(label) AS labels, sum(words)::BIGINT AS covered FROM seen WHERE NOT (e <= far AND priority <= first_priority) GROUP BY r),
based AS (SELECT r, w, unnest({starts}) AS x FROM (SELECT r, w, regexp_extract_all(w, {base}, 1) AS g, regexp_extract_all(w, {base}, 2) AS m FROM d)),
b AS (SELECT r, count(*) AS n, min({spaces("substring(w, 1, x.s::INTEGER)")}) AS low, max({spaces("substring(w, 1, x.s::INTEGER)")}) AS high, list_sort(list(DISTINCT CASE x.m {label} END)) AS labels FROM based GROUP BY r),
j AS (SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE {spaces("w")} + 1 END::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, low, high, coalesce(b.labels, []) AS bl, coalesce(kept.labels, []) AS kl, coalesce(covered, 0) AS covered FROM d LEFT JOIN b USING (r) LEFT JOIN kept USING (r))
SELECT doc_id, n_words, n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, array_to_string(bl, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, kl))), ',') AS labels, least(1.0::DOUBLE, covered / greatest(n_words, 1)) AS score FROM j
"""


ORACLES |= {"op5_secret_scan": _secret_scan(), "op7_license_scan": _license_scan()}
