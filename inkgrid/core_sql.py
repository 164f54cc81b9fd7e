"""The same results in SQL, for the comparison with an independent engine."""

from __future__ import annotations

_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPLIT_TIME = "2030-05-01 00:00:00+00"


def nf(x: str) -> str:
    """Compatibility composition of the characters that the texts have."""
    return f"replace(replace(replace(translate({x}, '\u00a0！（，）：？', ' !(,):?'), '…', '...'), 'º', 'o'), 'ำ', 'ํา')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def coll(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def ctrl(x: str) -> str:
    return f"regexp_replace({x}, '[\\x00-\\x08\\x0b-\\x1f\\x{{7f}}-\\x{{9f}}]', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


def drop_blank(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {coll('l')}), lambda l: l <> ''), chr(10))"


def dehyphen(x: str) -> str:
    return f"regexp_replace(array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {trim('l')}), chr(10)), '-\\n([^\\n]+)', '\\1', 'g')"


def canon(x: str) -> str:
    return f"lower({coll(nf(x))})"


def hashed(x: str) -> str:
    return f"CASE WHEN {canon(x)} = '' THEN '' ELSE sha256({canon(x)}) END"


def count(x: str, cls: str) -> str:
    return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))"


_UUID = r"""
    SELECT *, CASE WHEN regexp_full_match(h, '[0-9a-f]{32}') THEN h WHEN length(t) > 0 THEN 'raw:' || t END AS message_key FROM (
        SELECT *, replace(regexp_replace(lower(t), '^\{|\}$|^urn:uuid:', '', 'g'), '-', '') AS h FROM (
            SELECT *, trim(event_id) AS t FROM events_in))"""

_LATEST = "(SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {by} DESC) AS _n FROM {t}) WHERE _n = 1)"
_V, _C, _U = (_LATEST.format(t=t, by=b) for t, b in (("vectors", "created_at"), ("chunks", "created_at"), ("uploads", "updated_at")))
_OK = "embedding IS NOT NULL AND len(embedding) = dimensions AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_Q = f"(SELECT embedding::DOUBLE[] AS q FROM vectors WHERE {_OK} AND dimensions = 64 ORDER BY id LIMIT 1)"
_DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
_LINES = "(SELECT document_id, line_no, max(page) AS page, coalesce(max(text), '') AS text FROM extracted_lines GROUP BY ALL)"


def _search_sql(tenant: str) -> str:
    where = f"WHERE c.metadata.tenant_id = '{tenant}' OR d.tenant_id = '{tenant}'" if tenant else ""
    return f"""
    WITH v AS (SELECT v.id, v.model_version, CASE WHEN len(embedding) = len(q) THEN list_cosine_similarity(embedding::DOUBLE[], q) END AS similarity FROM {_V} v, {_Q} WHERE CASE WHEN {_OK} THEN len(embedding) = len(q) ELSE false END)
    SELECT c.id AS chunk_id, c.document_id, coalesce(d.name, '') AS document_name, coalesce(d.file_key, '') AS file_key, v.id AS vector_id, c.chunk_index, round(v.similarity, 6) AS similarity, v.model_version
    FROM {_C} c JOIN v ON c.vector_id = v.id AND v.similarity >= 0.18 LEFT JOIN {_U} d ON d.id = c.document_id {where}
    ORDER BY v.similarity DESC, c.id LIMIT 10"""


_UPSERT = f"""
    WITH sides AS (SELECT *, CASE WHEN created_at < TIMESTAMPTZ '{SPLIT_TIME}' THEN 0 ELSE 1 END AS side FROM {_V} WHERE length(hash) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY side, created_at, id) AS a, row_number() OVER (PARTITION BY hash ORDER BY side DESC, created_at DESC, id DESC) AS z FROM sides),
    up AS (SELECT f.id, f.hash, l.model_version, l.dimensions, l.created_at FROM r f JOIN r l ON f.hash = l.hash AND f.a = 1 AND l.z = 1)"""

_PHRASES = f"""
    WITH p AS (SELECT doc_id, unnest(flatten(list_transform(regexp_split_to_array(text, '[.!?;\\n,]'), lambda s:
        list_filter(list_transform(string_split(array_to_string(list_transform(list_filter(list_transform({words('s')}, lambda w: lower(regexp_replace(w, '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g'))), lambda w: w <> ''),
            lambda w: CASE WHEN strlen(w) <= 2 THEN chr(1) ELSE w END), ' '), chr(1)), lambda x: list_filter(string_split(trim(x), ' '), lambda w: w <> '')), lambda x: len(x) > 0)))) AS ws FROM {_DOCS}),
    w AS (SELECT doc_id, word, count(*) AS freq, sum(d)::BIGINT AS degree FROM (SELECT doc_id, unnest(ws) AS word, len(ws) - 1 AS d FROM p) GROUP BY ALL)"""

_PARA_UNITS = f"""
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY g) AS unit_no, text FROM (
        SELECT document_id, g, string_agg(t, ' ' ORDER BY line_no) AS text FROM (
            SELECT document_id, line_no, t, sum((t = '')::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS g FROM (SELECT document_id, line_no, {trim('text')} AS t FROM {_LINES})) WHERE t <> '' GROUP BY document_id, g)"""
_SENT_UNITS = f"""
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line_no, k) AS unit_no, text FROM (
        SELECT document_id, line_no, generate_subscripts(s, 1) AS k, unnest(s) AS text FROM (
            SELECT document_id, line_no, list_filter(list_transform(string_split(regexp_replace({trim('text')}, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS s FROM {_LINES}))"""


def _pack_sql(units: str, budget: int, overlap: int) -> str:
    return f"""
    WITH RECURSIVE u AS ({units}),
    g AS (SELECT document_id AS d, list(text ORDER BY unit_no) AS txt, list(p ORDER BY unit_no) AS p, count(*) AS n FROM (SELECT *, sum(len({words('text')})) OVER (PARTITION BY document_id ORDER BY unit_no)::BIGINT AS p FROM u) GROUP BY document_id),
    c AS (
        SELECT d, 0 AS k, 1::BIGINT AS s, least(n, 1 + len(list_filter(p, lambda x: x < {budget}))) AS e, n, p FROM g
        UNION ALL
        SELECT d, k + 1, s2, least(n, e + 1 + len(list_filter(p[e + 1:n], lambda x: x - b[s2] < {budget}))), n, p FROM (
            SELECT *, list_concat([0::BIGINT], p) AS b, e + 1 - len(list_filter(list_concat([0::BIGINT], p)[s:e], lambda x: p[e] - x <= {overlap})) AS s2 FROM c WHERE e < n)),
    t AS (SELECT c.d, k, s, e, array_to_string(g.txt[s:e], chr(10) || chr(10)) AS content FROM c JOIN g ON g.d = c.d)
    SELECT d AS document_id, k::BIGINT AS chunk_index, s::INT AS first_unit, e::INT AS last_unit, content, (z - strlen(content))::INT AS start_char_offset, z::INT AS end_char_offset FROM (SELECT *, sum(strlen(content)) OVER (PARTITION BY d ORDER BY k) AS z FROM t)"""


def _windows_sql(n: str, size: int, step: int) -> str:
    return f"CASE WHEN {n} <= {size} THEN [0] ELSE list_transform(range(0, ceil(({n} - {size}) / {step}.0)::BIGINT + 1), lambda k: k * {step}) END"


_T = trim("text")
_LET, _NUM = f"({count(_T, chr(92) + 'p{L}')} / length({_T})::DOUBLE)", f"({count(_T, chr(92) + 'p{Nd}')} / length({_T})::DOUBLE)"
_ENT = f"(SELECT doc_id, coalesce(log2(sum(k)) - sum(k * log2(k)) / sum(k), 0.0) AS h FROM (SELECT doc_id, ch, count(*)::DOUBLE AS k FROM (SELECT doc_id, unnest(regexp_extract_all({{x}}, '(?s).')) AS ch FROM {_DOCS}) GROUP BY ALL) GROUP BY doc_id)"
_SCORED = f"(SELECT d.doc_id, {_T} AS t, strlen({_T}) AS b, len({words(_T)}) AS w, CASE WHEN {_T} <> '' THEN {_LET} END AS alpha, CASE WHEN {_T} <> '' THEN {_NUM} END AS digit, coalesce(h, 0.0) AS h FROM {_DOCS} d LEFT JOIN {_ENT.format(x=_T)} e ON e.doc_id = d.doc_id)"
_SHINGLES = f"""
    WITH h AS (SELECT doc_id, text, {canon('text')} AS c FROM {_DOCS}),
    cls AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY c) AS class_id FROM h WHERE c <> ''),
    w AS (SELECT doc_id AS id, {words('lower(text)')} AS ws FROM cls WHERE doc_id = class_id),
    s AS (SELECT id, list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w WHERE len(ws) > 0),
    x AS (SELECT id, len(sh) AS n, unnest(sh) AS v FROM s),
    pairs AS (SELECT a.id AS id_a, b.id AS id_b, round(count(*) / (a.n + b.n - count(*))::DOUBLE, 6) AS jaccard FROM x a JOIN x b ON a.v = b.v AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING round(count(*) / (a.n + b.n - count(*))::DOUBLE, 6) >= 0.8)"""

STOP_WORDS = ("the", "of", "and", "to", "in", "is", "was", "that", "for", "with", "on", "as", "by", "from", "der", "die", "und", "los", "las", "que")
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "st", "sr", "sra", "fig", "sec")
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TRIMMED = "trim(w, '.,!?;:\"''()[]{}')"
_STOP_RATIO = f"CASE WHEN w > 0 THEN len(list_filter({words('lower(t)')}, lambda w: list_contains({_STOPS}, {_TRIMMED}))) / w::DOUBLE ELSE 0.0 END"


def _strategy_sql(name: str, version: str, chunks: str) -> str:
    return f"SELECT '{name}' AS strategy, '{version}' AS parser_version, count(*) AS chunks, sum(len({words('content')}))::BIGINT AS tokens FROM ({chunks})"


def _token_windows_sql(size: int, step: int) -> str:
    return f"WITH t AS (SELECT document_id, {words('string_agg(' + _T + ', ' + chr(39) + ' ' + chr(39) + ' ORDER BY line_no)')} AS w FROM {_LINES} GROUP BY document_id), a AS (SELECT document_id, w, {_windows_sql('len(w)', size, step)} AS st FROM t WHERE len(w) > 0) SELECT array_to_string(w[a + 1:a + {size}], ' ') AS content FROM (SELECT document_id, w, unnest(st) AS a FROM a)"


def _char_windows_sql(size: int, step: int) -> str:
    return f"WITH t AS (SELECT document_id, string_agg(text, chr(10) ORDER BY line_no) || chr(10) AS x FROM {_LINES} GROUP BY document_id), a AS (SELECT document_id, x, {_windows_sql('length(x)', size, step)} AS st FROM t) SELECT substring(x, a + 1, {size}) AS content FROM (SELECT x, unnest(st) AS a FROM a)"


# The default language provider's words and scripts.
_FUNCTION_WORDS = {
    "de": "der die das und in den zu mit von für ist auf nicht ein eine am",
    "en": "the of and to in is was for that with on by not this from or are",
    "es": "el la los las de y en que un una por con para del se al",
    "fr": "le la les des et du en une est pour que dans par sur pas au",
    "it": "il la le di e in che un una per con non del della gli",
    "nl": "de het een van en in is dat op te voor met niet zijn",
    "pt": "o a os as de e em que um uma por com para do da não",
}
_LANGUAGE_SCRIPTS = {"ja": r"\p{Hiragana}\p{Katakana}", "zh": r"\p{Han}", "ko": r"\p{Hangul}", "ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "hi": r"\p{Devanagari}", "th": r"\p{Thai}", "el": r"\p{Greek}", "he": r"\p{Hebrew}"}


def _language_sql() -> str:
    by_script = " ".join(f"WHEN {count('text', c)} > 0.3 * letters THEN '{k}'" for k, c in _LANGUAGE_SCRIPTS.items())
    hits = ", ".join(f"len(list_filter(w, lambda x: list_contains(string_split('{v}', ' '), x))) AS {k}_" for k, v in _FUNCTION_WORDS.items())
    best = "greatest(" + ", ".join(f"{k}_" for k in _FUNCTION_WORDS) + ")"
    by_words = f"WHEN {best} = 0 THEN 'en' " + " ".join(f"WHEN {k}_ = {best} THEN '{k}'" for k in _FUNCTION_WORDS)
    return f"SELECT doc_id, CASE {by_script} {by_words} END AS language FROM (SELECT *, {hits} FROM (SELECT doc_id, text, greatest(1, {count('text', chr(92) + 'p{L}')}) AS letters, {words('lower(text)')} AS w FROM {_DOCS}))"


SQL = {
    "language_id": _language_sql(),
    "embed_documents": f"SELECT doc_id, 64 AS dimensions, CASE WHEN len({words('text')}) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM {_DOCS}",
    "fnv_hash": f"SELECT doc_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::INT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT)::VARCHAR AS hash FROM {_DOCS}",
    "retry_until_dead": f"SELECT event_id, CASE WHEN delivery_seq % 11 = 0 THEN 5 WHEN delivery_seq % 7 = 0 THEN 2 ELSE 0 END::BIGINT AS attempt_count, CASE WHEN delivery_seq % 11 = 0 THEN 'dead' ELSE 'done' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY message_key ORDER BY delivery_seq) AS n FROM ({_UUID}) WHERE message_key IS NOT NULL) WHERE n = 1 AND coalesce(trim(document_id), '') <> ''",
    "transaction_commit": "SELECT DISTINCT id, 'vectors' AS of FROM vectors UNION ALL SELECT DISTINCT id, 'chunks' FROM chunks",
    "documents_insert": f"SELECT id, tenant_id, checksum, file_size FROM {_U}",
    "quality_score_stop_words": f"SELECT doc_id, round(CASE WHEN b < 20 OR w < 4 THEN 0.0 WHEN alpha < 0.35 THEN 0.1 WHEN h < 2.2 OR h > 6.8 THEN 0.2 ELSE least(1.0, 0.4 * alpha + 0.4 * ({_STOP_RATIO}) + 0.2 * (h / 7.0)) END, 6) AS score FROM {_SCORED}",
    "keywords_stop_words": _PHRASES.replace("strlen(w) <= 2", f"strlen(w) <= 2 OR list_contains({_STOPS}, w)") + ", k AS (SELECT DISTINCT doc_id, array_to_string(ws, ' ') AS keyword, ws FROM p), s AS (SELECT k.doc_id, keyword, sum((degree + freq) / freq::DOUBLE) AS score FROM (SELECT doc_id, keyword, unnest(ws) AS word FROM k) k JOIN w ON w.doc_id = k.doc_id AND w.word = k.word GROUP BY ALL) SELECT doc_id, rank::INT AS rank, keyword, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, keyword) AS rank FROM s) WHERE rank <= 8",
    "sentence_split_honorifics": f"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trim('x')}), lambda x: x <> '') AS s FROM {_DOCS}), u AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM s), g AS (SELECT *, list_contains([{', '.join(repr(h) for h in HONORIFICS)}], trim(lower(list_last({words('x')})), '.!?,\"')) AS open FROM u), h AS (SELECT *, sum(CASE WHEN prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, coalesce(lag(open) OVER (PARTITION BY doc_id ORDER BY i), false) AS prev FROM g)) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sentence_no, sentence FROM (SELECT doc_id, k, string_agg(x, ' ' ORDER BY i) AS sentence FROM h GROUP BY doc_id, k)",
    "chunk_paragraph_production": _pack_sql(_PARA_UNITS, 450, 80),
    "chunk_sentence_production": _pack_sql(_SENT_UNITS, 450, 80),
    "chunk_strategies": " UNION ALL ".join(
        _strategy_sql(name, version, chunks)
        for name, version, chunks in (
            ("exact", "tiktoken-exact-1.0", _token_windows_sql(450, 370)),
            ("paragraph", "tiktoken-paragraph-1.0", _pack_sql(_PARA_UNITS, 450, 80)),
            ("sentence", "tiktoken-sentence-1.0", _pack_sql(_SENT_UNITS, 450, 80)),
            ("character-based", "character-based-1.0", _char_windows_sql(1800, 1480)),
            ("other", "tiktoken-paragraph-1.0", _pack_sql(_PARA_UNITS, 450, 80)),
        )
    ),
    "similarity_search": _search_sql(""),
    "similarity_search_tenant": _search_sql("default"),
    "similarity_threshold_count": f"WITH s AS (SELECT CASE WHEN len(embedding) = len(q) THEN list_cosine_similarity(embedding::DOUBLE[], q) END AS s FROM {_V} v, {_Q} WHERE CASE WHEN {_OK} THEN len(embedding) = len(q) ELSE false END) SELECT threshold, count(*) FILTER (s >= threshold) AS n FROM s, (SELECT unnest([0.18, 0.3, 0.5]::DOUBLE[]) AS threshold) GROUP BY threshold",
    "similarity_all_pairs_topk": "SELECT query_id, row_id, similarity, rank::INT AS rank FROM (SELECT a.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS row_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id::VARCHAR) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5",
    "vector_codec": f"SELECT id, true AS same, len(embedding)::INT AS n FROM {_V} WHERE CASE WHEN {_OK} THEN true ELSE false END",
    "canonical_hash": f"SELECT doc_id, {hashed('text')} AS hash FROM {_DOCS}",
    "canonical_hash_dups": f"SELECT hash, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, {hashed('text')} AS hash FROM {_DOCS}) WHERE hash <> '' GROUP BY hash HAVING count(*) > 1",
    "document_checksum_dedup": f"SELECT doc_id, tenant_id, checksum FROM (SELECT doc_id, tenant_id, sha256(text) AS checksum, row_number() OVER (PARTITION BY tenant_id, text ORDER BY doc_id) AS n FROM {_DOCS}) WHERE n = 1 OR tenant_id IS NULL",
    "dedup_anti_join": f"SELECT doc_id, sha256(text) AS checksum FROM {_DOCS} WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM {_DOCS} WHERE doc_id % 2 = 0)",
    "dedup_semi_join": f"SELECT doc_id, sha256(text) AS checksum FROM {_DOCS} WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM {_DOCS} WHERE doc_id % 2 = 0)",
    "chunk_dedup": f"SELECT id, known_vector_id, first_id, CASE WHEN known_vector_id IS NULL AND first_id = id THEN 'embed' ELSE 'duplicate' END AS kind FROM (SELECT c.id, k.v AS known_vector_id, CASE WHEN length(c.hash) > 0 THEN first_value(c.id) OVER (PARTITION BY c.hash ORDER BY c.document_id, c.chunk_index, c.id) ELSE c.id END AS first_id FROM {_C} c LEFT JOIN (SELECT hash, min(id) AS v FROM {_V} WHERE length(hash) > 0 AND created_at < TIMESTAMPTZ '{SPLIT_TIME}' GROUP BY hash) k ON k.hash = c.hash)",
    "vector_upsert": _UPSERT + " SELECT id, hash, model_version, dimensions, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created FROM up",
    "vector_id_remap": _UPSERT + f" SELECT c.id, coalesce(up.id, c.vector_id) AS vector_id FROM {_C} c LEFT JOIN up ON up.hash = c.hash",
    "recent_hashes_topn": f"SELECT id, hash FROM {_V} WHERE length(hash) > 0 ORDER BY created_at DESC, hash, id LIMIT 10000",
    "chunk_append_idempotent": f"SELECT id, document_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY created_at, id) AS n FROM chunks) c WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM chunks o WHERE o.created_at < TIMESTAMPTZ '{SPLIT_TIME}' AND o.document_id = c.document_id AND o.chunk_index = c.chunk_index)",
    "document_lookup": "SELECT 'checksum' AS by, (SELECT id FROM uploads WHERE checksum = (SELECT min(checksum) FROM uploads) ORDER BY created_at, id LIMIT 1) AS id UNION ALL SELECT 'id', (SELECT min(id) FROM uploads) UNION ALL SELECT 'file_key', (SELECT id FROM uploads WHERE file_key = (SELECT min(file_key) FROM uploads) LIMIT 1)",
    "strip_control": f"SELECT doc_id, {ctrl('text || chr(13) || chr(7) || ' + chr(39) + 'a' + chr(39) + ' || chr(9) || ' + chr(39) + 'b' + chr(39))} AS clean FROM {_DOCS}",
    "collapse_ws": f"SELECT doc_id, {coll('text')} AS clean FROM {_DOCS}",
    "normalize_text": f"SELECT doc_id, {drop_blank(dehyphen(ctrl(nf('text'))))} AS clean FROM {_DOCS}",
    "clean_chunk_text": f"SELECT doc_id, {drop_blank(ctrl(nf('text')))} AS clean FROM {_DOCS}",
    "query_prefix": "SELECT DISTINCT id, CASE WHEN lower(name) LIKE 'search_query:%' THEN name ELSE 'search_query: ' || name END AS query FROM uploads WHERE name IS NOT NULL",
    "metadata_fields": f"SELECT id, metadata.document_id, metadata.language, metadata.token_count, coalesce(len(metadata.entities), 0) = 0 AS no_entities FROM {_C}",
    "recurring_lines_removed": f"WITH l AS (SELECT *, {_T} AS t FROM {_LINES}), n AS (SELECT document_id, t, count(*) AS k FROM l WHERE strlen(t) > 5 AND strlen(t) < 120 GROUP BY ALL), p AS (SELECT document_id, max(page) AS pages FROM l GROUP BY ALL) SELECT document_id, line_no, page, {coll(ctrl(nf('text')))} AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM n JOIN p ON n.document_id = p.document_id WHERE n.document_id = l.document_id AND n.t = l.t AND pages > 1 AND k >= greatest(pages // 2, 2))",
    "page_split": f"WITH p AS (SELECT doc_id, pages, generate_subscripts(pages, 1) AS p, unnest(pages) AS t FROM (SELECT doc_id, string_split(replace(text, chr(10) || chr(10), chr(10) || chr(12)), chr(12)) AS pages FROM {_DOCS})), l AS (SELECT doc_id, p, len(pages) AS np, len(ls) AS nl, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT *, string_split(t, chr(10)) AS ls FROM p)) SELECT doc_id::VARCHAR AS id, count(*) AS lines, max(p)::BIGINT AS pages, sum(length(line))::BIGINT AS chars FROM l WHERE NOT ({trim('line')} = '' AND ((i = 1 AND p > 1) OR (i = nl AND p < np))) GROUP BY doc_id",
    "char_ratios": f"SELECT doc_id, " + ", ".join(f"CASE WHEN {_T} = '' THEN 0.0 ELSE round({count(_T, c)} / length({_T})::DOUBLE, 6) END AS {n}" for c, n in ((r"\p{L}", "letters"), (r"\p{Nd}", "digits"), (_WS[1:-1], "spaces"), (r"\p{Lu}", "uppers"))) + f" FROM {_DOCS}",
    "char_entropy": f"SELECT d.doc_id, round(coalesce(h, 0.0), 6) AS entropy FROM {_DOCS} d LEFT JOIN {_ENT.format(x='text')} e ON d.doc_id = e.doc_id",
    "quality_score": f"SELECT doc_id, round(CASE WHEN b < 20 OR w < 4 THEN 0.0 WHEN alpha < 0.35 THEN 0.1 WHEN h < 2.2 OR h > 6.8 THEN 0.2 ELSE least(1.0, 0.4 * alpha + 0.2 * (h / 7.0)) END, 6) AS score FROM {_SCORED}",
    "quality_gate": f"SELECT doc_id, CASE WHEN b < 20 THEN false WHEN digit > 0.4 AND alpha > 0.15 THEN true WHEN alpha < 0.35 THEN false WHEN h < 2.5 OR h > 6.8 THEN false WHEN w < 5 THEN false WHEN w < 15 AND (contains(lower(t), 'all rights reserved') OR contains(lower(t), 'confidential and proprietary')) THEN false ELSE true END AS passes FROM {_SCORED}",
    "boilerplate_filter": f"WITH p AS (SELECT doc_id, unnest(range(0, len(ps))) AS para_no, unnest(ps) AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM {_DOCS})), k AS (SELECT *, CASE WHEN strlen({_T}) > 10 THEN lower({coll('text')}) END AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM p) SELECT doc_id, para_no::INT AS para_no, text FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM k) WHERE h IS NULL OR c < greatest(floor(n * 0.3), 2)",
    "doc_profile": f"WITH t AS (SELECT doc_id, {_T} AS t FROM {_DOCS}), x AS (SELECT *, len({words('t')}) AS n, len(string_split(t, '.')) AS s, len(list_distinct(list_transform({words('t')}, lambda w: lower(w)))) AS dw FROM t) SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE s END::INT AS sentence_count, CASE WHEN t = '' THEN 0.0 ELSE round(n / s::DOUBLE, 6) END AS avg_sentence_len, CASE WHEN t = '' THEN 0.0 ELSE round(dw / n::DOUBLE, 6) END AS lexical_diversity, CASE WHEN t = '' THEN 0.0 ELSE round({count('t', chr(92) + 'p{Nd}')} / length(t)::DOUBLE, 6) END AS digit_ratio, CASE WHEN t = '' THEN 0.0 ELSE round({count('t', chr(92) + 'p{Lu}')} / length(t)::DOUBLE, 6) END AS uppercase_ratio, CASE WHEN t = '' THEN 0 ELSE n END::INT AS token_count FROM x",
    "keywords_topn": _PHRASES + ", k AS (SELECT DISTINCT doc_id, array_to_string(ws, ' ') AS keyword, ws FROM p), s AS (SELECT k.doc_id, keyword, sum((degree + freq) / freq::DOUBLE) AS score FROM (SELECT doc_id, keyword, unnest(ws) AS word FROM k) k JOIN w ON w.doc_id = k.doc_id AND w.word = k.word GROUP BY ALL) SELECT doc_id, rank::INT AS rank, keyword, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, keyword) AS rank FROM s) WHERE rank <= 8",
    "word_scores": _PHRASES + " SELECT doc_id, word, freq, degree, round((degree + freq) / freq::DOUBLE, 6) AS score FROM w",
    "phrase_counts": _PHRASES + " SELECT doc_id, array_to_string(ws, ' ') AS phrase, count(*) AS n FROM p GROUP BY ALL",
    "sentence_split": f"SELECT doc_id, unnest(range(0, len(s)))::INT AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trim('x')}), lambda x: x <> '') AS s FROM {_DOCS})",
    "sentence_units": f"SELECT document_id, unit_no::INT AS unit_no, text FROM ({_SENT_UNITS})",
    "paragraph_units": f"SELECT document_id, unit_no::INT AS unit_no, text FROM ({_PARA_UNITS})",
    "token_windows": f"WITH t AS (SELECT document_id, {words('string_agg(' + _T + ', ' + chr(39) + ' ' + chr(39) + ' ORDER BY line_no)')} AS w FROM {_LINES} GROUP BY document_id), a AS (SELECT document_id, w, {_windows_sql('len(w)', 100, 80)} AS st FROM t WHERE len(w) > 0) SELECT document_id, k::BIGINT AS chunk_index, array_to_string(w[a + 1:a + 100], ' ') AS content FROM (SELECT document_id, w, unnest(range(0, len(st))) AS k, unnest(st) AS a FROM a)",
    "char_windows": f"WITH t AS (SELECT document_id, string_agg(text, chr(10) ORDER BY line_no) || chr(10) AS x FROM {_LINES} GROUP BY document_id), a AS (SELECT document_id, x, {_windows_sql('length(x)', 400, 320)} AS st FROM t) SELECT document_id, k::BIGINT AS chunk_index, substring(x, a + 1, 400) AS content, a::BIGINT AS a, (a + length(substring(x, a + 1, 400)))::BIGINT AS e FROM (SELECT document_id, x, unnest(range(0, len(st))) AS k, unnest(st) AS a FROM a)",
    "chunk_paragraph": _pack_sql(_PARA_UNITS, 100, 20),
    "chunk_sentence": _pack_sql(_SENT_UNITS, 60, 15),
    "shingle_jaccard_pairs": _SHINGLES + " SELECT id_a, id_b, jaccard FROM pairs",
    "copy_classes": f"SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY c) AS class_id FROM (SELECT doc_id, {canon('text')} AS c FROM {_DOCS}) WHERE c <> ''",
    "near_dup_clusters": _SHINGLES.replace("WITH h AS", "WITH RECURSIVE h AS", 1) + ", e AS (SELECT id_a AS u, id_b AS v FROM pairs UNION SELECT id_b, id_a FROM pairs), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT c.doc_id AS id, coalesce(least(c.class_id, (SELECT min(v) FROM r WHERE r.u = c.class_id)), c.class_id) AS class_id, (SELECT count(*) FROM e WHERE e.u = c.class_id) AS links FROM cls c",
    "event_parse_dlq": "SELECT delivery_seq, event_id, CASE WHEN _corrupt_record IS NOT NULL THEN 'dlq' WHEN coalesce(trim(document_id), '') = '' THEN 'skip' ELSE 'process' END AS target, CASE WHEN _corrupt_record IS NOT NULL THEN 'undecodable' END AS error_reason FROM events_in",
    "dead_letters": "SELECT _corrupt_record AS raw_payload, 'undecodable' AS error_reason, 0::BIGINT AS attempt_count FROM events_in WHERE _corrupt_record IS NOT NULL",
    "retry_backoff_plan": "SELECT delivery_seq, CASE WHEN delivery_seq % 7 >= 5 THEN 'dlq' ELSE 'retry' END AS action, CASE WHEN delivery_seq % 7 < 5 THEN (delivery_seq % 7) * 2 END AS delay_seconds FROM events_in WHERE _corrupt_record IS NULL",
    "request_counters": "SELECT event_type, count(*) AS requests FROM events GROUP BY event_type",
    "latency_histogram": "SELECT event_type, b::INT AS bucket, count(*) AS n, round(sum(value), 4) AS total, CASE b WHEN 0 THEN 1.0 WHEN 1 THEN 5.0 WHEN 2 THEN 10.0 WHEN 3 THEN 25.0 WHEN 4 THEN 50.0 WHEN 5 THEN 100.0 END::DOUBLE AS upper_edge FROM (SELECT *, CASE WHEN value <= 1 THEN 0 WHEN value <= 5 THEN 1 WHEN value <= 10 THEN 2 WHEN value <= 25 THEN 3 WHEN value <= 50 THEN 4 WHEN value <= 100 THEN 5 ELSE 6 END AS b FROM events WHERE value IS NOT NULL) GROUP BY event_type, b",
    "health": "SELECT 'ok' AS status",
    "stream_dedup_replay": f"SELECT min(delivery_seq) AS delivery_seq, message_key FROM ({_UUID}) WHERE message_key IS NOT NULL AND _corrupt_record IS NULL AND coalesce(trim(document_id), '') <> '' GROUP BY message_key",
    "p3_found": f"SELECT delivery_seq FROM (SELECT delivery_seq, row_number() OVER (PARTITION BY message_key ORDER BY delivery_seq) AS n FROM ({_UUID}) WHERE message_key IS NOT NULL) WHERE n > 1",
    "p3_kept": f"SELECT delivery_seq, message_key, document_id, rtrim(rtrim(strftime(timestamp AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS sent_at FROM (SELECT *, row_number() OVER (PARTITION BY message_key ORDER BY delivery_seq) AS n FROM ({_UUID})) WHERE message_key IS NULL OR n = 1",
}
