"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from glossa.settings import PROMPT_PRESETS, SKIP_KEYS, TRANSLATE_KEYS, char_budget
from registry.queries import (
    CHUNK_TOKENS,
    EMPTY_MARK,
    FIRST_ROWS,
    SMALL_TOKENS,
    SOFT_MARK,
    START_ROW,
)

# The whitespace class of glossa.settings in RE2's notation.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_WS = WS.replace("[", "[^", 1)
TRIMMED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NL = "chr(10)"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(keys) -> str:
    return ", ".join(text(k) for k in keys)


# ------------------------------------------------------------------ chunking


def split_sql(t: str) -> str:
    """Parts of a text; RE2 has no look-behind, so boundaries are marked first."""

    def marked(signs: str) -> str:
        return f"string_split(regexp_replace({t}, '([{signs}]){WS}+', '\\1' || chr(1), 'g'), chr(1))"

    cuts = [
        marked(".!?"),
        f"string_split_regex({t}, '\\n\\n+')",
        f"string_split_regex({t}, '\\n+')",
        marked(";:"),
        marked(","),
    ]
    lists = ", ".join(
        f"list_filter({cut}, lambda p: regexp_matches(p, '{NOT_WS}'))" for cut in cuts
    )
    words = f"list_filter(string_split_regex({t}, '{WS}+'), lambda w: w <> '')"
    halves = (
        f"list_transform([{words}], lambda ws: CASE WHEN len(ws) > 1 THEN "
        "[array_to_string(ws[:len(ws) // 2], ' '), array_to_string(ws[len(ws) // 2 + 1:], ' ')] "
        "END)[1]"
    )
    return f"coalesce(list_filter([{lists}], lambda ps: len(ps) > 1)[1], {halves}, [{t}])"


def pack_sql(parts: str, budget: int) -> str:
    joined = f"trim(a.cur || ' ' || x.cur, {TRIMMED})"
    packed = (
        f"list_reduce(list_transform({parts}, lambda q: {{done: []::VARCHAR[], cur: q}}), "
        f"lambda a, x: CASE WHEN length(a.cur) <= {budget} AND length({joined}) <= {budget} "
        f"THEN {{done: a.done, cur: {joined}}} "
        "ELSE {done: list_append(a.done, a.cur), cur: x.cur} END)"
    )
    return f"list_transform([{packed}], lambda r: list_append(r.done, r.cur))[1]"


def chunk_ctes(source: str, tokens: int) -> str:
    """CTEs up to chunk(id, chunk_idx, chunk); ``source`` selects (id, txt)."""
    budget = char_budget(tokens)

    def parts(t: str) -> str:
        over = f"length({t}) > {budget} AND regexp_matches({t}, '{NOT_WS}')"
        return f"CASE WHEN {over} THEN {split_sql(t)} END"

    return f"""
    src AS ({source}),
    node AS (
        SELECT id, [0::BIGINT] AS path, txt, {parts('txt')} AS parts FROM src
        UNION ALL
        SELECT id, list_append(path, k), txt, {parts('txt')} AS parts
        FROM (
            SELECT id, path, unnest(packed) AS txt, generate_subscripts(packed, 1) AS k
            FROM (
                SELECT id, path, {pack_sql('parts', budget)} AS packed
                FROM node WHERE len(parts) > 1
            )
        )
    ),
    chunk AS (
        SELECT id, txt AS chunk,
               CAST(row_number() OVER (PARTITION BY id ORDER BY path) - 1 AS INTEGER) AS chunk_idx
        FROM node WHERE parts IS NULL OR len(parts) = 1
    )"""


DOC_TEXT = "SELECT doc_id AS id, text AS txt FROM documents"


def tokens_sql(t: str) -> str:
    return f"CAST(CASE WHEN coalesce(length({t}), 0) = 0 THEN 0 ELSE greatest(1, length({t}) // 4) END AS INTEGER)"


def translated_sql(agg_where: str = "") -> str:
    """translated(id, tr): the chunks of every text under the stub."""
    return f"""
    translated AS (
        SELECT id, string_agg('[tr] ' || chunk, ' ' ORDER BY chunk_idx) AS tr
        FROM chunk {agg_where} GROUP BY id
    )"""


# --------------------------------------------------------------------- inputs

TURN_ID = "conv_id || '-' || turn"
CHAT = f"CAST(to_json(list_transform(string_split(text, {NL}), lambda m: {{role: role, content: m}})) AS VARCHAR)"
CHATS = f"SELECT {TURN_ID} AS turn_id, role, {CHAT} AS messages FROM conversations"
MIXED = f"""SELECT {TURN_ID} AS turn_id, role, text AS said,
    CASE WHEN role = 'assistant' THEN {CHAT} ELSE text END AS cell FROM conversations"""

NOTE = """CAST(to_json({
    id: doc_id, text: text, metadata: {content: text, source: source},
    raw: [CAST(to_json({summary: lang, name: source}) AS VARCHAR)],
    notes: {inner: {summary: lang, name: source}, text: [lang]},
    n_chars: n_chars}) AS VARCHAR)""".replace("inner:", '"inner":')
NOTED = f"SELECT doc_id, text, {NOTE} AS note, lang FROM documents"

GAPPY = r"""SELECT doc_id, lang, CASE lang WHEN 'de' THEN NULL
    WHEN 'fr' THEN ' ' || regexp_replace(text, '\S', '', 'g') ELSE text END AS cell
    FROM documents"""

ANY_CELLS = f"""
    SELECT 'event-' || event_id AS id, props AS cell FROM events
    UNION ALL SELECT 'user-' || event_id, CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT 'turn-' || turn_id, cell FROM ({MIXED})
    UNION ALL SELECT 'broken-' || turn_id, cell || ' x' FROM ({MIXED})
    UNION ALL SELECT 'doc-' || doc_id, cell FROM ({GAPPY})"""

BLANK = f"(cell IS NULL OR NOT regexp_matches(cell, '{NOT_WS}'))"
IS_VALUE = "coalesce(json_valid(cell), false)"
# json_type raises on text that is no JSON, so it only sees cells that are.
IS_JSON = (
    f"coalesce(json_type(CASE WHEN {IS_VALUE} THEN cell END) IN ('OBJECT', 'ARRAY'), false)"
)


def chat_text(line: str) -> str:
    """The chat cell as it is written, for a given form of each line."""
    item = (
        f"'  {{' || {NL} || '    \"role\": ' || CAST(to_json(role) AS VARCHAR) || ',' || {NL} || "
        f"'    \"content\": ' || CAST(to_json({line}) AS VARCHAR) || {NL} || '  }}'"
    )
    return (
        f"'[' || {NL} || array_to_string(list_transform(string_split(text, {NL}), "
        f"lambda m: {item}), ',' || {NL}) || {NL} || ']'"
    )


STUB_LINE = f"CASE WHEN regexp_matches(m, '{NOT_WS}') THEN '[tr] ' || m ELSE m END"
CHAT_TR = chat_text(STUB_LINE)

NOTE_TR = f"""'{{' || {NL} || '  "id": ' || doc_id || ',' || {NL}
    || '  "text": ' || CAST(to_json(tr) AS VARCHAR) || ',' || {NL}
    || '  "metadata": {{' || {NL}
    || '    "content": ' || CAST(to_json(text) AS VARCHAR) || ',' || {NL}
    || '    "source": ' || CAST(to_json(source) AS VARCHAR) || {NL} || '  }},' || {NL}
    || '  "raw": [' || {NL} || '    '
    || CAST(to_json(CAST(to_json({{summary: lang, name: source}}) AS VARCHAR)) AS VARCHAR)
    || {NL} || '  ],' || {NL}
    || '  "notes": {{' || {NL} || '    "inner": {{' || {NL}
    || '      "summary": ' || CAST(to_json('[tr] ' || lang) AS VARCHAR) || ',' || {NL}
    || '      "name": ' || CAST(to_json(source) AS VARCHAR) || {NL} || '    }},' || {NL}
    || '    "text": [' || {NL} || '      ' || CAST(to_json(lang) AS VARCHAR) || {NL} || '    ]' || {NL}
    || '  }},' || {NL} || '  "n_chars": ' || n_chars || {NL} || '}}'"""


def leaves_sql(source: str, row_id: str, cell: str, translate, skip) -> str:
    """A walk of the JSON tree: listed string keys with no skipped key on the way."""
    return f"""
    WITH RECURSIVE doc AS ({source}),
    tree AS (SELECT d.{row_id}, t.* FROM doc d, json_tree(d.{cell}) t),
    open AS (
        SELECT {row_id}, id, type FROM tree WHERE parent IS NULL
        UNION ALL
        SELECT c.{row_id}, c.id, c.type FROM tree c JOIN open p
            ON c.{row_id} = p.{row_id} AND c.parent = p.id
        WHERE c.type IN ('OBJECT', 'ARRAY')
          AND NOT (p.type = 'OBJECT' AND c.key IN ({names(skip)}))
    )
    SELECT c.{row_id},
           CAST(row_number() OVER (PARTITION BY c.{row_id} ORDER BY c.id) - 1 AS INTEGER) AS leaf_ord,
           c.fullkey AS path, c.atom ->> '$' AS text
    FROM tree c JOIN open p ON c.{row_id} = p.{row_id} AND c.parent = p.id
    WHERE p.type = 'OBJECT' AND c.type = 'VARCHAR' AND c.key IN ({names(translate)})
      AND c.key NOT IN ({names(skip)}) AND regexp_matches(c.atom ->> '$', '{NOT_WS}')"""


# --------------------------------------------------------------------- states

ORDER_JOBS = """
    SELECT o_orderpriority, count(*) AS total_rows,
           count(*) FILTER (o_orderstatus = 'F') AS completed_rows,
           coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), -1) AS last_saved_row,
           max(o_orderdate) FILTER (o_orderstatus = 'F') AS updated_at
    FROM orders GROUP BY o_orderpriority"""

DOC_JOBS = """
    SELECT d.source, count(*) AS total_rows, count(l.doc_id) AS completed_rows,
           coalesce(max(l.doc_id), -1) AS last_saved_row
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
    GROUP BY d.source"""


def stats_sql(source: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS type, "
        f"count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM ({source})"
        for i, (c, kind) in enumerate(columns)
    )


def prompt_sql(preset: str) -> str:
    system_prompt, template = PROMPT_PRESETS[preset]
    told = system_prompt.replace("{source}", "en").replace("{target}", "tr")
    before, after = template.replace("{src}", "en").replace("{tgt}", "tr").split("{text}")
    user = 1 if system_prompt else 0
    sql = (
        f"SELECT doc_id, {user} AS pos, 'user' AS role, "
        f"{text(before)} || text || {text(after)} AS content FROM documents"
    )
    if system_prompt:
        sql += f" UNION ALL SELECT doc_id, 0, 'system', {text(told)} FROM documents"
    return sql


ORDER_COLUMNS = [
    ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]


def card_sql(name: str, source: str, order: str, columns: list[tuple[str, str]]) -> str:
    """The card, line by line: fixed text around one row per column and three samples."""
    head = [
        "---", "language: tr", "license: mit", "---", "", f"# {name}", "",
        f"Rows of `{source}` in which chosen columns were machine-translated; the target",
        "language is `tr`. Protected keys of JSON cells and all other columns are unchanged.",
        "", "## Columns", "",
    ]
    tail = ["", "## How to read it", "", f'    spark.read.parquet("{name}")', ""]
    titles = ["| column | type | filled cells | different values |", "| --- | --- | --- | --- |"]
    names_line = "| " + " | ".join(c for c, _ in columns) + " |"
    rule = "| " + " | ".join("---" for _ in columns) + " |"
    row = " || ' | ' || ".join(f"CAST({c} AS VARCHAR)" for c, _ in columns)

    def listed(lines: list[str]) -> str:
        return "[" + ", ".join(text(x) for x in lines) + "]"

    return f"""
        WITH stats AS ({stats_sql(f'SELECT * FROM {source}', columns)}),
        lines AS (SELECT list_concat({listed([*head, *titles])},
            (SELECT list('| ' || "column" || ' | ' || type || ' | ' || non_null || ' | '
                || distinct_values || ' |' ORDER BY position) FROM stats),
            {listed(["", "## First rows", "", names_line, rule])},
            (SELECT list('| ' || {row} || ' |' ORDER BY {order}) FROM {source} WHERE {order} < 3),
            {listed(tail)}) AS ls)
        SELECT CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line
        FROM lines"""


KEY_KINDS = f"""
    SELECT * FROM (VALUES ('note', 'id', 'skip'), ('note', 'text', 'translate'),
        ('note', 'metadata', 'skip'), ('note', 'raw', 'untouched'), ('note', 'notes', 'untouched'),
        ('note', 'n_chars', 'untouched')) v("column", key, kind)
    WHERE key IN (SELECT unnest(json_keys(note)) FROM ({NOTED}))"""


FAILS = f"(contains(chunk, '{SOFT_MARK}') OR contains(chunk, '{EMPTY_MARK}'))"
TR_OF_TURNS = f"""WITH RECURSIVE {chunk_ctes(
    f"SELECT {TURN_ID} AS id, text AS txt FROM conversations", CHUNK_TOKENS)}, {translated_sql()}"""
REPEATED = "CASE WHEN conv_id % 5 <> 0 THEN conv_id END"
TR_OF_TEXT = f"WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}, {translated_sql()}"

ORACLES: dict[str, str] = {
    "read_table": "SELECT * FROM orders",
    "load_split": "SELECT doc_id, text, source, n_chars FROM documents WHERE lang = 'en'",
    "list_splits": """SELECT split, split = CASE WHEN bool_or(split = 'train') OVER ()
        THEN 'train' ELSE min(split) OVER () END AS is_default
        FROM (SELECT DISTINCT o_orderstatus AS split FROM orders)""",
    "first_n": f"""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id,
        o_orderkey, o_orderstatus FROM orders QUALIFY row_id < {FIRST_ROWS}""",
    "scan_head": f"""SELECT * FROM documents
        QUALIFY row_number() OVER (ORDER BY doc_id) <= {FIRST_ROWS}""",
    "rows_from": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, *
        FROM documents QUALIFY row_id >= {START_ROW}""",
    "preview": "SELECT * FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 10",
    "assign_row_id_ranges": """SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id,
        event_id, event_type FROM events""",
    "scan_head_files": f"SELECT * FROM documents ORDER BY doc_id LIMIT {FIRST_ROWS}",
    "assign_row_id": """SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id,
        event_id, event_type FROM events""",
    "write_roundtrip": NOTED,
    "catalog": """
        SELECT 'nation' AS name, 'n_nationkey,n_name,n_regionkey' AS columns,
               count(*) AS row_count FROM nation
        UNION ALL SELECT 'orders',
            'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority',
            count(*) FROM orders
        UNION ALL SELECT 'documents', 'doc_id,text,lang,source,n_chars', count(*) FROM documents""",
    "reslice": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, *
        FROM documents QUALIFY row_id < {FIRST_ROWS}""",
    "publish": "SELECT *, true AS ok FROM documents",
    "text_columns": """SELECT l_returnflag, l_linestatus, count(*) AS n
        FROM lineitem GROUP BY ALL""",
    "cell_text": f"""SELECT doc_id, coalesce(cell, '') AS cell, CAST(doc_id AS VARCHAR) AS id_text
        FROM ({GAPPY})""",
    "is_translatable": f"SELECT doc_id, NOT {BLANK} AS translatable FROM ({GAPPY})",
    "parse_key_list": f"""
        SELECT doc_id, CAST(len(keys) AS INTEGER) AS n_keys, array_to_string(keys, '|') AS keys
        FROM (
            SELECT doc_id, CASE WHEN len(ks) > 0 THEN ks ELSE [{names(TRANSLATE_KEYS)}] END AS keys
            FROM (SELECT doc_id, list_filter(list_transform(
                string_split(CASE WHEN lang <> 'de' THEN text END, ','),
                lambda k: trim(k, {TRIMMED})), lambda k: k <> '') AS ks FROM documents))""",
    "fits_limit": f"""SELECT doc_id, {tokens_sql('text')} <= {CHUNK_TOKENS} * 0.75 AS fits
        FROM documents""",
    "row_count": "SELECT count(*) AS row_count FROM lineitem",
    "column_stats": stats_sql(
        "SELECT * FROM orders",
        [("o_orderkey", "bigint"), *ORDER_COLUMNS],
    ),
    "empty_like": stats_sql(
        "SELECT * FROM orders WHERE false",
        [("o_orderkey", "bigint"), *ORDER_COLUMNS],
    ),
    "sketch_counts": f"""
        SELECT position, "column", type, non_null, TRUE AS same, TRUE AS within
        FROM ({stats_sql("SELECT * FROM documents", [
            ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
            ("n_chars", "bigint")])})""",
    "sketch_job": f"""
        SELECT "column", type, non_null, TRUE AS within
        FROM ({stats_sql("SELECT doc_id, text, lang, source, n_chars FROM documents", [
            ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
            ("n_chars", "bigint")])})""",
    "column_stats_text": stats_sql(
        GAPPY, [("doc_id", "bigint"), ("lang", "string"), ("cell", "string")]
    ),
    "json_profile": """
        SELECT 'event_type' AS "column", count(*) AS total_rows, 0::BIGINT AS json_rows FROM events
        UNION ALL SELECT 'props', count(*),
            count(*) FILTER (json_type(props) IN ('OBJECT', 'ARRAY')) FROM events""",
    "json_profile_mixed": f"""SELECT 'cell' AS "column", count(*) AS total_rows,
        count(*) FILTER ({IS_JSON}) AS json_rows FROM ({MIXED})""",
    "json_keys": f"""SELECT DISTINCT 'note' AS "column", unnest(json_keys(note)) AS key FROM ({NOTED})
        UNION SELECT DISTINCT 'props', unnest(json_keys(props)) FROM events""",
    "classify_keys": KEY_KINDS,
    "column_report": f"""
        WITH kinds AS ({KEY_KINDS}), n AS (SELECT count(*) AS rows FROM documents)
        SELECT 'text' AS "column", 0 AS section, 0::BIGINT AS part, 'text: plain text' AS line
        UNION ALL SELECT 'lang', 0, 0, 'lang: plain text'
        UNION ALL SELECT 'note', 0, 0, 'note: JSON detected (' || rows || '/' || rows || ' rows)' FROM n
        UNION ALL SELECT 'note', CASE kind WHEN 'translate' THEN 1 WHEN 'skip' THEN 2 ELSE 3 END, 0,
            upper(kind[1]) || kind[2:] || ': ' || string_agg(key, ', ' ORDER BY key)
        FROM kinds GROUP BY kind""",
    "dataset_card": card_sql("orders-tr", "orders", "o_orderkey", ORDER_COLUMNS),
    "job_state": ORDER_JOBS,
    "job_state_documents": DOC_JOBS,
    "has_pending": f"""SELECT source, completed_rows > 0 AND completed_rows < total_rows AS has_pending
        FROM ({DOC_JOBS})""",
    "pending_jobs": f"SELECT * FROM ({DOC_JOBS}) WHERE completed_rows < total_rows",
    "latest_pending": f"""SELECT * FROM ({ORDER_JOBS}) WHERE completed_rows < total_rows
        ORDER BY updated_at DESC NULLS LAST, o_orderpriority LIMIT 1""",
    "progress_ratio": f"""SELECT source,
        CASE WHEN total_rows > 0 THEN completed_rows / total_rows ELSE 0.0 END AS progress,
        CASE WHEN completed_rows >= total_rows THEN 'completed' WHEN completed_rows > 0
            THEN 'running' ELSE 'idle' END AS status FROM ({DOC_JOBS})""",
    "job_summary": f"""SELECT source,
        'Dataset: documents | Split: ' || source || ' | Rows: ' || total_rows || {NL}
        || 'Columns: text' || {NL} || 'Language: en -> tr'
        || CASE WHEN completed_rows > 0 AND completed_rows < total_rows
            THEN {NL} || 'Pending job: ' || completed_rows || '/' || total_rows || ' rows done'
            ELSE '' END AS summary FROM ({DOC_JOBS})""",
    "resume_remaining": """SELECT doc_id, text, lang FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "start_override": f"""WITH RECURSIVE {chunk_ctes(
            f"SELECT doc_id AS id, CASE WHEN doc_id >= {START_ROW} THEN 'new ' ELSE '' END || text AS txt FROM documents",
            CHUNK_TOKENS)}, {translated_sql()}
        SELECT id AS doc_id, tr AS text FROM translated""",
    "restart": f"""WITH RECURSIVE {chunk_ctes(
            "SELECT doc_id AS id, 'new ' || text AS txt FROM documents", CHUNK_TOKENS
        )}, {translated_sql()}
        SELECT id AS doc_id, tr AS text FROM translated""",
    "find_pending": """
        WITH n AS (
            SELECT count(*) AS rows,
                count_if(doc_id < (SELECT max(doc_id) // 2 + 1 FROM documents))::BIGINT AS half
            FROM documents
        )
        SELECT 'web/docs' AS dataset_id, 'train' AS split, 'source' AS columns,
            rows AS total_rows, half AS completed_rows, true AS has_pending, 'running' AS status
        FROM n
        UNION ALL SELECT 'web/docs', 'train', 'lang', rows, rows, false, 'completed' FROM n""",
    "import_states": """SELECT o_orderpriority AS dataset_id, 'train' AS split, 'text' AS columns,
            count(*) AS total_rows, count_if(o_orderstatus = 'F')::BIGINT AS completed_rows,
            -1::BIGINT AS last_saved_row
        FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority""",
    "translate_sparse_ids": f"""{TR_OF_TEXT}
        SELECT 1152921504606846976 + doc_id * doc_id * 7 AS id, doc_id, tr AS text
        FROM documents JOIN translated ON doc_id = id""",
    "translate_repeated_ids": f"""{TR_OF_TURNS}
        SELECT {REPEATED} AS row, turn, '[tr] ' || role AS role, tr AS text, 0::BIGINT AS failed_chunks
        FROM conversations JOIN translated ON {TURN_ID} = id""",
    "translate_plain_repeated_ids": f"""{TR_OF_TURNS}
        SELECT {REPEATED} AS row, text AS source, tr AS translation
        FROM conversations JOIN translated ON {TURN_ID} = id""",
    "translation_pairs_repeated_ids": f"""{TR_OF_TURNS}
        SELECT {REPEATED} AS row, 'text' AS "column", 0 AS leaf_ord, '$' AS path, text AS source,
            tr AS target
        FROM conversations JOIN translated ON {TURN_ID} = id""",
    "translate_dataset_repeated_ids": f"""{TR_OF_TURNS}
        SELECT {REPEATED} AS row, turn AS _key, role AS _found_0, tr AS text
        FROM conversations JOIN translated ON {TURN_ID} = id""",
    "translate_stopped_within": f"""{TR_OF_TEXT}
        SELECT doc_id, tr AS text, lang, source, n_chars
        FROM documents JOIN translated ON doc_id = id""",
    "stream_repeated_batch": f"""{TR_OF_TEXT}
        SELECT doc_id, tr AS text, lang, source, n_chars
        FROM documents JOIN translated ON doc_id = id""",
    "stream_stopped": f"""{TR_OF_TEXT}
        SELECT doc_id, tr AS text, lang, source, n_chars
        FROM documents JOIN translated ON doc_id = id""",
    "stream_progress": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}
        SELECT batch, rows_read, rows_read AS rows, failed_chunks FROM (
            SELECT (doc_id % 4) // 2 AS batch, count(*) AS rows_read FROM documents GROUP BY 1
        ) JOIN (
            SELECT (id % 4) // 2 AS batch, count(*) FILTER ({FAILS}) AS failed_chunks
            FROM chunk GROUP BY 1
        ) USING (batch)""",
    "error_state": """SELECT 'text' AS columns, count(*) AS total_rows, 0::BIGINT AS completed_rows,
            'error' AS status, '400: Failed to load model' AS message FROM documents
        UNION ALL SELECT 'lang', count(*), count(*), 'completed', NULL FROM documents""",
    "job_parameters": f"""SELECT {TURN_ID} AS turn_id, 'cell' AS "column", (place - 1)::INTEGER AS leaf_ord,
            '$[' || (place - 1) || '].role' AS path, role AS source, 'de>fr: ' || role AS target
        FROM (SELECT *, unnest(range(1, len(string_split(text, {NL})) + 1)) AS place FROM conversations)""",
    "translate_stopped": f"""{TR_OF_TEXT}
        SELECT doc_id, tr AS text, lang, source, n_chars
        FROM documents JOIN translated ON doc_id = id""",
    "two_results": f"""{TR_OF_TEXT}
        SELECT doc_id, '[tr] ' || lang AS lang, txt AS source, tr AS translation
        FROM documents JOIN src ON doc_id = src.id JOIN translated ON doc_id = translated.id""",
    "load_split_limit": f"""SELECT doc_id AS row_id, text, source, n_chars FROM documents
        WHERE lang = 'de' ORDER BY doc_id LIMIT {FIRST_ROWS}""",
    "column_report_many_keys": """
        WITH keys AS (
            SELECT 'k' || o_orderkey AS key,
                (row_number() OVER (ORDER BY 'k' || o_orderkey) - 1) // 200 AS part
            FROM (SELECT DISTINCT o_orderkey FROM orders)
        )
        SELECT 'cell' AS "column", 0 AS section, 0::BIGINT AS part,
            'cell: JSON detected (' || count(*) || '/' || count(*) || ' rows)' AS line FROM orders
        UNION ALL
        SELECT 'cell', 3, part::BIGINT, 'Untouched: ' || string_agg(key, ', ' ORDER BY key)
        FROM keys GROUP BY part""",
    "publish_card": card_sql("orders-tr", "orders", "o_orderkey", ORDER_COLUMNS),
    "prompt_sent": prompt_sql("general"),
    "prompt_sent_translation_model": prompt_sql("translation_model"),
    "estimate_tokens": f"""
        SELECT 'page-' || page_id AS id, {tokens_sql('html')} AS tokens FROM pages
        UNION ALL SELECT 'doc-' || doc_id, {tokens_sql('cell')} FROM ({GAPPY})""",
    "split_boundaries": f"""
        SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos,
               unnest(parts) AS part
        FROM (SELECT doc_id, {split_sql('text')} AS parts FROM documents)""",
    "pack_chunks": f"""
        SELECT doc_id, CAST(generate_subscripts(packed, 1) - 1 AS INTEGER) AS pos,
               unnest(packed) AS chunk
        FROM (
            SELECT doc_id, {pack_sql('parts', char_budget(CHUNK_TOKENS))} AS packed
            FROM (SELECT doc_id, {split_sql('text')} AS parts FROM documents))""",
    "chunk_table": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}
        SELECT id AS doc_id, chunk_idx, chunk, {tokens_sql('chunk')} AS est_tokens FROM chunk""",
    "chunk_deep": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, SMALL_TOKENS)}
        SELECT id AS doc_id, chunk_idx, chunk, {tokens_sql('chunk')} AS est_tokens FROM chunk""",
    "chunk_pages": f"""WITH RECURSIVE
        {chunk_ctes('SELECT page_id AS id, html AS txt FROM pages', CHUNK_TOKENS)}
        SELECT id AS page_id, chunk_idx, chunk, {tokens_sql('chunk')} AS est_tokens FROM chunk""",
    "join_chunks": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}
        SELECT id AS doc_id, string_agg(chunk, ' ' ORDER BY chunk_idx) AS text
        FROM chunk GROUP BY id""",
    "render_prompt": prompt_sql("general"),
    "render_prompt_translation_model": prompt_sql("translation_model"),
    "is_json_cell": f"SELECT id, {IS_JSON} AS is_json FROM ({ANY_CELLS})",
    "cell_kind": f"""SELECT id, CASE WHEN cell IS NULL THEN 'empty' WHEN {IS_VALUE} THEN 'json'
        ELSE 'text' END AS kind FROM ({ANY_CELLS})""",
    "route_cell": f"""
        SELECT id, route AS auto, route AS force,
               CASE WHEN route = 'skip' THEN 'skip' ELSE 'plain' END AS off
        FROM (SELECT id, CASE WHEN {BLANK} THEN 'skip' WHEN {IS_JSON} THEN 'json' ELSE 'plain' END
            AS route FROM ({ANY_CELLS}))""",
    "job_key": "SELECT doc_id, sha256(source || '::' || lang)[:12] AS key FROM documents",
    "safe_name": "SELECT page_id, translate(url, '/\\', '__') AS name FROM pages",
    "json_leaves": leaves_sql(CHATS, "turn_id", "messages", TRANSLATE_KEYS, SKIP_KEYS),
    "json_leaves_skip": leaves_sql(CHATS, "turn_id", "messages", ("role", "content"), ("content",)),
    "json_leaves_nested": leaves_sql(NOTED, "doc_id", "note", TRANSLATE_KEYS, SKIP_KEYS),
    "json_rebuild": f"SELECT {TURN_ID} AS turn_id, {CHAT_TR} AS messages FROM conversations",
    "leaf_table": f"""
        SELECT turn_id, leaf_ord, path, text FROM ({leaves_sql(
            f"SELECT * FROM ({MIXED}) WHERE role = 'assistant'",
            "turn_id", "cell", TRANSLATE_KEYS, SKIP_KEYS)})
        UNION ALL
        SELECT turn_id, 0, '$', cell FROM ({MIXED}) WHERE role <> 'assistant'""",
    "unpivot_cells": """
        SELECT o_orderkey, 'o_orderstatus' AS "column", o_orderstatus AS cell FROM orders
        UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders
        UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
        UNION ALL SELECT o_orderkey, 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders""",
    "dedupe_chunks": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}
        SELECT DISTINCT chunk FROM chunk""",
    "translate_chunks": f"""WITH RECURSIVE
        {chunk_ctes('SELECT item_id AS id, text AS txt FROM benchmark', SMALL_TOKENS)}
        SELECT id AS item_id, chunk_idx, chunk, '[tr] ' || chunk AS tgt, 'ok' AS status,
               1 AS attempts FROM chunk""",
    "translate_status": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}
        SELECT id AS doc_id, chunk_idx, CASE WHEN NOT {FAILS} THEN '[tr] ' || chunk END AS tgt,
               CASE WHEN {FAILS} THEN 'failed' ELSE 'ok' END AS status FROM chunk""",
    "fallback_original": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)},
        done AS (SELECT id, string_agg('[tr] ' || chunk, ' ' ORDER BY chunk_idx) AS tr,
                        count(*) FILTER ({FAILS}) AS failed_chunks FROM chunk GROUP BY id)
        SELECT id AS doc_id, CASE WHEN failed_chunks = 0 THEN tr ELSE txt END AS text, failed_chunks
        FROM done JOIN src USING (id)""",
    "translation_memory": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}
        SELECT count(*) AS stored, CAST(sum(length(chunk) + 5) AS BIGINT) AS stored_chars,
               0::BIGINT AS left_over FROM (SELECT DISTINCT chunk FROM chunk)""",
    "memory_files": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}
        SELECT DISTINCT chunk, '[tr] ' || chunk AS tgt, TRUE AS few_files FROM chunk WHERE id % 10 = 7""",
    "translate_plain": f"""{TR_OF_TEXT}
        SELECT id AS doc_id, txt AS source, tr AS translation FROM src JOIN translated USING (id)""",
    "translate_json": f"""SELECT {TURN_ID} AS turn_id, role, {chat_text(STUB_LINE)} AS messages,
        0::BIGINT AS failed_chunks FROM conversations""",
    "translate_column": f"""WITH RECURSIVE {chunk_ctes(
            f"SELECT {TURN_ID} AS id, text AS txt FROM conversations WHERE role <> 'assistant'",
            CHUNK_TOKENS)}, {translated_sql()}
        SELECT id AS turn_id, tr AS cell, 0::BIGINT AS failed_chunks FROM translated
        UNION ALL SELECT {TURN_ID}, {CHAT_TR}, 0 FROM conversations WHERE role = 'assistant'""",
    "translate_blank": f"""{TR_OF_TEXT}
        SELECT doc_id, lang, CASE WHEN {BLANK} THEN cell ELSE tr END AS cell,
               0::BIGINT AS failed_chunks
        FROM ({GAPPY}) JOIN translated ON doc_id = id""",
    "translate_dataset": f"""{TR_OF_TEXT}
        SELECT doc_id, tr AS text, {NOTE_TR} AS note, lang
        FROM documents JOIN translated ON doc_id = id""",
    "translate_resumed": f"""{TR_OF_TEXT}
        SELECT doc_id, tr AS text, lang, source, n_chars
        FROM documents JOIN translated ON doc_id = id""",
    "translate_stream_files": f"""{TR_OF_TEXT}
        SELECT doc_id, tr AS text, lang, source, n_chars
        FROM documents JOIN translated ON doc_id = id""",
    "translation_pairs": f"""WITH RECURSIVE {chunk_ctes(
            f"SELECT {TURN_ID} AS id, text AS txt FROM conversations WHERE role <> 'assistant'",
            CHUNK_TOKENS)}, {translated_sql()}
        SELECT id AS turn_id, 'cell' AS "column", 0 AS leaf_ord, '$' AS path, txt AS source, tr AS target
        FROM src JOIN translated USING (id)
        UNION ALL
        SELECT turn_id, 'cell', leaf_ord, path, text, '[tr] ' || text FROM ({leaves_sql(
            f"SELECT * FROM ({MIXED}) WHERE role = 'assistant'",
            "turn_id", "cell", TRANSLATE_KEYS, SKIP_KEYS)})""",
    "observe_metrics": f"""WITH RECURSIVE {chunk_ctes(DOC_TEXT, CHUNK_TOKENS)}
        SELECT (SELECT count(*) FROM documents) AS rows,
               count(*) FILTER ({FAILS}) AS failed_chunks FROM chunk""",
    "canary": """SELECT 'working' AS backend, count(*) AS written FROM documents
        UNION ALL SELECT 'failing', 0""",
}
