"""The same results as plain SQL over the driver's tables, for the correctness check."""

from __future__ import annotations

from notemill.plans import standins as st

_PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"

# --- shared subqueries ---------------------------------------------------------------

_LINES = """
lines AS (
  SELECT doc_id, source, lang, line_no, line, n_lines
  FROM (SELECT doc_id, source, lang, len(string_split(text, chr(10))) AS n_lines,
               unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents)
  WHERE NOT (line_no = n_lines - 1 AND line = '')
)"""

_TOKENS = _LINES + f""",
token_lists AS (
  SELECT doc_id, source, lang, line_no, starts_with(line, ' ') AS leading_space,
         list_filter(string_split(trim(line), ' '), lambda t: trim(t) <> '') AS tokens
  FROM lines
),
tokens AS (
  SELECT doc_id, source, lang, line_no, leading_space, len(tokens) AS n_tokens, unnest(tokens) AS token,
         generate_subscripts(tokens, 1) - 1 AS pos
  FROM token_lists
),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(token, '{st.EMAIL_TOKEN}') THEN 'EMAIL'
                 WHEN regexp_matches(token, '{st.IP_TOKEN}') THEN 'IP'
                 WHEN regexp_matches(token, '{st.NUM_TOKEN}') THEN 'NUM'
                 WHEN regexp_matches(token, '{st.NAME_TOKEN}') THEN 'NAME' END AS kind
  FROM tokens
)"""

_CHUNKS = _TOKENS + """,
name_runs AS (
  SELECT doc_id, line_no, token, pos,
         pos - row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS run
  FROM kinds WHERE kind = 'NAME'
),
chunks AS (
  SELECT doc_id, line_no, pos AS first_pos, pos AS last_pos, kind AS type, token AS text
  FROM kinds WHERE kind <> 'NAME'
  UNION ALL
  SELECT doc_id, line_no, min(pos), max(pos), 'NAME', string_agg(token, ' ' ORDER BY pos)
  FROM name_runs GROUP BY doc_id, line_no, run
)"""

_BIO = _CHUNKS + f""",
edges AS (
  SELECT doc_id, line_no, max(n_tokens) AS n_tokens,
         max(CASE WHEN pos = n_tokens - 1 THEN token END) AS last_token,
         max(CASE WHEN pos = 0 THEN token END) AS first_token
  FROM tokens GROUP BY doc_id, line_no
),
wraps AS (
  SELECT a.doc_id, a.line_no, a.n_tokens - 1 AS pos, a.last_token, b.first_token
  FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1
  WHERE regexp_matches(a.last_token, '{st.WRAP_HEAD}') AND regexp_matches(b.first_token, '{st.WRAP_TAIL}')
),
bio AS (
  SELECT k.doc_id, k.source, k.lang, k.line_no, k.pos, k.token,
         CASE WHEN w.doc_id IS NOT NULL THEN 'B-WRAP'
              WHEN v.doc_id IS NOT NULL THEN 'I-WRAP'
              WHEN k.kind IS NULL THEN 'O'
              WHEN k.kind <> 'NAME' THEN 'B-' || k.kind
              WHEN lag(k.kind) OVER (PARTITION BY k.doc_id, k.line_no ORDER BY k.pos) = 'NAME' THEN 'I-NAME'
              ELSE 'B-NAME' END AS label
  FROM kinds k
  LEFT JOIN wraps w ON w.doc_id = k.doc_id AND w.line_no = k.line_no AND w.pos = k.pos
  LEFT JOIN wraps v ON v.doc_id = k.doc_id AND v.line_no + 1 = k.line_no AND k.pos = 0
)"""

_TAGS = """,
tags AS (
  SELECT tag, CAST(row_number() OVER (ORDER BY tag <> 'O', tag) - 1 AS INTEGER) AS tag_id
  FROM (SELECT DISTINCT label AS tag FROM bio)
)"""

_SOURCE_SPLIT = """
source_rank AS (
  SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT source FROM documents)
),
source_split AS (
  SELECT source, CASE WHEN r <= floor(CAST(0.9 AS DOUBLE) * n) THEN 'train' ELSE 'validation' END AS split
  FROM source_rank
)"""

_HALVES = """
{name}_rank AS (
  SELECT {id}, row_number() OVER (ORDER BY md5('42:' || CAST({id} AS VARCHAR)), {id}) AS r, count(*) OVER () AS n
  FROM {table}
),
{name} AS (
  SELECT {id}, CASE WHEN r <= floor(n / 2.0) THEN '{first}' ELSE '{second}' END AS split FROM {name}_rank
)"""


def _halves(name, table, key, first, second):
    return _HALVES.format(name=name, table=table, id=key, first=first, second=second)


_CHAR_SPANS = f"""
parts AS (
  SELECT doc_id, source, lang, text, string_split_regex(text, '{st.CHAR_SPAN}') AS gaps,
         regexp_extract_all(text, '{st.CHAR_SPAN}') AS hits
  FROM documents
),
gap_rows AS (
  SELECT doc_id, unnest(gaps) AS txt, generate_subscripts(gaps, 1) - 1 AS k, 0 AS hit FROM parts
),
hit_rows AS (
  SELECT doc_id, unnest(hits) AS txt, generate_subscripts(hits, 1) - 1 AS k, 1 AS hit FROM parts
),
pieces AS (
  SELECT *, k * 2 + hit AS n,
         coalesce(sum(length(txt)) OVER (PARTITION BY doc_id ORDER BY k * 2 + hit
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT * FROM gap_rows UNION ALL SELECT * FROM hit_rows)
),
char_spans AS (
  SELECT doc_id, CAST(k AS INTEGER) AS span_idx, CAST(off AS INTEGER) AS "begin",
         CAST(off + length(txt) AS INTEGER) AS "end",
         CASE WHEN contains(txt, '@') THEN 'EMAIL' WHEN regexp_matches(txt, '^[0-9]+$') THEN 'NUM' ELSE 'EDGE' END AS type,
         txt AS stated
  FROM pieces WHERE hit = 1
)"""

_CHAR_WORDS = "WITH " + _CHAR_SPANS + """,
typed AS (
  SELECT p.doc_id, p.n, p.txt, s.type,
         coalesce(sum(length(p.txt) - length(replace(p.txt, chr(10), ''))) OVER
           (PARTITION BY p.doc_id ORDER BY p.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line0
  FROM pieces p LEFT JOIN char_spans s ON s.doc_id = p.doc_id AND p.hit = 1 AND s.span_idx = p.k
),
subs AS (
  SELECT doc_id, n, type, line0, unnest(string_split(txt, chr(10))) AS sub,
         generate_subscripts(string_split(txt, chr(10)), 1) - 1 AS j
  FROM typed
),
words AS (
  SELECT doc_id, n, type, line0 + j AS line_no, j, unnest(string_split(sub, ' ')) AS token,
         generate_subscripts(string_split(sub, ' '), 1) AS w
  FROM subs
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
       CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY n, w) - 1 AS INTEGER) AS pos, token,
       CASE WHEN type IS NULL THEN 'O'
            WHEN j = 0 AND row_number() OVER (PARTITION BY doc_id, n, j ORDER BY w) = 1 THEN 'B-' || type
            ELSE 'I-' || type END AS label
FROM words WHERE token <> ''
"""

_VOCAB = f"""
vocab_counts AS (
  SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_PIECE}')) AS token FROM documents) GROUP BY token
),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id, n
  FROM vocab_counts QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 30000
  UNION ALL SELECT * FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 1, 0), ('[CLS]', 2, 0), ('[SEP]', 3, 0))
)"""


def _encoded(limit: int) -> str:
    return "WITH " + _VOCAB + f""",
doc_pieces AS (
  SELECT doc_id, regexp_extract_all(text, '{_PIECE}') AS p FROM documents
),
doc_tokens AS (
  SELECT doc_id, len(p) AS n_pieces, unnest(p) AS token, generate_subscripts(p, 1) AS pos FROM doc_pieces
),
encoded AS (
  SELECT d.doc_id, d.n_pieces, d.pos, coalesce(v.token_id, 1) AS input_id
  FROM doc_tokens d LEFT JOIN vocab v ON v.token = d.token AND v.token_id > 3 WHERE d.pos <= {limit} - 2
  UNION ALL SELECT doc_id, len(p), 0, 2 FROM doc_pieces
  UNION ALL SELECT doc_id, len(p), least(len(p), {limit} - 2) + 1, 3 FROM doc_pieces
)"""


_WORD_COUNTS = f"""
word_counts AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_PIECE}')) AS word FROM documents) GROUP BY word
),
spelled AS (
  SELECT word, n, list_transform(regexp_extract_all(word, '.'), lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END) AS parts
  FROM word_counts
)"""

_MERGES = _WORD_COUNTS + """,
state AS (
  SELECT 0 AS step, '' AS l, '' AS r, CAST(0 AS BIGINT) AS pair_n, word, n, '<' || array_to_string(parts, '><') || '>' AS symbols
  FROM spelled
  UNION ALL
  SELECT step + 1, best.l, best.r, best.c, word, n,
         replace(symbols, '<' || best.l || '><' || best.r || '>', '<' || best.l || substr(best.r, 3) || '>')
  FROM state, (
    SELECT l, r, CAST(sum(n) AS BIGINT) AS c FROM (
      SELECT n, unnest(regexp_extract_all(symbols, '<([^>]*)>', 1)[:-2]) AS l, unnest(regexp_extract_all(symbols, '<([^>]*)>', 1)[2:]) AS r
      FROM state WHERE length(word) > 1
    ) GROUP BY l, r HAVING sum(n) >= 2 ORDER BY c DESC, l, r LIMIT 1
  ) best WHERE step < 100
),
merges AS (SELECT DISTINCT step, l, r, l || substr(r, 3) AS piece, pair_n FROM state WHERE step > 0)"""

_PIECE_VOCAB = _WORD_COUNTS + """,
cut_parts AS (
  SELECT DISTINCT word, n, token FROM (
    SELECT word, n, word AS token FROM word_counts
    UNION ALL SELECT word, n, substr(word, 1, k) FROM word_counts, range(1, 5) t(k) WHERE k <= length(word)
    UNION ALL SELECT word, n, '##' || substr(word, p, k) FROM word_counts, range(2, 200) q(p), range(1, 5) t(k) WHERE p + k - 1 <= length(word)
  )
),
piece_vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id
  FROM (SELECT token, sum(n) AS n FROM cut_parts GROUP BY token)
  QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 30000
),
matched AS (
  SELECT word, 1 AS p, CAST([] AS INTEGER[]) AS ids FROM word_counts
  UNION ALL
  SELECT word, p + size, list_append(ids, token_id) FROM (
    SELECT m.word, m.p, m.ids, k AS size, v.token_id, row_number() OVER (PARTITION BY m.word ORDER BY k DESC) AS best
    FROM matched m, range(1, 200) t(k), piece_vocab v
    WHERE m.p + k - 1 <= length(m.word) AND v.token = CASE WHEN m.p = 1 THEN '' ELSE '##' END || substr(m.word, m.p, k)
  ) WHERE best = 1
),
word_ids AS (
  SELECT w.word, coalesce(max(m.ids), [1]) AS ids FROM word_counts w
  LEFT JOIN matched m ON m.word = w.word AND m.p = length(m.word) + 1 GROUP BY w.word
),
doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '__PIECE__')) AS word,
         generate_subscripts(regexp_extract_all(text, '__PIECE__'), 1) AS pos FROM documents
),
doc_ids AS (
  SELECT doc_id, coalesce(flatten(list(ids ORDER BY pos)), []) AS ids
  FROM documents LEFT JOIN (SELECT * FROM doc_words JOIN word_ids USING (word)) USING (doc_id) GROUP BY doc_id
)""".replace("__PIECE__", _PIECE)


_WORD_PIECES = f"""
word_pieces AS (
  SELECT doc_id, line_no, token_pos, label, piece,
         row_number() OVER (PARTITION BY doc_id, line_no ORDER BY token_pos, sub) AS pos
  FROM (SELECT doc_id, line_no, pos AS token_pos, label, unnest(regexp_extract_all(token, '{_PIECE}')) AS piece,
               generate_subscripts(regexp_extract_all(token, '{_PIECE}'), 1) AS sub
        FROM bio)
),
kept AS (SELECT * FROM word_pieces WHERE pos <= 478),
line_ends AS (SELECT doc_id, line_no, max(pos) + 1 AS pos FROM kept GROUP BY doc_id, line_no),
coded AS (
  SELECT k.doc_id, k.line_no, k.pos, coalesce(v.token_id, 1) AS input_id, k.token_pos AS word_id, t.tag_id AS label_id
  FROM kept k LEFT JOIN vocab v ON v.token = k.piece AND v.token_id > 3 JOIN tags t ON t.tag = k.label
  UNION ALL SELECT doc_id, line_no, 0, 2, NULL, -100 FROM line_ends
  UNION ALL SELECT doc_id, line_no, pos, 3, NULL, -100 FROM line_ends
)"""

_CODED = "WITH " + _BIO + _TAGS + "," + _VOCAB + "," + _WORD_PIECES

_SCORED = """
raw AS (SELECT vec_id, label, [""" + ", ".join(
    f"list_sum(list_transform(range({k}, len(embedding), 10), lambda i: CAST(embedding[i + 1] AS DOUBLE)))" for k in range(10)
) + """] AS z FROM embeddings),
exps AS (SELECT vec_id, label, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM raw),
scored AS (
  SELECT vec_id, label, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS prediction,
         list_transform(e, lambda x: x / list_sum(e)) AS probs FROM exps
)"""

_CLASS = _SCORED + """,
sides AS (
  SELECT label AS cls, 1 AS support, 0 AS predicted, CASE WHEN label = prediction THEN 1 ELSE 0 END AS hits FROM scored
  UNION ALL SELECT prediction, 0, 1, 0 FROM scored
),
per_class AS (
  SELECT cls, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(hits) AS BIGINT) AS hits
  FROM sides GROUP BY cls
),
class_scores AS (
  SELECT *, CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS recall,
         2 * CAST(hits AS DOUBLE) / (support + predicted) AS f1
  FROM per_class
)"""

_OVR = """,
long AS (
  SELECT label, unnest(probs) AS score, generate_subscripts(probs, 1) - 1 AS cls FROM scored
),
ovr_counts AS (
  SELECT cls, score, sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label = cls THEN 0 ELSE 1 END) AS n
  FROM long GROUP BY cls, score
),
ovr_below AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM ovr_counts
),
ovr AS (
  SELECT cls, sum(CAST(p AS DOUBLE) * (below + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc
  FROM ovr_below GROUP BY cls
)"""

_AUC_ROWS = """
score_rows AS (
  SELECT d.doc_id, l.quality, l.toxic, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
)"""


def _below(label: str) -> str:
    return f""",
score_counts AS (
  SELECT score, CAST(sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
  FROM score_rows GROUP BY score
),
below AS (
  SELECT *, CAST(coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS neg_below
  FROM score_counts
)"""


_HISTORY = """
history AS (
  SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step,
         ts, event_type, value AS metric
  FROM events
)"""

_BEST = _HISTORY + """,
best AS (
  SELECT run, step AS best_step, metric FROM history
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY metric DESC, step) = 1
)"""

_TASK = """CASE event_type WHEN 'view' THEN 'mimic-mp' WHEN 'click' THEN 'mednli' WHEN 'error' THEN 'ICD9-Triage'
           WHEN 'signup' THEN 'i2b2-2010-NER' ELSE 'mimic-note-category' END"""
_MODEL = """CASE event_type WHEN 'view' THEN 'roberta-base' WHEN 'click' THEN 'tiny-bert'
            WHEN 'error' THEN '2_anch_declutr_run' WHEN 'signup' THEN 'simcse-mimic' ELSE 'custom_pretraining-7' END"""
_NAMED = f"""
named AS (
  SELECT event_id, ts, value, {_TASK} AS task, {_MODEL} AS model,
         CASE WHEN value > 20 THEN 'LORA' ELSE 'Full' END AS method,
         CASE event_type WHEN 'view' THEN 'fewshot_64' WHEN 'click' THEN 'fewshot_16' ELSE 'full' END AS size
  FROM events
),
paths AS (
  SELECT *, 'logs/' || task || '/' || size || '/' || model || '/' || method || '/' ||
         strftime(ts, '%d-%m-%Y--%H-%M') || '/' AS path
  FROM named
)"""

_TENSORS = """
tensors AS (
  SELECT 'm' || CAST(l_suppkey AS VARCHAR) AS model, l_returnflag AS method, CAST(l_quantity * 1000 AS BIGINT) AS numel,
         CASE WHEN l_linestatus = 'O' THEN 4 ELSE 2 END AS element_size, l_linestatus = 'O' AS requires_grad,
         l_linenumber = 7 AS is_buffer
  FROM lineitem
),
counts AS (
  SELECT model, method,
         CAST(sum(CASE WHEN requires_grad AND NOT is_buffer THEN numel ELSE 0 END) AS BIGINT) AS n_trainable_params,
         CAST(sum(CASE WHEN NOT is_buffer THEN numel ELSE 0 END) AS BIGINT) AS total_params
  FROM tensors GROUP BY model, method
)"""

_PAIRS = f"""
pairs AS (
  SELECT u.conv_id, u.turn, regexp_extract_all(u.text, '{_PIECE}') AS pa, regexp_extract_all(s.text, '{_PIECE}') AS pb
  FROM conversations u JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn + 1
  WHERE u.role = 'user' AND s.role = 'assistant'
),
sized AS (SELECT *, CAST(len(pa) AS INTEGER) AS a, CAST(len(pb) AS INTEGER) AS b FROM pairs),
budget AS (
  SELECT *, CAST(CASE WHEN a + b <= 477 OR a <= 239 THEN a WHEN b <= 238 THEN 477 - b ELSE 239 END AS INTEGER) AS keep_a,
         CAST(CASE WHEN a + b <= 477 THEN b WHEN a <= 239 THEN 477 - a WHEN b <= 238 THEN b ELSE 238 END AS INTEGER) AS keep_b
  FROM sized
)"""


ORACLES: dict[str, str] = {
    "class_count": "WITH " + _halves("h", "labels", "doc_id", "validation", "train") + """
SELECT count(DISTINCT l.quality) AS n_classes
FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN h ON h.doc_id = l.doc_id WHERE h.split = 'train'""",
    "class_sizes": "SELECT quality, count(*) AS n FROM labels GROUP BY quality",
    "rows_of_class": "SELECT doc_id, quality FROM labels WHERE toxic = 1",
    "split_sizes": "WITH " + _LINES + "," + _SOURCE_SPLIT + """
SELECT split, count(DISTINCT doc_id) AS n_docs, count(*) AS n_sentences
FROM lines JOIN source_split USING (source) GROUP BY split""",
    "fewshot_labels": """
SELECT doc_id, quality FROM labels
QUALIFY row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= 64""",
    "fewshot_embeddings": """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width FROM embeddings
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) <= 8""",
    "fewshot_splits": "WITH " + _halves("h", "labels", "doc_id", "train", "validation") + """,
sampled AS (
  SELECT doc_id, toxic, split FROM labels JOIN h USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY split, toxic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
          <= CASE split WHEN 'train' THEN 16 ELSE 8 END
),
held AS (SELECT doc_id FROM sampled WHERE split = 'validation'),
""" + _halves("q", "held", "doc_id", "validation", "test").strip() + """
SELECT doc_id, toxic, coalesce(q.split, s.split) AS split FROM sampled s LEFT JOIN q USING (doc_id)""",
    "group_split_90_10": "WITH " + _SOURCE_SPLIT + "SELECT doc_id, source, split FROM documents JOIN source_split USING (source)",
    "split_by_site": """
WITH g AS (SELECT DISTINCT lang, doc_id % 97 AS patient FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(patient AS VARCHAR)), patient) AS r,
             count(*) OVER (PARTITION BY lang) AS n FROM g)
SELECT d.doc_id, d.lang, r.patient,
       CASE WHEN r.r <= floor(CAST(0.9 AS DOUBLE) * r.n) THEN 'train' ELSE 'validation' END AS split
FROM documents d JOIN r ON r.lang = d.lang AND r.patient = d.doc_id % 97""",
    "row_split_50_50": "WITH " + _halves("h", "documents", "doc_id", "validation", "test") + "SELECT doc_id, split FROM h",
    "seeded_shuffle_rank": """
SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents""",
    "preview_row": """
SELECT doc_id, text FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 1 OFFSET 1""",
    "merge_corpora": """
SELECT corpus, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
  SELECT 'documents' AS corpus, lang, text FROM documents
  UNION ALL SELECT 'turns', NULL, text FROM conversations
  UNION ALL SELECT 'pages', NULL, html FROM pages) GROUP BY corpus, lang""",
    "id_set_mismatch": """
SELECT doc_id, 'left' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "sentences_by_group": "WITH " + _TOKENS + "," + _SOURCE_SPLIT + """
SELECT split, source, count(*) AS n_sentences, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens
FROM token_lists JOIN source_split USING (source) WHERE len(tokens) > 0 GROUP BY split, source""",
    "token_grid": "WITH " + _TOKENS + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, leading_space, CAST(pos AS INTEGER) AS pos, token FROM tokens""",
    "line_offsets": """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
       CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line_start,
       CAST(length(line) AS INTEGER) AS line_len FROM l""",
    "pii_spans": "WITH " + _CHUNKS + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(first_pos AS INTEGER) AS first_pos,
       CAST(last_pos AS INTEGER) AS last_pos, type, text FROM chunks WHERE type <> 'NAME'""",
    "cap_spans": "WITH " + _CHUNKS + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(first_pos AS INTEGER) AS first_pos,
       CAST(last_pos AS INTEGER) AS last_pos, type, text FROM chunks WHERE type = 'NAME'""",
    "attach_spans": "WITH " + _CHAR_SPANS + """
SELECT d.doc_id, d.lang, coalesce(s."begin", -1) AS "begin", s.type FROM documents d LEFT JOIN char_spans s ON s.doc_id = d.doc_id""",
    "bio_token_spans": "WITH " + _BIO + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(pos AS INTEGER) AS pos, token, label FROM bio""",
    "bio_char_spans": _CHAR_WORDS,
    "xml_event_labels": _CHAR_WORDS,
    "xml_spans": "WITH " + _CHAR_SPANS + """
SELECT doc_id, span_idx, "begin", "end", type, replace(stated, chr(10), ' ') AS stated FROM char_spans""",
    "span_locations": "WITH " + _CHAR_SPANS + """,
offs AS (
  SELECT s.doc_id, s.span_idx, s.stated, left(d.text, s."begin") AS before
  FROM char_spans s JOIN documents d ON d.doc_id = s.doc_id
),
starts AS (
  SELECT *, length(before) - length(replace(before, chr(10), '')) AS l0,
         length(string_split(before, chr(10))[-1]) AS c0 FROM offs
)
SELECT doc_id, span_idx, CAST(l0 AS INTEGER) AS start_line, CAST(c0 AS INTEGER) AS start_char,
       CAST(l0 + length(stated) - length(replace(stated, chr(10), '')) AS INTEGER) AS end_line,
       CAST(CASE WHEN contains(stated, chr(10)) THEN length(string_split(stated, chr(10))[-1]) - 1
                 ELSE c0 + length(stated) - 1 END AS INTEGER) AS end_char
FROM starts""",
    "span_text_check": "WITH " + _CHAR_SPANS + """
SELECT doc_id, span_idx, replace(stated, chr(10), ' ') AS observed, lower(replace(stated, chr(10), ' ')) AS expected
FROM char_spans WHERE stated <> lower(stated)""",
    "token_span_check": "WITH " + _CHUNKS + """
SELECT doc_id, CAST(line_no * 2097152 + first_pos AS BIGINT) AS span_idx, lower(text) AS observed,
       replace(lower(text), 'z', 's') AS stated FROM chunks WHERE contains(lower(text), 'z')""",
    "concept_lines": "WITH " + _CHUNKS + """
SELECT doc_id, CAST(line_no + 1 AS INTEGER) AS start_line, CAST(first_pos AS INTEGER) AS start_pos,
       CAST(line_no + 1 AS INTEGER) AS end_line, CAST(last_pos AS INTEGER) AS end_pos, lower(type) AS type, lower(text) AS stated
FROM chunks""",
    "corrections_overlay": "WITH " + _LINES + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
       CASE source WHEN 'src3' THEN left(line, 2) || '    ' || substring(line, 3) ELSE '> ' || line END AS line
FROM lines WHERE (source = 'src3' AND contains(line, '.')) OR (source = 'src7' AND contains(line, '@'))""",
    "span_corrections": "WITH " + _CHAR_SPANS + """
SELECT type, CASE WHEN type = 'NUM' AND stated = '2024' THEN 'year' ELSE stated END AS stated, count(*) AS n
FROM char_spans GROUP BY ALL""",
    "label_format_violations": "WITH " + _BIO + """
SELECT replace(label, 'B-', 'S-') AS tag, count(*) AS n FROM bio WHERE lang = 'de' AND starts_with(label, 'B-') GROUP BY ALL""",
    "label_vocab": "WITH " + _BIO + """,
types AS (SELECT DISTINCT type FROM chunks UNION SELECT DISTINCT 'WRAP' FROM wraps)
SELECT 'B-' || type AS tag FROM types UNION ALL SELECT 'I-' || type FROM types UNION ALL SELECT 'O'""",
    "tag_vocab": "WITH " + _BIO + _TAGS + "SELECT tag, tag_id FROM tags",
    "tag_count": "WITH " + _BIO + "SELECT count(DISTINCT label) AS n_tags FROM bio",
    "tag_encode": "WITH " + _BIO + _TAGS + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(pos AS INTEGER) AS pos, tag_id, tag FROM bio JOIN tags ON tag = label""",
    "label_histogram": "WITH " + _BIO + "SELECT label AS tag, count(*) AS n FROM bio GROUP BY label",
    "unseen_labels": "WITH " + _TOKENS + "," + _SOURCE_SPLIT + """,
named AS (
  SELECT split, CASE WHEN regexp_matches(token, '^[A-Z][a-z]') THEN 'B-' || left(token, 3) ELSE 'O' END AS tag
  FROM tokens JOIN source_split USING (source)
)
SELECT tag, count(*) AS n FROM named
WHERE split = 'validation' AND tag NOT IN (SELECT tag FROM named WHERE split = 'train') GROUP BY tag""",
    "conll_lines": "WITH " + _BIO + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, string_agg(token || ' ' || label, chr(10) ORDER BY pos) AS value
FROM bio GROUP BY doc_id, line_no""",
    "conll_roundtrip": "WITH " + _BIO + "," + _SOURCE_SPLIT + """
SELECT split, string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(label, ' ' ORDER BY pos) AS tags
FROM bio JOIN source_split USING (source) GROUP BY split, doc_id, line_no""",
    "conll_compat": "WITH " + _BIO + "," + _SOURCE_SPLIT + """
SELECT split, string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(label, ' ' ORDER BY pos) AS tags
FROM bio JOIN source_split USING (source) GROUP BY split, doc_id, line_no
UNION ALL SELECT split, '', '' FROM token_lists JOIN source_split USING (source), range(2) WHERE len(tokens) = 0""",
    "xml_dataset_flow": "WITH cw AS (" + _CHAR_WORDS + """),
patients AS (SELECT DISTINCT CAST(left(CAST(doc_id AS VARCHAR), 2) AS INTEGER) AS patient FROM cw),
ranked AS (
  SELECT patient, row_number() OVER (ORDER BY md5('42:' || CAST(patient AS VARCHAR)), patient) AS r, count(*) OVER () AS n FROM patients
)
SELECT CASE WHEN r <= floor(CAST(0.9 AS DOUBLE) * n) THEN 'train' ELSE 'validation' END AS split,
       string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(label, ' ' ORDER BY pos) AS tags
FROM cw JOIN ranked ON patient = CAST(left(CAST(doc_id AS VARCHAR), 2) AS INTEGER) GROUP BY doc_id, line_no, r, n""",
    "label_vocab_file": "WITH " + _BIO + _TAGS + "SELECT CAST(tag_id AS BIGINT) AS tag_id, tag FROM tags",
    "accounting_files": "WITH " + _TENSORS + """
SELECT 'yaml' AS kind, model, method, total_params AS total, n_trainable_params AS trainable FROM counts
UNION ALL SELECT 'json-two', model, method, total_params, -1 FROM counts
UNION ALL SELECT 'json-flat', model, NULL, CAST(sum(total_params) AS BIGINT), -1 FROM counts GROUP BY model""",
    "run_dir_scan": "WITH " + _NAMED + "SELECT DISTINCT task, method FROM named",
    "blank_types_dropped": "WITH " + _CHAR_SPANS + "SELECT type, count(*) AS n FROM char_spans WHERE type <> 'NUM' GROUP BY type",
    "unencodable_dropped": "WITH " + _TOKENS + r"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, string_agg(token, ' ' ORDER BY pos) AS tokens
FROM tokens WHERE regexp_matches(token, '[\p{L}\p{N}]') GROUP BY doc_id, line_no""",
    "task_columns": """
SELECT doc_id, quality AS labels, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 50""",
    "task_columns_whole": "SELECT doc_id, quality AS labels, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id)",
    "linear_probe_facts": """
SELECT count(*) - count(*) // 2 AS n_scored, CAST(10 AS INTEGER) AS n_classes, true AS shares_sum_to_one, true AS largest_share_wins
FROM embeddings""",
    "text_classifier_facts": """
SELECT CAST(14 AS INTEGER) AS n_scores, count(*) > 0 AS in_range, count(*) > 0 AS micro_is_accuracy FROM labels""",
    "token_classifier_facts": "WITH " + _BIO + "," + _SOURCE_SPLIT + """,
held AS (SELECT label, count(*) AS n FROM bio JOIN source_split USING (source) WHERE split = 'validation' GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS n_tokens, CAST(max(n) AS BIGINT) AS n_most, true AS beats_majority FROM held""",
    "token_model_facts": "WITH " + _TOKENS + "," + _SOURCE_SPLIT + """
SELECT count(*) AS n_sentences, CAST(0 AS BIGINT) AS n_breaks, true AS a_tag_each, true AS at_least_plain
FROM token_lists JOIN source_split USING (source) WHERE split = 'validation' AND len(tokens) > 0""",
    "search_facts": """
SELECT CAST(20 AS BIGINT) AS n_trials, CAST(20 AS BIGINT) AS n_numbers, count(*) > 0 AS in_space, count(*) > 0 AS in_range FROM embeddings""",
    "search_resumed": """
SELECT CAST(20 AS BIGINT) AS n_trials, CAST(20 AS BIGINT) AS n_numbers, CAST(12 AS BIGINT) AS n_kept, 12 AS n_first, 8 AS n_resumed""",
    "sentence_order": "WITH " + _TOKENS + "," + _SOURCE_SPLIT + """
SELECT split, source, doc_id, CAST(line_no AS INTEGER) AS line_no, row_number() OVER (PARTITION BY split, source ORDER BY doc_id, line_no) AS place
FROM token_lists JOIN source_split USING (source) WHERE len(tokens) > 0""",
    "entity_unescape": "WITH " + _TOKENS + "SELECT true AS same, count(*) AS n FROM tokens WHERE contains(token, ',')",
    "csv_roundtrip": "WITH " + _halves("h", "labels", "doc_id", "train", "validation") + """,
held AS (SELECT doc_id FROM h WHERE split = 'validation'),
""" + _halves("q", "held", "doc_id", "validation", "test").strip() + """
SELECT l.doc_id, l.quality, coalesce(q.split, h.split) AS split, md5(d.text) AS text_md5
FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN h ON h.doc_id = l.doc_id LEFT JOIN q ON q.doc_id = l.doc_id""",
    "sentence_ids": """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
       CAST(coalesce(sum(CASE WHEN ends_with(line, '.') OR trim(line) = '' THEN 1 ELSE 0 END) OVER
            (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent_id
FROM l""",
    "length_split": "WITH RECURSIVE " + _TOKENS + f""",
lens AS (
  SELECT doc_id, line_no, list_transform(tokens, lambda t: len(regexp_extract_all(t, '{_PIECE}'))) AS lens
  FROM token_lists WHERE len(tokens) > 0
),
steps AS (
  SELECT doc_id, line_no, lens, 0 AS i, CAST(0 AS BIGINT) AS cnt, 0 AS part, CAST(0 AS BIGINT) AS n FROM lens
  UNION ALL
  SELECT doc_id, line_no, lens, i + 1, CASE WHEN cnt + lens[i + 1] > 16 THEN 0 ELSE cnt + lens[i + 1] END,
         CASE WHEN cnt + lens[i + 1] > 16 THEN part + 1 ELSE part END, lens[i + 1]
  FROM steps WHERE i < len(lens)
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, part, CAST(count(*) AS INTEGER) AS n_tokens, CAST(sum(n) AS INTEGER) AS n_pieces
FROM steps WHERE i > 0 GROUP BY doc_id, line_no, part""",
    "subword_lengths": "WITH " + _TOKENS + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(sum(length(token)) AS INTEGER) AS n_pieces FROM tokens GROUP BY doc_id, line_no""",
    "word_vocab": "WITH " + _VOCAB + "SELECT token, token_id, n FROM vocab",
    "encode_text": _encoded(480) + """
SELECT doc_id, CAST(n_pieces AS INTEGER) AS n_pieces, CAST(pos AS INTEGER) AS pos, input_id FROM encoded""",
    "encode_words": _CODED + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(pos AS INTEGER) AS pos, input_id, CAST(coalesce(word_id, -1) AS INTEGER) AS word_id FROM coded""",
    "encode_subwords": "WITH RECURSIVE " + _PIECE_VOCAB + """
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN len(ids) + 2 > 480 THEN 1 ELSE 0 END) AS BIGINT) AS n_cut,
  CAST(sum(CASE WHEN len(ids) + 2 > 480 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS share_cut,
  CAST(max(len(ids)) AS INTEGER) AS max_pieces, CAST(sum(greatest(len(ids) + 2 - 480, 0)) AS BIGINT) AS pieces_lost FROM doc_ids""",
    "subword_match": "WITH RECURSIVE " + _PIECE_VOCAB + """
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_pieces,
  md5(array_to_string(list_transform([2] || ids || [3], lambda i: CAST(i AS VARCHAR)), ' ')) AS ids_md5 FROM doc_ids""",
    "subword_merges": "WITH RECURSIVE " + _MERGES + """
SELECT step, l AS left, r AS right, piece, pair_n AS n FROM merges""",
    "subword_encode": "WITH RECURSIVE " + _MERGES + f""",
alphabet AS (SELECT DISTINCT unnest(parts) AS token FROM spelled),
vocab AS (
  SELECT token, 3 + row_number() OVER (ORDER BY first, token) AS token_id FROM (
    SELECT token, min(step) AS first FROM (SELECT token, 0 AS step FROM alphabet UNION ALL SELECT piece, step FROM merges) GROUP BY token
  )
),
final AS (SELECT word, regexp_extract_all(symbols, '<([^>]*)>', 1) AS pieces FROM state QUALIFY step = max(step) OVER ()),
coded AS (
  SELECT word, list(token_id ORDER BY k) AS ids FROM (
    SELECT word, unnest(pieces) AS token, generate_subscripts(pieces, 1) AS k FROM final
  ) JOIN vocab USING (token) GROUP BY word
),
doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_PIECE}')) AS word, generate_subscripts(regexp_extract_all(text, '{_PIECE}'), 1) AS pos
  FROM documents
)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_pieces, md5(array_to_string(list_transform(ids, lambda i: CAST(i AS VARCHAR)), ' ')) AS ids_md5
FROM (
  SELECT doc_id, coalesce(flatten(list(ids ORDER BY pos)), []) AS ids
  FROM documents LEFT JOIN (SELECT * FROM doc_words JOIN coded USING (word)) USING (doc_id) GROUP BY doc_id
)""",
    "encode_pair_lengths": "WITH " + _PAIRS + "SELECT conv_id, turn, a, b, keep_a, keep_b FROM budget",
    "encode_pair": "WITH " + _VOCAB + "," + _PAIRS + """,
both_sides AS (
  SELECT conv_id, turn, 0 AS pos, '[CLS]' AS token FROM budget
  UNION ALL SELECT conv_id, turn, generate_subscripts(pa[1:keep_a], 1), unnest(pa[1:keep_a]) FROM budget
  UNION ALL SELECT conv_id, turn, keep_a + 1, '[SEP]' FROM budget
  UNION ALL SELECT conv_id, turn, keep_a + 1 + generate_subscripts(pb[1:keep_b], 1), unnest(pb[1:keep_b]) FROM budget
  UNION ALL SELECT conv_id, turn, keep_a + keep_b + 2, '[SEP]' FROM budget
)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, coalesce(token_id, 1) AS input_id
FROM both_sides LEFT JOIN vocab USING (token)""",
    "pad_batches": _encoded(480) + """,
lens AS (SELECT doc_id, count(*) AS n FROM encoded GROUP BY doc_id),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) // 32 AS batch_id FROM lens
),
padded AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS m FROM ranked)
SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(m AS INTEGER) AS padded_len, CAST(m AS INTEGER) AS length,
       CAST(n AS INTEGER) AS n_real, CAST(m - n AS INTEGER) AS n_pad FROM padded""",
    "truncation_report": f"""
WITH p AS (SELECT len(regexp_extract_all(text, '{_PIECE}')) AS n FROM documents)
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN n + 2 > 480 THEN 1 ELSE 0 END) AS BIGINT) AS n_cut,
       round(CAST(sum(CASE WHEN n + 2 > 480 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS share_cut,
       CAST(max(n) AS INTEGER) AS max_pieces, CAST(sum(greatest(n + 2 - 480, 0)) AS BIGINT) AS pieces_lost FROM p""",
    "decode_text": _encoded(480) + """
SELECT e.doc_id, string_agg(v.token, ' ' ORDER BY e.pos) AS decoded
FROM encoded e JOIN vocab v ON v.token_id = e.input_id GROUP BY e.doc_id""",
    "align_labels": _CODED + """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(pos AS INTEGER) AS pos, label_id FROM coded""",
    "align_first_pieces": _CODED + """
SELECT label_id, count(*) AS n FROM (
  SELECT CASE WHEN lag(word_id) OVER (PARTITION BY doc_id, line_no ORDER BY pos) = word_id THEN -100 ELSE label_id END AS label_id
  FROM coded) GROUP BY label_id""",
    "mask_filter": _CODED + """
SELECT CAST(input_id % 2 AS INTEGER) AS pred, label_id AS label, count(*) AS n FROM coded WHERE label_id <> -100 GROUP BY ALL""",
    "softmax_argmax": "WITH " + _SCORED + """
SELECT vec_id, prediction, round(list_max(probs), 6) AS p_max, round(probs[4], 6) AS p_3 FROM scored""",
    "confusion": "WITH " + _SCORED + "SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction",
    "class_scores": "WITH " + _CLASS + """
SELECT cls, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM class_scores""",
    "accuracy": "WITH " + _SCORED + """
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored""",
    "macro_scores": "WITH " + _CLASS + """
SELECT 'precision' AS name, round(avg(precision), 6) AS value FROM class_scores
UNION ALL SELECT 'recall', round(avg(recall), 6) FROM class_scores
UNION ALL SELECT 'f1_macro', round(avg(f1), 6) FROM class_scores
UNION ALL SELECT 'f1_micro', round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) FROM class_scores
UNION ALL SELECT 'f1_weighted', round(sum(f1 * support) / sum(support), 6) FROM class_scores""",
    "seq_cls_metrics": "WITH " + _CLASS + _OVR + """
SELECT round(avg(precision), 6) AS eval_precision, round(avg(recall), 6) AS eval_recall,
       round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS eval_accuracy, round(avg(f1), 6) AS eval_f1_macro,
       round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS eval_f1_micro,
       round(sum(f1 * support) / sum(support), 6) AS eval_f1_weighted,
       round((SELECT avg(auc) FROM ovr), 6) AS eval_roc_auc_macro FROM class_scores""",
    "auc_binary": "WITH " + _AUC_ROWS + _below("toxic") + """
SELECT round(sum(CAST(pos AS DOUBLE) * (neg_below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM below""",
    "auc_curve": "WITH " + _AUC_ROWS + _below("quality") + "SELECT score, pos, neg, neg_below FROM below",
    "auc_ovr_macro": "WITH " + _SCORED + _OVR + "SELECT round(avg(auc), 6) AS auc FROM ovr",
    "auc_undefined": "WITH " + _AUC_ROWS + """
SELECT CAST(CASE WHEN count(DISTINCT toxic) < 2 THEN 0.0 END AS DOUBLE) AS auc FROM score_rows WHERE toxic = 1""",
    "entity_chunks": "WITH " + _BIO + """,
flags AS (
  SELECT *, CASE WHEN label = 'O' THEN 0
                 WHEN starts_with(label, 'B-') THEN 1
                 WHEN coalesce(lag(label) OVER w, 'O') = 'O' THEN 1
                 WHEN substring(lag(label) OVER w, 3) <> substring(label, 3) THEN 1 ELSE 0 END AS opens
  FROM bio WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)
),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS island FROM flags)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(min(pos) AS INTEGER) AS first_pos, CAST(max(pos) AS INTEGER) AS last_pos,
       substring(min(label), 3) AS type
FROM islands WHERE label <> 'O' GROUP BY doc_id, line_no, island""",
    "entity_scores": "WITH " + _BIO + """,
flags AS (
  SELECT *, CASE WHEN label = 'O' THEN 0
                 WHEN starts_with(label, 'B-') THEN 1
                 WHEN coalesce(lag(label) OVER w, 'O') = 'O' THEN 1
                 WHEN substring(lag(label) OVER w, 3) <> substring(label, 3) THEN 1 ELSE 0 END AS opens
  FROM bio WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)
),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS island FROM flags),
true_chunks AS (
  SELECT doc_id, line_no, min(pos) AS first_pos, max(pos) AS last_pos, substring(min(label), 3) AS type
  FROM islands WHERE label <> 'O' GROUP BY doc_id, line_no, island
),
sums AS (
  SELECT CAST((SELECT count(*) FROM true_chunks JOIN chunks USING (doc_id, line_no, first_pos, last_pos, type)) AS DOUBLE) AS hits,
         CAST((SELECT count(*) FROM true_chunks) AS DOUBLE) AS t, CAST((SELECT count(*) FROM chunks) AS DOUBLE) AS p,
         (SELECT avg(CASE WHEN b.label = CASE WHEN k.kind IS NULL THEN 'O' WHEN k.kind = 'NAME' THEN 'I-NAME' ELSE 'B-' || k.kind END
                     THEN 1.0 ELSE 0.0 END) FROM bio b JOIN kinds k USING (doc_id, line_no, pos)) AS acc
)
SELECT round(hits / p, 6) AS precision, round(hits / t, 6) AS recall, round(2 * hits / (p + t), 6) AS f1, round(acc, 6) AS accuracy FROM sums""",
    "best_checkpoint": "WITH " + _BEST + "SELECT run, best_step, metric FROM best",
    "early_stop": "WITH " + _HISTORY + """,
seen AS (
  SELECT run, step, metric, max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM history
),
flags AS (SELECT run, step, CASE WHEN before IS NULL OR metric - before > CAST(0.5 AS DOUBLE) THEN step END AS good FROM seen),
waits AS (SELECT run, step, step - max(good) OVER (PARTITION BY run ORDER BY step) AS waited FROM flags)
SELECT run, CAST(min(CASE WHEN waited >= 5 THEN step END) AS INTEGER) AS stop_step,
       CAST(min(CASE WHEN waited >= 5 THEN step END) AS BIGINT) AS stop_eval, count(*) AS n_evals FROM waits GROUP BY run""",
    "live_early_stop": "WITH " + _HISTORY + """,
seen AS (
  SELECT run, step, ts, metric, max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM history
),
flags AS (SELECT run, step, ts, CASE WHEN before IS NULL OR metric - before > CAST(0.5 AS DOUBLE) THEN step END AS good FROM seen),
waits AS (SELECT run, step, ts, step - max(good) OVER (PARTITION BY run ORDER BY step) AS waited FROM flags)
SELECT run, CAST(min(CASE WHEN waited >= 5 THEN step END) AS BIGINT) AS stop_step,
       CAST(min(CASE WHEN waited >= 5 THEN step END) AS BIGINT) AS stop_eval, count(*) AS n_evals,
       min(ts) + INTERVAL 432000 SECOND < (SELECT max(ts) FROM history) AS spent FROM waits GROUP BY run""",
    "keep_latest": "WITH " + _BEST + """
SELECT run, step FROM history QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 2
UNION SELECT run, best_step FROM best""",
    "time_budget": "WITH " + _HISTORY + """,
timed AS (SELECT run, step, CAST(floor(epoch(ts - min(ts) OVER (PARTITION BY run))) AS BIGINT) AS elapsed FROM history),
ended AS (SELECT *, min(CASE WHEN elapsed > 432000 THEN step END) OVER (PARTITION BY run) AS last FROM timed)
SELECT run, step, elapsed, coalesce(step = last, false) AS stopped FROM ended WHERE last IS NULL OR step <= last""",
    "cadence": "WITH " + _HISTORY + "SELECT run, step, event_type FROM history WHERE step % 20 = 0 OR step = 1",
    "run_paths": "WITH " + _NAMED + "SELECT event_id, path FROM paths",
    "run_dirs": "WITH " + _NAMED + """
SELECT rtrim(path, '/') AS dir, count(*) AS n_files, CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_logs
FROM paths GROUP BY dir HAVING n_logs > 0""",
    "run_manifest": "WITH " + _NAMED + """,
grouped AS (SELECT task, model, method, count(*) AS n_runs FROM named GROUP BY ALL)
SELECT '{"task":"' || task || '","model":"' || model || '","method":"' || method || '","n_runs":' || CAST(n_runs AS VARCHAR) || '}' AS manifest
FROM grouped""",
    "warmup_steps": """
SELECT event_type, round(CAST(0.06 AS DOUBLE) * (count(*) / 32.0 * 5), 6) AS steps FROM events GROUP BY event_type""",
    "scaled_ranks": """
SELECT p_partkey, CAST(round_even(p_size * CAST(0.5 AS DOUBLE), 0) AS INTEGER) AS alpha FROM part""",
    "task_lookup": f"""
WITH kinds AS (SELECT {_TASK} AS task FROM events),
cat(task, task_type, label_name) AS (VALUES ('mimic-mp', 'SEQ_CLS', 'hospital_expire_flag'), ('mednli', 'SEQ_CLS', NULL),
  ('ICD9-Triage', 'SEQ_CLS', 'label'), ('i2b2-2010-NER', 'TOKEN_CLS', NULL))
SELECT k.task, c.task IS NOT NULL AS known, c.task_type, c.label_name,
       CASE k.task WHEN 'mednli' THEN 'sentence1' WHEN 'mimic-note-category' THEN 'TEXT' ELSE 'text' END AS text_column_1,
       CASE k.task WHEN 'mednli' THEN 'sentence2' END AS text_column_2, count(*) AS n
FROM kinds k LEFT JOIN cat c ON c.task = k.task GROUP BY ALL""",
    "live_budget": """
SELECT user_id AS run, CAST(floor(epoch(max(ts) - min(ts))) AS BIGINT) AS elapsed, max(value) AS best, count(*) AS n_rows,
       floor(epoch(max(ts) - min(ts))) > 1728000 AS spent FROM events GROUP BY user_id""",
    "param_budget": "WITH " + _TENSORS + """
SELECT model, method, n_trainable_params, total_params,
       round(CAST(n_trainable_params AS DOUBLE) / CAST(total_params AS DOUBLE) * 100, 6) AS n_trainable_params_perc FROM counts""",
    "size_report": "WITH " + _TENSORS + """,
sizes AS (
  SELECT model, CAST(sum(CASE WHEN requires_grad AND NOT is_buffer THEN numel ELSE 0 END) AS DOUBLE) * 4 / 1048576 AS mb,
         CAST(sum(CASE WHEN requires_grad OR is_buffer THEN numel * element_size ELSE 0 END) + sum(numel * 4 + 64) AS BIGINT) AS bytes
  FROM tensors GROUP BY model
)
SELECT model, round(mb, 6) AS "model_size_MB", round(mb / 1024, 6) AS "model_size_GB", bytes AS total_bytes,
       round(CAST(bytes AS DOUBLE) / 1048576, 6) AS "full_model_size_MB", round(CAST(bytes AS DOUBLE) / 1048576 / 1024, 6) AS "full_model_size_GB"
FROM sizes""",
    "method_matrix": "WITH " + _TENSORS + """
SELECT model, max(CASE WHEN method = 'A' THEN n_trainable_params END) AS "A", max(CASE WHEN method = 'N' THEN n_trainable_params END) AS "N",
       max(CASE WHEN method = 'R' THEN n_trainable_params END) AS "R" FROM counts GROUP BY model""",
    "accounting_join": "WITH " + _TENSORS + """,
best AS (
  SELECT 'm' || CAST(user_id AS VARCHAR) AS model, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'N' ELSE 'R' END AS method,
         max(value) AS best FROM events GROUP BY ALL
)
SELECT model, method, best, coalesce(n_trainable_params, -1) AS n_trainable_params FROM best LEFT JOIN counts USING (model, method)""",
    "xml_rejects": "WITH " + _CHAR_SPANS + """
SELECT doc_id, reason, count(*) AS n FROM (
  SELECT s.doc_id, CASE d.lang WHEN 'de' THEN 'begin or end is no number' ELSE 'element cannot be read' END AS reason
  FROM char_spans s JOIN documents d ON d.doc_id = s.doc_id WHERE d.lang IN ('de', 'es')
  UNION ALL SELECT doc_id, 'no text body' FROM documents WHERE lang = 'fr')
GROUP BY doc_id, reason""",
    "xml_sections": "WITH " + _CHAR_SPANS + """
SELECT doc_id, span_idx, "begin", "end", type, replace(stated, chr(10), ' ') AS stated FROM char_spans""",
    "concept_rejects": "WITH " + _CHUNKS + """
SELECT doc_id, count(*) AS n FROM chunks WHERE type = 'NUM' GROUP BY doc_id""",
    "split_null_site": """
WITH s AS (SELECT doc_id, nullif(lang, 'fr') AS lang, CASE WHEN doc_id % 97 > 0 THEN doc_id % 97 END AS patient FROM documents),
g AS (SELECT DISTINCT lang, patient FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '42', CAST(patient AS VARCHAR))), patient) AS r,
             count(*) OVER (PARTITION BY lang) AS n FROM g)
SELECT s.doc_id, s.lang, coalesce(s.patient, -1) AS patient,
       CASE WHEN r.r <= floor(CAST(0.9 AS DOUBLE) * r.n) THEN 'train' ELSE 'validation' END AS split
FROM s JOIN r ON r.lang IS NOT DISTINCT FROM s.lang AND r.patient IS NOT DISTINCT FROM s.patient""",
    "halves_repeated_ids": "WITH ids AS (SELECT DISTINCT conv_id FROM conversations)," + _halves("h", "ids", "conv_id", "validation", "test") + """
SELECT conv_id, turn, split FROM conversations JOIN h USING (conv_id)""",
}

ORACLES["dataset_roundtrip"] = ORACLES["conll_roundtrip"]
ORACLES["token_cls_metrics"] = ORACLES["entity_scores"]
ORACLES["note_files"] = ORACLES["bio_token_spans"]
ORACLES["note_files_unchecked"] = ORACLES["bio_token_spans"]
