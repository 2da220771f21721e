"""DuckDB SQL for the registered queries, written from the definitions, not from the Spark plans.

The state of event books is an explicit page-by-page fold here (a recursive query), where the engine
uses windows.
"""

from __future__ import annotations

from folio.functions.prompt import SECTIONS

_ONLY_SPACES = "trim(x) <> ''"

_EVENTS = """
e0 AS (SELECT CAST(user_id AS VARCHAR) AS book_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS page_index,
        CASE event_type WHEN 'signup' THEN 'toc' WHEN 'purchase' THEN 'chapter_opening' WHEN 'view' THEN 'body' WHEN 'click' THEN 'blank' ELSE 'figure_page' END AS page_type,
        event_id, event_type || ':' || event_id AS text, coalesce(value > 60, false) AS c_on, value, props FROM events),
e AS (SELECT *, coalesce(lag(c_on) OVER (PARTITION BY book_id ORDER BY page_index), false) AND page_index % 7 <> 0 AS c_prev FROM e0)"""

_FOLD = f"""WITH RECURSIVE {_EVENTS},
f AS (
  SELECT book_id, page_index, page_type, event_id, text, c_on, c_prev,
    CASE WHEN page_type = 'toc' THEN 'collecting' WHEN page_type IN ('chapter_opening', 'body') THEN 'absent' ELSE 'not_seen' END AS status,
    'not_seen' AS before, CAST([] AS VARCHAR[]) AS toc_b, 0 AS opened_b, CAST(NULL AS VARCHAR) AS tail_b, CAST(NULL AS VARCHAR) AS prev_type, CAST(NULL AS VARCHAR) AS title_b, 0 AS n_head_b,
    CASE WHEN page_type = 'toc' THEN ['PART ' || event_id % 5 || ' ....'] ELSE CAST([] AS VARCHAR[]) END AS toc, 0 AS opened,
    CASE WHEN page_type = 'chapter_opening' THEN page_index END AS sec, CASE WHEN page_type = 'chapter_opening' THEN 'Part ' || event_id % 5 END AS title,
    CASE WHEN page_type = 'chapter_opening' THEN 0 END AS toc_index, CASE WHEN page_type = 'chapter_opening' AND c_on THEN text END AS tail, CAST([] AS VARCHAR[]) AS heads
  FROM e WHERE page_index = 0
  UNION ALL
  SELECT book_id, page_index, page_type, event_id, text, c_on, c_prev, status, fin, toc, opened, tail, was, title, len(heads),
    CASE WHEN page_type = 'toc' AND fin IN ('not_seen', 'collecting') THEN list_append(toc, 'PART ' || event_id % 5 || ' ....') ELSE toc END,
    opened + CASE WHEN page_type = 'chapter_opening' AND status = 'committed' THEN 1 ELSE 0 END,
    CASE WHEN page_type = 'chapter_opening' THEN page_index ELSE sec END, CASE WHEN page_type = 'chapter_opening' THEN 'Part ' || event_id % 5 ELSE title END,
    CASE WHEN page_type = 'chapter_opening' THEN opened ELSE toc_index END,
    CASE WHEN page_type = 'toc' THEN tail WHEN (sec IS NOT NULL OR page_type = 'chapter_opening') AND c_on THEN text END,
    CASE WHEN page_type = 'chapter_opening' THEN CAST([] AS VARCHAR[]) WHEN page_type = 'body' AND sec IS NOT NULL
         THEN list_append(heads, (event_id % 4 + 1) || '/' || text || '/' || page_index) ELSE heads END
  FROM (SELECT *, CASE WHEN page_type = 'toc' THEN CASE WHEN fin IN ('not_seen', 'collecting') THEN 'collecting' ELSE fin END
                       WHEN fin = 'not_seen' AND page_type IN ('chapter_opening', 'body') THEN 'absent' ELSE fin END AS status
        FROM (SELECT x.book_id, x.page_index, x.page_type, x.event_id, x.text, x.c_on, x.c_prev, p.toc, p.opened, p.tail, p.sec, p.title, p.toc_index, p.heads, p.page_type AS was,
                     CASE WHEN p.status = 'collecting' AND x.page_type <> 'toc' THEN CASE WHEN len(p.toc) > 0 THEN 'committed' ELSE 'absent' END ELSE p.status END AS fin
              FROM f p JOIN e x ON x.book_id = p.book_id AND x.page_index = p.page_index + 1)))"""

# all documents as one book: the same fold over other rows, with headings of their own
_CORPUS = """
e0 AS (SELECT 'corpus' AS book_id, CAST(row_number() OVER (ORDER BY doc_id, md5(coalesce(text, ''))) - 1 AS INTEGER) AS page_index, doc_id AS event_id, right(coalesce(text, ''), 500) AS text, doc_id % 3 = 0 AS c_on, false AS c_prev FROM documents),
e AS MATERIALIZED (SELECT *, CASE WHEN page_index < 3 THEN 'blank' WHEN page_index < 12 OR event_id % 97 = 0 THEN 'toc' WHEN event_id % 10 = 0 THEN 'chapter_opening' WHEN event_id % 7 = 0 THEN 'figure_page' ELSE 'body' END AS page_type FROM e0)"""
_CORPUS_FOLD = _FOLD.replace(_EVENTS, _CORPUS).replace("|| text || '/' || page_index", "|| 'Heading ' || event_id || '/' || page_index")


_EVENT_META = (
    "first_value(CASE WHEN event_id % 3 = 0 THEN 'T' || event_id END IGNORE NULLS) OVER w",
    "coalesce(first_value(CASE WHEN event_id % 5 = 0 THEN 'A' || event_id END IGNORE NULLS) OVER w, '')",
)


def _state_fields(fold: str, title: str, authors: str, where: str = "true") -> str:
    return f"""{fold}, m AS (SELECT book_id, page_index, {title} AS book_title, {authors} AS authors FROM e WINDOW w AS (PARTITION BY book_id ORDER BY page_index))
        SELECT book_id, page_index, status AS toc_status, len(toc) AS n_toc, opened AS next_expected_opening_index, title AS section_title, toc_index, sec AS started_on_page,
               CASE WHEN sec IS NOT NULL THEN len(heads) END AS n_headings, CASE WHEN sec IS NOT NULL THEN coalesce(array_to_string(heads[greatest(1, len(heads) - 11):], ';'), '') END AS recent_headings,
               tail AS open_paragraph_tail, page_type AS last_page_type, page_index + 1 AS processed_page_count, book_title, authors
        FROM f JOIN m USING (book_id, page_index) WHERE {where}"""


_RULES = f"""{_FOLD},
z AS (SELECT *, lead(page_index) OVER (PARTITION BY book_id ORDER BY page_index) IS NULL AS last_page FROM f),
v AS (
  SELECT book_id, page_index, 0 AS rank, 'unexpected-toc' AS code FROM z WHERE page_type = 'toc' AND before IN ('committed', 'absent')
  UNION ALL SELECT book_id, page_index, 5, 'unexpected-chapter' FROM z WHERE page_type = 'chapter_opening' AND before = 'committed' AND opened_b >= len(toc_b)
  UNION ALL SELECT book_id, page_index, 6, 'toc-chapter-mismatch' FROM z WHERE page_type = 'chapter_opening' AND before = 'committed' AND opened_b < len(toc_b)
            AND lower(replace(toc_b[opened_b + 1], ' ....', '')) <> 'part ' || event_id % 5
  UNION ALL SELECT book_id, page_index, 8, 'unclosed-paragraph' FROM z WHERE page_type = 'chapter_opening' AND tail_b IS NOT NULL
  UNION ALL SELECT book_id, page_index, 9, 'missing-continuation' FROM z WHERE tail_b IS NOT NULL AND NOT c_prev
  UNION ALL SELECT book_id, page_index, 10, 'continuation-without-source' FROM z WHERE tail_b IS NULL AND c_prev),
ends AS (
  SELECT book_id, page_index, 'toc-not-exhausted' AS code FROM z WHERE last_page AND status = 'committed' AND opened < len(toc)
  UNION ALL SELECT book_id, page_index, 'unclosed-paragraph' FROM z WHERE last_page AND tail IS NOT NULL)"""


def _codes(*codes: str) -> str:
    return f"{_RULES} SELECT DISTINCT book_id, page_index, code FROM v WHERE code IN ({', '.join(repr(c) for c in codes)})"


_DOCS = """
d0 AS (SELECT source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_index, doc_id, doc_id % 3 = 0 AS going,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
d1 AS (SELECT *, coalesce(lag(going) OVER (PARTITION BY book_id ORDER BY page_index), false) AS before, page_index % 10 = 0 AS opens FROM d0),
d2 AS (SELECT *, NOT before AND doc_id % 7 = 0 AS fig, NOT before AND doc_id % 11 = 0 AS rule, doc_id % 5 = 0 AND len(lines) > 0 AS noted FROM d1),
d AS (SELECT *, CASE WHEN noted THEN CAST(count(*) FILTER (noted) OVER (PARTITION BY book_id ORDER BY page_index) AS VARCHAR) END AS note_id FROM d2),
b AS (
  SELECT book_id, page_index, doc_id, 0 AS pos, 'text' AS kind, CASE WHEN opens THEN 'chapter_title' ELSE 'page_number' END AS role, 'Document ' || doc_id AS text, NULL AS ref, NULL AS label, false AS c_prev, false AS c_on, NULL AS sha FROM d
  UNION ALL SELECT book_id, page_index, doc_id, 1, 'figure', NULL, 'Figure ' || doc_id, NULL, NULL, false, false, CASE WHEN doc_id % 14 = 0 THEN sha256(CAST(doc_id AS VARCHAR)) END FROM d WHERE fig
  UNION ALL SELECT book_id, page_index, doc_id, 1 + fig::INT, 'separator', NULL, NULL, NULL, NULL, false, false, NULL FROM d WHERE rule
  UNION ALL SELECT book_id, page_index, doc_id, 1 + fig::INT + rule::INT + i, 'text', 'paragraph', lines[i + 1], CASE WHEN noted AND i = len(lines) - 1 THEN note_id END,
                   CASE WHEN noted AND i = len(lines) - 1 THEN CAST(doc_id % 2 AS VARCHAR) END, before AND i = 0, going AND i = len(lines) - 1, NULL
            FROM (SELECT *, unnest(range(len(lines))) AS i FROM d)
  UNION ALL SELECT book_id, page_index, doc_id, 1 + fig::INT + rule::INT + len(lines), 'footnote', NULL, 'Note of ' || doc_id, note_id, CAST(doc_id % 2 AS VARCHAR), false, false, NULL FROM d WHERE noted)"""

_PUBLISHED = f"""WITH {_DOCS},
kept AS (SELECT *, printf('p%03d-b%03d', page_index + 1, pos + 1) AS block_id, kind = 'footnote' AS is_note FROM b WHERE coalesce(role, '') <> 'page_number' AND NOT (kind = 'figure' AND sha IS NULL)),
isl AS (SELECT *, CASE WHEN is_note THEN sum(is_note::INT) OVER w ELSE sum((NOT c_prev AND NOT is_note)::INT) OVER w END AS island FROM kept
        WINDOW w AS (PARTITION BY book_id ORDER BY page_index, pos ROWS UNBOUNDED PRECEDING)),
pc AS (SELECT *, lag(text) OVER i AS was, lag(ref) OVER i AS was_ref, lead(text) OVER i AS next FROM isl WINDOW i AS (PARTITION BY book_id, is_note, island ORDER BY page_index, pos)),
pr AS (SELECT *, sum((was_ref IS NOT NULL)::INT) OVER (PARTITION BY book_id, is_note, island ORDER BY page_index, pos ROWS UNBOUNDED PRECEDING) AS run,
        CASE WHEN was IS NULL OR was_ref IS NOT NULL THEN '' WHEN right(was, 1) = '-' OR contains('.,;:!?)]}}»"''', left(text, 1)) OR right(was, 1) = ' ' OR left(text, 1) = ' ' THEN '' ELSE ' ' END
        || CASE WHEN next IS NOT NULL AND ref IS NULL AND right(text, 1) = '-' THEN left(text, length(text) - 1) ELSE text END AS piece FROM pc),
runs AS (SELECT book_id, is_note, island, run, string_agg(piece, '' ORDER BY page_index, pos) AS text, max(ref) FILTER (kind = 'text') AS ref, min(page_index) AS p0 FROM pr GROUP BY ALL),
txt AS (SELECT book_id, is_note, island, string_agg(text || CASE WHEN ref IS NULL THEN '' ELSE '[^' || ref || ']' END, '' ORDER BY run) AS md,
          '[' || string_agg('{{"kind":"text","text":' || to_json(text) || '}}' || CASE WHEN ref IS NULL THEN '' ELSE ',{{"kind":"footnote_reference","label":"' || ref || '"}}' END, ',' ORDER BY run) || ']' AS js FROM runs GROUP BY ALL),
grp AS (SELECT book_id, is_note, island, arg_min(kind, (page_index, pos)) AS kind, arg_min(role, (page_index, pos)) AS role, max(ref) FILTER (is_note) AS note_id, max(text) FILTER (kind = 'figure') AS caption, max(sha) AS sha,
          array_to_string(list_distinct_sorted, ',') AS source_pages, ids AS source_block_ids, n_pages
        FROM (SELECT *, list_sort(list_distinct(list(page_index) OVER g)) AS list_distinct_sorted, string_agg(block_id, ',') OVER (PARTITION BY book_id, is_note, island ORDER BY page_index, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ids,
                len(list_distinct(list(page_index) OVER g)) AS n_pages FROM isl WINDOW g AS (PARTITION BY book_id, is_note, island)) GROUP BY book_id, is_note, island, list_distinct_sorted, ids, n_pages),
pub AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY is_note, island) - 1 AS INTEGER) AS idx FROM grp JOIN txt USING (book_id, is_note, island)),
meta AS (SELECT book_id, CASE WHEN max(page_index) >= 2 THEN 'Source ' || book_id END AS title, max(page_index) >= 3 AS authors FROM d GROUP BY book_id)"""

_HTML = """WITH h AS (SELECT CAST(page_id AS VARCHAR) AS book_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT book_id,
        list_concat(list_concat(list_concat(
          list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda t: {'role': 'running_header', 'text': t}),
          list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), lambda t: {'role': 'chapter_title', 'text': t})),
          list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda t: {'role': 'paragraph', 'text': t})),
          list_transform(regexp_extract_all(html, '(?s)<footer>(.*?)</footer>', 1), lambda t: {'role': 'running_footer', 'text': t})) AS items FROM h),
hb AS (SELECT book_id, CAST(i AS INTEGER) AS pos, 'text' AS kind, items[i + 1].role AS role, items[i + 1].text AS text FROM (SELECT *, unnest(range(len(items))) AS i FROM x))"""

_CONV = """WITH c0 AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, CAST(turn AS INTEGER) AS page_index, CASE role WHEN 'system' THEN 'toc' WHEN 'user' THEN 'chapter_opening' ELSE 'body' END AS page_type,
        list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM conversations),
cb AS (SELECT book_id, page_index, page_type, CAST(i AS INTEGER) AS pos, lines[i + 1] AS text,
        CASE WHEN i = 0 AND page_type = 'chapter_opening' THEN 'chapter_title' WHEN i = 0 AND page_type = 'body' THEN 'heading' ELSE 'paragraph' END AS role
       FROM (SELECT *, unnest(range(len(lines))) AS i FROM c0 WHERE page_type <> 'toc'))"""

_BOXES = """WITH v AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: least(1000, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 0.5) * 1000) AS INTEGER)))) AS q FROM embeddings),
n AS (SELECT vec_id, q[1] / 1000.0 AS x0, q[2] / 1000.0 AS y0, q[3] / 1000.0 AS x1, q[4] / 1000.0 AS y1 FROM v)"""


def _pixels(width: int, height: int) -> str:
    return (
        f"{_BOXES}, p AS (SELECT vec_id, least(greatest(least(x0, x1) * {width}, 0), {width}) AS x0, least(greatest(least(y0, y1) * {height}, 0), {height}) AS y0, "
        f"least(greatest(greatest(x0, x1) * {width}, 0), {width}) AS x1, least(greatest(greatest(y0, y1) * {height}, 0), {height}) AS y1 FROM n)"
    )


_ORDERS = """o AS (SELECT o_custkey AS book_id, o_orderkey AS k, 'f' || o_orderkey AS path, sha256(o_orderkey || '|' || o_orderstatus) AS sha, length(o_orderkey || '|' || o_orderstatus) AS size FROM orders)"""

_COMMITS = f"{_EVENTS}, c AS (SELECT book_id, page_index + 1 AS page_number FROM e WHERE event_id % 37 <> 0)"

_SAFE = "(path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, chr(92)) AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0)"

_RECOVERY_CASE = """CASE
 WHEN phase = 'building' AND has_previous THEN 'quarantine-candidate-raise'
 WHEN phase = 'building' THEN 'quarantine-candidate'
 WHEN phase = 'candidate-published' THEN CASE WHEN destination_valid_at_head THEN 'finish' WHEN previous_valid THEN 'quarantine-destination-restore-previous' ELSE 'quarantine-all-raise' END
 WHEN NOT has_destination AND has_candidate AND has_previous THEN CASE WHEN candidate_valid THEN 'publish-candidate-drop-previous' WHEN previous_valid THEN 'quarantine-candidate-restore-previous' ELSE 'quarantine-candidate' END
 WHEN NOT has_destination AND NOT has_candidate AND has_previous THEN CASE WHEN previous_valid THEN 'restore-previous' ELSE 'quarantine-previous' END
 WHEN phase = 'previous-moved' AND has_destination AND NOT has_candidate AND has_previous THEN CASE WHEN destination_valid_at_head THEN 'keep-destination-drop-previous' WHEN previous_valid THEN 'quarantine-destination-restore-previous' ELSE 'quarantine-both' END
 WHEN phase = 'candidate-valid' AND has_destination AND has_candidate AND NOT has_previous THEN CASE WHEN candidate_valid THEN 'publish-candidate-replace' WHEN destination_valid THEN 'quarantine-candidate-keep' ELSE 'quarantine-both' END
 WHEN phase = 'candidate-valid' AND has_destination AND NOT has_candidate AND NOT has_previous THEN CASE WHEN destination_valid_at_head THEN 'keep-destination' ELSE 'quarantine-destination' END
 WHEN phase = 'candidate-valid' AND has_candidate AND NOT has_destination AND NOT has_previous THEN CASE WHEN candidate_valid THEN 'publish-candidate' ELSE 'quarantine-candidate' END
 ELSE 'raise-corruption' END"""

_REST = " || chr(10) || chr(10) || ".join(f"'{text}'" for text in SECTIONS[1:])

ORACLES: dict[str, str] = {
    "scan_blocks": f"""{_CONV} SELECT book_id, page_index, pos, role, CASE WHEN role = 'heading' THEN page_index % 3 + 1 END AS heading_level,
        printf('p%03d-b%03d', page_index + 1, pos + 1) AS block_id, text FROM cb""",
    "wire_to_domain": f"""WITH {_EVENTS}, w AS (SELECT event_id, text, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM e)
        SELECT event_id, 'body' AS page_type, 0 AS pos, 'text' AS kind, 'paragraph' AS role, NULL AS label, NULL AS caption, text || '[^' || k || ']' AS text,
               CASE WHEN event_id % 2 = 0 THEN k / 1000.0 END AS x0, CASE WHEN event_id % 2 = 0 THEN k / 1000.0 END AS y1, true AS no_style FROM w
        UNION ALL SELECT event_id, 'body', 1, 'figure', NULL, 'L', 'C' || k, NULL, NULL, NULL, true FROM w""",
    "closed_schema_reject": f"""WITH {_EVENTS} SELECT event_id, CASE WHEN event_id % 10 = 4 THEN 'invalid-json' WHEN event_id % 10 < 4 THEN 'invalid-structured-response' END AS wire_error,
        CASE WHEN event_id % 10 > 4 THEN page_type END AS page_type FROM e""",
    "inline_text_three_ways": f"""WITH {_DOCS} SELECT book_id, page_index, CAST(pos AS INTEGER) AS pos, text || coalesce(label, '') AS state_text, text AS run_text,
        text || coalesce('[^' || label || ']', '') AS markdown_text FROM b WHERE kind = 'text'""",
    "drop_furniture": f"{_HTML} SELECT * FROM hb WHERE role NOT IN ('running_header', 'running_footer')",
    "html_block_scan": f"{_HTML} SELECT book_id, count(*) AS n_blocks, count(*) FILTER (role = 'paragraph') AS n_paragraphs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM hb GROUP BY book_id",
    "title_normalize": r"""SELECT doc_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower('  ' || string_split(coalesce(text, ''), chr(10))[1] || ' .... '), '[.·…\s]+$', ''), '\s+', ' ', 'g')), '[.:;,\-–—]+$', '')) AS title FROM documents""",
    "nfc_text_hash": "SELECT doc_id, sha256(nfc_normalize(coalesce(text, ''))) AS sha256 FROM documents",
    "path_safety": f"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages), q AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/' || p WHEN page_id % 5 = 1 THEN p || '/../x' WHEN page_id % 5 = 2 THEN p || '//y' WHEN page_id % 7 = 0 THEN 'manifest.json' ELSE p END AS path FROM u)
        SELECT page_id, path, {_SAFE} AS safe, {_SAFE} AND path <> 'manifest.json' AS safe_output FROM q""",
    "artifact_name_rules": """WITH n AS (SELECT o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'provenance.json' WHEN o_orderkey % 7 = 0 THEN 'a/' || o_orderkey ELSE 'f' || o_orderkey % 100 END AS name FROM orders)
        SELECT o_custkey, count(*) AS n_names, count(*) = count(DISTINCT name) AND count(*) FILTER (name = 'provenance.json' OR contains(name, '/')) = 0 AS valid FROM n GROUP BY o_custkey""",
    "name_patterns": """WITH n AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN printf('page-%04d', o_orderkey) WHEN 1 THEN 'failure-' || o_orderkey WHEN 2 THEN 'assets/' || sha256(CAST(o_orderkey AS VARCHAR)) || '.png' ELSE left(sha256(CAST(o_orderkey AS VARCHAR)), 16) END AS name FROM orders)
        SELECT o_orderkey, starts_with(name, 'page-') AND length(name) = 9 AS is_commit, starts_with(name, 'failure-') AND length(name) = 12 AS is_failure, o_orderkey % 4 = 3 AS is_nonce,
               CASE WHEN o_orderkey % 4 = 2 THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS asset_sha256 FROM n""",
    "page_range": f"{_CONV} SELECT book_id, page_index, page_type FROM c0 WHERE page_index BETWEEN 1 AND 3",
    "toc_state": f"{_FOLD} SELECT book_id, page_index, status AS toc_status, before AS toc_status_before, page_index + 1 AS processed_page_count FROM f",
    "toc_concat": f"{_FOLD} SELECT book_id, page_index, len(toc) AS n_entries, coalesce(array_to_string(toc, '|'), '') AS titles FROM f",
    "opening_index": f"{_FOLD} SELECT book_id, page_index, opened AS next_expected_opening_index FROM f",
    "state_scan": _state_fields(_CORPUS_FOLD, "CASE WHEN page_index >= 2 THEN 'Corpus' END", "CASE WHEN page_index >= 3 THEN 'A. Author' ELSE '' END"),
    "state_resume": _state_fields(_FOLD, *_EVENT_META, "page_index >= 3 + CAST(book_id AS BIGINT) % 9"),
    "section_carry": f"{_FOLD} SELECT book_id, page_index, title, CASE WHEN sec IS NOT NULL THEN 'chapter' END AS kind, toc_index, sec AS started_on_page FROM f",
    "recent_headings": f"""{_FOLD} SELECT book_id, page_index, CASE WHEN sec IS NOT NULL THEN coalesce(array_to_string(heads[greatest(1, len(heads) - 11):], ';'), '') END AS recent,
        CASE WHEN sec IS NOT NULL THEN len(heads) END AS n_stack FROM f""",
    "open_tail": f"{_FOLD} SELECT book_id, page_index, tail FROM f",
    "page_context": f"""{_FOLD} SELECT f.book_id, f.page_index,
          (SELECT 'T' || arg_min(g.event_id, g.page_index) FROM e g WHERE g.book_id = f.book_id AND g.page_index < f.page_index AND g.event_id % 3 = 0) AS book_title,
          coalesce(lag(status) OVER w, 'not_seen') AS toc_status,
          CASE WHEN lag(status) OVER w = 'committed' THEN coalesce(array_to_string(toc_b[opened_b + 1:opened_b + 3], '|'), '') ELSE '' END AS expected,
          title_b AS current_section_title, tail_b AS open_paragraph_tail, prev_type AS previous_page_type, CASE WHEN title_b IS NULL THEN 0 ELSE least(12, n_head_b) END AS n_headings
        FROM f WINDOW w AS (PARTITION BY f.book_id ORDER BY f.page_index)""",
    "metadata_first": f"""WITH {_EVENTS} SELECT book_id, 'T' || arg_min(event_id, page_index) FILTER (event_id % 3 = 0) AS title, 'S' || arg_min(event_id, page_index) FILTER (event_id % 4 <> 0) AS subtitle,
        coalesce('A' || arg_min(event_id, page_index) FILTER (event_id % 5 = 0), '') AS authors, CAST(NULL AS VARCHAR) AS language FROM e GROUP BY book_id""",
    "state_fold_hof": f"{_FOLD} SELECT book_id, arg_max(status, page_index) AS toc_status, arg_max(opened, page_index) AS next_expected_opening_index FROM f GROUP BY book_id",
    "val_toc_hierarchy": _codes("unexpected-toc", "invalid-toc-hierarchy"),
    "val_headings": f"""WITH {_EVENTS}, g AS (SELECT book_id, page_index // 10 AS page, page_index, event_id % 4 + 1 AS level FROM e WHERE page_type = 'body'),
        l AS (SELECT *, lag(level) OVER (PARTITION BY book_id, page ORDER BY page_index) AS was FROM g)
        SELECT book_id, CAST(page AS INTEGER) AS page_index, string_agg(level, ',' ORDER BY l.page_index) AS levels FROM l GROUP BY book_id, page HAVING max((level > was + 1)::INT) = 1""",
    "val_continuations": _codes("unclosed-paragraph", "missing-continuation", "continuation-without-source", "invalid-continuation-layout"),
    "val_footnotes": f"""WITH {_DOCS}, n AS (SELECT DISTINCT book_id, page_index, CASE WHEN page_index % 4 = 0 THEN 'x' ELSE label END AS label FROM b WHERE kind = 'footnote'),
        r AS (SELECT DISTINCT book_id, page_index, label FROM b WHERE kind = 'text' AND label IS NOT NULL)
        SELECT *, 'unresolved-footnote' AS code FROM r ANTI JOIN n USING (book_id, page_index, label) UNION ALL SELECT *, 'orphan-footnote' FROM n ANTI JOIN r USING (book_id, page_index, label)""",
    "val_openings": _codes("missing-chapter-title", "multiple-chapter-titles", "unexpected-chapter", "toc-chapter-mismatch"),
    "val_figures": "SELECT vec_id, 'figure-crop-unavailable' AS code FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 1",
    "val_book_end": f"{_RULES} SELECT * FROM ends",
    "first_violation": f"{_RULES} SELECT book_id, arg_min(page_index, (page_index, rank)) AS page_index, arg_min(code, (page_index, rank)) AS code FROM v GROUP BY book_id",
    "accepted_prefix": f"""{_RULES}, s AS (SELECT book_id, min(page_index) AS stop FROM v GROUP BY book_id)
        SELECT e.book_id, count(*) AS n_pages, max(e.page_index) AS last_page FROM e LEFT JOIN s USING (book_id) WHERE s.stop IS NULL OR e.page_index < s.stop GROUP BY e.book_id""",
    "footnote_relabel": f"""WITH {_DOCS} SELECT book_id, page_index, CAST(pos AS INTEGER) AS pos, kind, CASE WHEN kind = 'footnote' THEN ref END AS note_id,
        text || CASE WHEN kind = 'text' THEN '[^' || ref || ']' ELSE '' END AS text, false AS unresolved FROM b WHERE ref IS NOT NULL""",
    "continuation_merge": f"{_PUBLISHED} SELECT book_id, source_pages, source_block_ids, md AS text FROM pub WHERE n_pages > 1",
    "continuation_errors": f"""WITH {_EVENTS}, blk AS (SELECT book_id, page_index, c_prev, c_on, page_type IN ('chapter_opening', 'body') AS guarded FROM e),
        src AS (SELECT *, lag(c_on) OVER w AS was_on, last_value(CASE WHEN c_prev OR c_on THEN c_on END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM blk WINDOW w AS (PARTITION BY book_id ORDER BY page_index))
        SELECT book_id, page_index, CASE WHEN NOT coalesce(source, false) THEN 'continuation-without-source' ELSE 'invalid-continuation-layout' END AS code
        FROM src WHERE c_prev AND (NOT coalesce(source, false) OR guarded OR NOT coalesce(was_on, false))""",
    "publication_errors": f"""WITH {_EVENTS}, blk AS (SELECT book_id, page_index, c_prev, c_on, page_type IN ('chapter_opening', 'body') AS guarded FROM e),
        src AS (SELECT *, lag(c_on) OVER w AS was_on, last_value(CASE WHEN c_prev OR c_on THEN c_on END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM blk WINDOW w AS (PARTITION BY book_id ORDER BY page_index)),
        bad AS (SELECT book_id, page_index, CASE WHEN NOT coalesce(source, false) THEN 'continuation-without-source' ELSE 'invalid-continuation-layout' END AS code
        FROM src WHERE c_prev AND (NOT coalesce(source, false) OR guarded OR NOT coalesce(was_on, false)))
        SELECT book_id, min(page_index) AS page_index, arg_min(code, page_index) AS code FROM bad GROUP BY book_id""",
    "source_map": f"{_PUBLISHED} SELECT book_id, idx AS publication_block_index, kind, source_pages, source_block_ids FROM pub",
    "markdown_render": f"""{_PUBLISHED},
        ln AS (SELECT book_id, idx, is_note, CASE kind WHEN 'separator' THEN '---' WHEN 'figure' THEN '![' || caption || '](assets/' || sha || '.png)' WHEN 'footnote' THEN '[^' || note_id || ']: ' || md
                 ELSE CASE role WHEN 'chapter_title' THEN '# ' ELSE '' END || md END AS line FROM pub),
        tx AS (SELECT book_id, coalesce(string_agg(line || chr(10), chr(10) ORDER BY idx) FILTER (NOT is_note), '') AS body, coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (is_note), '') AS notes FROM ln GROUP BY book_id)
        SELECT book_id, rtrim(CASE WHEN title IS NULL THEN '' ELSE '# ' || title || chr(10) || chr(10) END || CASE WHEN authors THEN 'A. Author, B. Author' || chr(10) || chr(10) ELSE '' END
          || body || CASE WHEN body <> '' AND notes <> '' THEN chr(10) ELSE '' END || notes, ' ' || chr(10) || chr(9)) || chr(10) AS markdown FROM tx JOIN meta USING (book_id)""",
    "markdown_conversations": f"""{_CONV}, ln AS (SELECT book_id, page_index, pos, CASE role WHEN 'chapter_title' THEN '# ' WHEN 'heading' THEN repeat('#', page_index % 3 + 2) || ' ' ELSE '' END || text AS line FROM cb),
        t AS (SELECT book_id, string_agg(line, chr(10) || chr(10) ORDER BY page_index, pos) AS body FROM ln GROUP BY book_id), p AS (SELECT book_id, min(page_index) + 1 AS first FROM c0 GROUP BY book_id)
        SELECT book_id, '<!-- source-page: ' || first || ' -->' || chr(10) || rtrim(body, ' ' || chr(10) || chr(9)) || chr(10) AS markdown FROM t JOIN p USING (book_id)""",
    "canonical_json": """SELECT o_orderkey, '{"cust":' || o_custkey || ',"key":' || o_orderkey || ',"priority":' || CASE WHEN o_orderpriority = '5-LOW' THEN 'null' ELSE to_json(o_orderpriority) END || ',"status":' || to_json(o_orderstatus) || '}' AS json FROM orders""",
    "publication_fingerprint": f"""{_PUBLISHED},
        js AS (SELECT book_id, string_agg(CASE kind WHEN 'separator' THEN '{{"kind":"separator","separator_kind":"horizontal_rule"}}'
                 WHEN 'figure' THEN '{{"asset_sha256":"' || sha || '","caption":' || to_json(caption) || ',"kind":"figure"}}'
                 WHEN 'footnote' THEN '{{"content":' || js || ',"kind":"footnote","note_id":"' || note_id || '"}}'
                 ELSE '{{"content":' || js || ',"heading_level":null,"kind":"text","role":"' || role || '"}}' END, ',' ORDER BY idx) AS body FROM pub GROUP BY book_id)
        SELECT book_id, sha256(nfc_normalize('{{"blocks":[' || body || '],"epub_semantic_profile":{{"from_format":"markdown+footnotes","include_toc":true,"profile_format_version":1,"split_level":1,"to_format":"epub3"}},"identity_format_version":1,'
          || '"markdown_semantic_profile":{{"footnote_style":"document-end","heading_style":"atx","profile_format_version":1}},"metadata":{{"authors":' || CASE WHEN authors THEN '["A. Author","B. Author"]' ELSE '[]' END
          || ',"language":"en","subtitle":null,"title":' || coalesce(CAST(to_json(title) AS VARCHAR), 'null') || '}}}}')) AS fingerprint FROM js JOIN meta USING (book_id)""",
    "publication_uuid": """WITH h AS (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('document:' || sha256(coalesce(text, '')))) AS x FROM documents)
        SELECT doc_id, 'urn:uuid:' || x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab', 1 + (CAST('0x' || x[17:17] AS INTEGER) & 3), 1) || x[18:20] || '-' || x[21:32] AS identifier FROM h""",
    "asset_dedupe": """WITH a AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents) SELECT sha256(t) AS sha256, octet_length(encode(t)) AS size_bytes, 'assets/' || sha256(t) || '.png' AS path FROM a""",
    "manifest_diff": f"""WITH {_ORDERS}, m AS (SELECT book_id, path, sha, size + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS size FROM o WHERE k % 17 <> 0), g AS (SELECT book_id, path, CASE WHEN k % 23 = 0 THEN sha256(sha) ELSE sha END AS sha, size FROM o WHERE k % 13 <> 0)
        SELECT * FROM (SELECT coalesce(m.book_id, g.book_id) AS book_id, coalesce(m.path, g.path) AS path, CASE WHEN g.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN m.size <> g.size THEN 'size mismatch' WHEN m.sha <> g.sha THEN 'hash mismatch' END AS problem
        FROM m FULL JOIN g ON m.book_id = g.book_id AND m.path = g.path) WHERE problem IS NOT NULL""",
    "manifest_problems": """WITH f AS (SELECT o_custkey AS book_id, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'book.md' WHEN o_orderkey % 29 = 0 THEN '../x' WHEN o_orderkey % 31 = 0 THEN 'notes.txt' WHEN o_orderkey % 37 = 0 THEN 'other' ELSE 'a' || o_orderkey END AS path FROM orders),
        g AS (SELECT book_id, count(*) FILTER (path = '../x') AS unsafe, count(*) - count(DISTINCT path) AS doubled, count(*) FILTER (path = 'other') AS misnamed, count(*) FILTER (path = 'book.md') AS primaries, count(*) FILTER (path IN ('../x', 'notes.txt')) AS strangers FROM f GROUP BY book_id)
        SELECT * FROM (SELECT book_id, CASE WHEN unsafe > 0 OR doubled > 0 THEN 'invalid-artifact-path' WHEN misnamed > 0 OR primaries <> 1 THEN 'invalid-run-layout' WHEN strangers > 0 THEN 'invalid-artifact-path' END AS code FROM g) WHERE code IS NOT NULL""",
    "contiguity": f"WITH {_COMMITS} SELECT * FROM (SELECT book_id, page_number, coalesce(lag(page_number) OVER (PARTITION BY book_id ORDER BY page_number), 0) AS previous_page_number FROM c) WHERE page_number <> previous_page_number + 1",
    "head_and_quarantine": f"""WITH {_COMMITS}, m AS (SELECT book_id, max(page_number) AS top FROM c GROUP BY book_id),
        g AS (SELECT m.book_id, min(n.i) AS gap FROM m, LATERAL (SELECT unnest(range(1, m.top + 2)) AS i) n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book_id = m.book_id AND c.page_number = n.i) GROUP BY m.book_id)
        SELECT c.book_id, CAST(any_value(gap) - 1 AS INTEGER) AS committed_page_count, count(*) FILTER (page_number >= gap) AS n_quarantined FROM c JOIN g USING (book_id) GROUP BY c.book_id""",
    "commit_append": f"""WITH RECURSIVE {_COMMITS},
        h AS (SELECT b.book_id, coalesce((SELECT max(i) FROM (SELECT unnest(range(1, 6)) AS i) WHERE (SELECT count(*) FROM c WHERE c.book_id = b.book_id AND c.page_number <= i) = i), 0) AS head FROM (SELECT DISTINCT book_id FROM c) b),
        r AS (SELECT c.book_id, c.page_number FROM c JOIN h USING (book_id) WHERE c.page_number = h.head + 1 AND c.page_number > 5 UNION ALL SELECT c.book_id, c.page_number FROM r JOIN c ON c.book_id = r.book_id AND c.page_number = r.page_number + 1)
        SELECT book_id, count(*) AS n_appended FROM r GROUP BY book_id""",
    "sequence_numbers": f"WITH {_EVENTS} SELECT book_id, max(page_index) + 1 AS next_number, arg_max(text, page_index) AS failure FROM e WHERE page_type = 'figure_page' GROUP BY book_id",
    "bbox_pixels": f"{_pixels(2000, 1000)} SELECT vec_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM p",
    "bbox_pdf_rotate": f"""{_pixels(2000, 1000)}, u AS (SELECT vec_id, x0 / 2000 AS a, x1 / 2000 AS b, y0 / 1000 AS c, y1 / 1000 AS d FROM p),
        r AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN a WHEN 1 THEN 1 - d WHEN 2 THEN 1 - b WHEN 3 THEN c END * 612 AS x0, CASE vec_id % 5 WHEN 0 THEN c WHEN 1 THEN a WHEN 2 THEN 1 - d WHEN 3 THEN 1 - b END * 792 AS y0,
                     CASE vec_id % 5 WHEN 0 THEN b WHEN 1 THEN 1 - c WHEN 2 THEN 1 - a WHEN 3 THEN d END * 612 AS x1, CASE vec_id % 5 WHEN 0 THEN d WHEN 1 THEN b WHEN 2 THEN 1 - c WHEN 3 THEN 1 - a END * 792 AS y1 FROM u)
        SELECT vec_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM r""",
    "crop_clamp": f"""{_pixels(640, 480)}, w AS (SELECT vec_id, CAST(trunc(x0) AS INTEGER) AS x0, CAST(trunc(y0) AS INTEGER) AS y0, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1 FROM p), g AS (SELECT *, x1 > x0 AND y1 > y0 AS ok FROM w)
        SELECT vec_id, NOT ok AS degenerate, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM g""",
    "map_overlay": f"WITH {_EVENTS} SELECT event_id, 'text=' || text || ';type=' || page_type AS merged FROM e",
    "retry_classify": f"""WITH {_EVENTS}, s AS (SELECT event_id, value, [200, 429, 500, 502, 503, 504, 400, 404, 418, 501][event_id % 10 + 1] AS status, event_id % 3 + 1 AS attempt FROM e),
        c AS (SELECT *, CASE WHEN status = 200 THEN NULL WHEN status IN (429, 502, 503, 504) THEN 'http-retryable' WHEN status >= 500 THEN 'http-server-error' ELSE 'http-client-error' END AS code FROM s)
        SELECT event_id, status, code, coalesce(attempt < 3 AND (code = 'http-retryable' OR (code = 'http-server-error' AND event_id % 2 = 0)), false) AS retry,
               CASE WHEN event_id % 4 = 0 AND value IS NOT NULL THEN least(greatest(value, 0.0), 60.0) ELSE CAST(pow(2, attempt - 1) AS DOUBLE) END AS wait FROM c""",
    "context_budget": """WITH t AS (SELECT *, greatest(1, length(text) // 4) AS tokens, 10800 + turn * 300 AS context FROM conversations), r AS (SELECT *, tokens + 2048 + 8192 + 512 AS required FROM t)
        SELECT conv_id, turn, tokens, required, CASE WHEN required > context THEN 'context-budget-exceeded' WHEN role <> 'user' AND required > context * 0.85 THEN 'context-budget-indeterminate' END AS error,
               CASE WHEN context - 2800 <= 8192 + 512 THEN 'static-context-impossible' END AS static_error FROM r""",
    "token_contract_choice": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'token-counting-calibration-failed' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 > o_orderkey % 7 THEN 'multimodal-input-tokens' ELSE 'text-only-input-tokens' END
        WHEN o_orderkey % 4 = 1 THEN 'estimate-only' WHEN o_orderkey % 4 = 2 THEN 'token-counting-calibration-failed' WHEN o_orderkey % 6 = o_orderkey % 9 THEN 'estimate-only' ELSE 'apply-template-tokenize' END AS contract FROM orders""",
    "attempt_rollup": f"""WITH {_EVENTS} SELECT book_id, page_index // 3 AS page_index, count(*) AS attempts, count(*) FILTER (event_id % 3 <> 0) AS failed_attempts,
        CAST(nullif(sum(CASE WHEN event_id % 2 = 0 THEN event_id % 50 ELSE 0 END), 0) AS BIGINT) AS elapsed_ms FROM e GROUP BY ALL""",
    "attempt_invariants": f"WITH {_EVENTS} SELECT event_id, event_id % 4 < 1 OR (event_id % 3 = 0 AND (event_id % 2 = 0 OR event_id % 5 = 0)) OR (event_id % 3 <> 0 AND event_id % 2 <> 0) AS problem FROM e",
    "probe_outcomes": f"""WITH {_EVENTS}, s AS (SELECT event_id, [NULL, 200, 404, 500, 503, 401, 422][event_id % 7 + 1] AS status, event_id % 2 + 1 AS attempt, event_id % 3 = 0 AS frozen FROM e)
        SELECT event_id, CASE WHEN status = 200 THEN 'counted' WHEN status IS NULL OR status >= 500 THEN CASE WHEN attempt = 1 THEN 'retry' WHEN frozen THEN 'context-budget-probe-unavailable' ELSE 'token-counting-calibration-failed' END
          WHEN status = 404 AND NOT frozen THEN 'unsupported' WHEN frozen THEN 'token-counting-contract-drift' ELSE 'token-counting-calibration-failed' END AS outcome FROM s""",
    "failure_numbers": f"""{_RULES}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_index, rank) AS k, count(*) OVER (PARTITION BY book_id) AS total FROM v)
        SELECT book_id, page_index, code, printf('failure-%04d', k) AS name, k = total AS latest FROM n""",
    "prompt_build": f"""{_FOLD}, k AS (SELECT book_id, page_index, coalesce(lag(status) OVER (PARTITION BY book_id ORDER BY page_index), 'not_seen') AS was, title_b, tail_b, prev_type FROM f)
        SELECT book_id, page_index, '{SECTIONS[0]}' || chr(10) || chr(10) || 'What is known so far:' || chr(10) || '{{"current_section_title":' || coalesce('"' || title_b || '"', 'null') || ',"open_paragraph_tail":' || coalesce('"' || tail_b || '"', 'null')
          || ',"previous_page_type":' || coalesce('"' || prev_type || '"', 'null') || ',"toc_status":"' || was || '"}}' || chr(10) || chr(10) || {_REST} AS prompt FROM k""",
    "wire_closed_objects": """SELECT n_nationkey, form, CASE WHEN form IN ('no json', 'no text', 'a list', 'a string') THEN 'invalid-json' WHEN ok THEN NULL ELSE 'invalid-structured-response' END AS wire_error
        FROM nation, (SELECT unnest(['least', 'full block', 'full page', 'nulls']) AS form, true AS ok
          UNION ALL SELECT unnest(['no json', 'no text', 'a list', 'a string', 'no page type', 'other page type', 'page key', 'blocks no list', 'block no object', 'null block', 'block key', 'block kind',
            'no block kind', 'role', 'text without role', 'note without label', 'heading level 7', 'heading level 0', 'heading level 1.5', 'size', 'alignment', 'bold no flag', 'null continues', 'segments null',
            'segment key', 'segment kind', 'segment without value', 'box key', 'box with one corner', 'box too far', 'box below', 'opening key', 'opening without level', 'opening kind', 'opening without title',
            'entry key', 'entry level 9', 'entry kind', 'entry without title', 'metadata key', 'authors no list', 'author no string', 'title no string']), false)""",
    "val_made_pages": """SELECT n_nationkey || '-' || book AS book_id, CAST(page AS INTEGER) AS page_index, code FROM nation, (VALUES
        ('toc-after-commit', 2, 'unexpected-toc'), ('toc-empty', 0, 'invalid-toc-hierarchy'), ('toc-blank-title', 0, 'invalid-toc-hierarchy'), ('toc-jump', 0, 'invalid-toc-hierarchy'),
        ('chapter-untitled', 0, 'missing-chapter-title'), ('chapter-two-titles', 0, 'multiple-chapter-titles'), ('chapter-beyond-toc', 2, 'unexpected-chapter'), ('chapter-other-title', 1, 'toc-chapter-mismatch'),
        ('heading-jump', 0, 'heading-level-jump'), ('chapter-in-paragraph', 2, 'unclosed-paragraph'), ('not-continued', 2, 'missing-continuation'), ('continued-from-nothing', 0, 'continuation-without-source'),
        ('two-continue', 2, 'invalid-continuation-layout'), ('second-continues', 2, 'invalid-continuation-layout'), ('two-go-on', 1, 'invalid-continuation-layout'), ('first-goes-on', 1, 'invalid-continuation-layout'),
        ('notes-doubled', 0, 'duplicate-footnote-label'), ('note-missing', 0, 'unresolved-footnote'), ('note-orphan', 0, 'orphan-footnote'), ('figure-without-box', 0, 'figure-crop-unavailable'),
        ('toc-not-used-up', 1, 'toc-not-exhausted'), ('ends-open', 1, 'unclosed-paragraph')) AS v (book, page, code)""",
    "publication_made_pages": """SELECT n_nationkey || '-' || book AS book_id, CAST(page AS INTEGER) AS page_index, code FROM nation, (VALUES
        ('chapter-in-paragraph', 2, 'invalid-continuation-layout'), ('continued-from-nothing', 0, 'continuation-without-source'), ('two-continue', 2, 'continuation-without-source'),
        ('second-continues', 2, 'invalid-continuation-layout'), ('notes-doubled', 0, 'duplicate-footnote-label'), ('note-missing', 0, 'unresolved-footnote'), ('quote-goes-on', 0, 'invalid-continuation-layout')) AS v (book, page, code)""",
    "rejected_pages_stop": f"""WITH {_EVENTS}, n AS (SELECT book_id, count(*) AS n FROM e GROUP BY book_id)
        SELECT book_id, least(n, 2) AS n_pages, CASE WHEN n > 2 THEN 2 END AS stop, CASE WHEN n > 2 THEN 'invalid-json' END AS code FROM n""",
    "title_exact": r"""SELECT doc_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize('  ' || string_split(coalesce(text, ''), chr(10))[1] || ' .... ')), 'ß', 'ss'), '[.·…\s]+$', ''), '\s+', ' ', 'g')), '[.:;,\-–—]+$', '')) AS title FROM documents""",
    "publish_titles_only": f"""WITH {_EVENTS}, m AS (SELECT book_id, 'T' || arg_min(event_id, page_index) FILTER (event_id % 3 = 0) AS title, 'S' || arg_min(event_id, page_index) FILTER (event_id % 4 <> 0) AS subtitle,
          'A' || arg_min(event_id, page_index) FILTER (event_id % 5 = 0) AS author FROM e GROUP BY book_id),
        r AS (SELECT *, coalesce('# ' || title || chr(10) || chr(10), '') || coalesce('## ' || subtitle || chr(10) || chr(10), '') || coalesce(author, '') AS text FROM m)
        SELECT book_id, rtrim(text, chr(10)) || chr(10) AS markdown, sha256('{{"blocks":[],"epub_semantic_profile":{{"from_format":"markdown+footnotes","include_toc":true,"profile_format_version":1,"split_level":1,"to_format":"epub3"}},'
          || '"identity_format_version":1,"markdown_semantic_profile":{{"footnote_style":"document-end","heading_style":"atx","profile_format_version":1}},"metadata":{{"authors":['
          || coalesce('"' || author || '"', '') || '],"language":null,"subtitle":' || coalesce('"' || subtitle || '"', 'null') || ',"title":' || coalesce('"' || title || '"', 'null') || '}}}}') AS fingerprint FROM r""",
    "exit_codes": """SELECT unnest(string_split(codes, ' ')) AS code, CAST(exit AS INTEGER) AS exit_code FROM (VALUES
        (10, 'context-budget-exceeded context-budget-indeterminate context-budget-probe-unavailable empty-response http-client-error http-retryable http-server-error invalid-completion-envelope invalid-http-response invalid-json invalid-structured-response output-token-limit response-body-truncated thinking-smoke-unavailable transport-error transport-timeout unexpected-reasoning-content'),
        (11, 'unexpected-toc invalid-toc-hierarchy missing-chapter-title multiple-chapter-titles unexpected-chapter toc-chapter-mismatch heading-level-jump unclosed-paragraph missing-continuation continuation-without-source invalid-continuation-layout duplicate-footnote-label unresolved-footnote orphan-footnote figure-crop-unavailable toc-not-exhausted'),
        (12, 'epubcheck-failed pandoc-failed'),
        (13, 'config-drift duplicate-artifact-name inference-relocation-rejected invalid-commit-artifact-path invalid-run-layout output-transaction-corruption page-image-too-large page-render-failed render-environment-drift run-locked schema-drift source-hash-mismatch inference-environment-drift server-model-path-mismatch static-context-impossible thinking-control-contract-drift token-counting-calibration-failed token-counting-contract-drift unsupported-llama-server-contract unsupported-multi-model-server unsupported-thinking-control unverifiable-server-model-path unsupported-pandoc-defaults'),
        (14, 'invalid-artifact-path invalid-source-pdf')) AS v (exit, codes)""",
    "recovery_no_marker": """WITH b AS (SELECT unnest([true, false]) AS x)
        SELECT d.x AS has_destination, c.x AS has_candidate, p.x AS has_previous, dv.x AS destination_valid, pv.x AS previous_valid,
          concat_ws(',', CASE WHEN c.x THEN 'quarantine-candidate' END, CASE
            WHEN d.x AND dv.x AND p.x THEN 'quarantine-previous'
            WHEN d.x AND dv.x THEN NULL
            WHEN d.x AND p.x AND pv.x THEN 'quarantine-destination,restore-previous'
            WHEN d.x AND p.x THEN 'quarantine-destination,quarantine-previous'
            WHEN d.x THEN 'quarantine-destination'
            WHEN p.x AND pv.x THEN 'restore-previous'
            WHEN p.x THEN 'quarantine-previous' END) AS action
        FROM b d, b c, b p, b dv, b pv""",
    "environment_drift": """WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT k AS book_id, CASE WHEN k % 5 = 2 THEN 'inference-environment-drift' ELSE 'server-model-path-mismatch' END AS code FROM o WHERE k % 5 = 2 OR k % 7 = 0""",
    "publish_recovery": f"""WITH b AS (SELECT unnest([true, false]) AS x), s AS (SELECT phase, a.x AS has_destination, b.x AS has_candidate, c.x AS has_previous, d.x AS candidate_valid, g.x AS destination_valid, h.x AS destination_valid_at_head, i.x AS previous_valid
          FROM (SELECT unnest(['building', 'candidate-valid', 'previous-moved', 'candidate-published']) AS phase), b a, b, b c, b d, b g, b h, b i)
        SELECT *, {_RECOVERY_CASE} AS action FROM s""",
    "drift_guard": """WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT k AS book_id, CASE WHEN k % 9 = 0 THEN 'config-drift' ELSE 'schema-drift' END AS code FROM o WHERE k % 9 = 0 OR k % 6 = 0""",
    "state_streaming": f"{_FOLD} SELECT book_id, page_index, status AS toc_status, opened AS next_expected_opening_index, true AS accepted FROM f",
    "noop_interpreter": f"WITH {_EVENTS} SELECT book_id, count(*) AS n_pages, count(*) AS n_blank, 0 AS n_blocks FROM e GROUP BY book_id",
}
ORACLES["snapshot_context"] = f"SELECT * FROM ({ORACLES['page_context']}) WHERE page_index >= 3 + CAST(book_id AS BIGINT) % 9"
ORACLES["state_stream_parts"] = _state_fields(_FOLD, *_EVENT_META).replace("book_title, authors\n", "book_title, authors, CASE WHEN status = 'committed' THEN coalesce(array_to_string(toc[opened + 1:opened + 3], '|'), '') ELSE '' END AS expected, true AS accepted\n")
ORACLES["markdown_digest"] = f"SELECT book_id, sha256(markdown) AS sha256, octet_length(encode(markdown)) AS size_bytes FROM ({ORACLES['markdown_render']})"
ORACLES["book_trees"] = f"""WITH md AS (SELECT book_id, regexp_replace(markdown, '^<!-- source-page: [0-9]+ -->\n', '') AS text FROM ({ORACLES['markdown_conversations']})),
    n AS (SELECT book_id, count(*) AS n FROM ({ORACLES['scan_blocks']}) GROUP BY book_id), h AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, max(turn) + 1 AS head FROM conversations GROUP BY conv_id)
    SELECT book_id, 'book.md' AS path, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes, true AS listed, CAST(n AS INTEGER) AS n_source_blocks, CAST(head AS INTEGER) AS committed_page_count
    FROM md JOIN n USING (book_id) JOIN h USING (book_id)"""
ORACLES["figure_crops"] = f"""{_pixels(64, 48)}, c AS (SELECT vec_id, CAST(trunc(x0) AS INTEGER) AS x0, CAST(trunc(y0) AS INTEGER) AS y0, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1 FROM p),
    px AS (SELECT vec_id, x, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM c)),
    t AS (SELECT vec_id, sum((y * 7 + x * 13 + vec_id) % 256 + (y * 7 + x * 13 + 29 + vec_id) % 256 + (y * 7 + x * 13 + 58 + vec_id) % 256) AS total FROM px GROUP BY vec_id)
    SELECT CAST(vec_id AS VARCHAR) AS book_id, CASE WHEN total IS NOT NULL THEN x1 - x0 END AS width, CASE WHEN total IS NOT NULL THEN y1 - y0 END AS height, CAST(total AS BIGINT) AS pixel_sum,
           CASE WHEN total IS NULL THEN 'degenerate-crop' END AS problem, true AS named FROM c LEFT JOIN t USING (vec_id)"""
ORACLES["interpret_in_order"] = f"""{_FOLD} SELECT book_id, page_index, page_type, concat_ws('/', coalesce(lag(status) OVER w, 'not_seen'), coalesce(title_b, 'None'), coalesce(tail_b, 'None'), coalesce(prev_type, 'None'), CASE WHEN title_b IS NULL THEN 0 ELSE least(12, n_head_b) END) AS label
    FROM f WINDOW w AS (PARTITION BY book_id ORDER BY page_index)"""
ORACLES["wire_coercion"] = """WITH t AS (SELECT event_id, event_id % 17 AS form, CAST(event_id % 9 AS INTEGER) AS n FROM events),
    j AS (SELECT *, CASE WHEN form IN (0, 1, 3) THEN n BETWEEN 1 AND 6 WHEN form IN (6, 7, 12) THEN n IN (0, 1) ELSE form IN (4, 5, 8, 9, 11, 15) END AS ok FROM t)
    SELECT event_id, CASE WHEN NOT ok THEN 'invalid-structured-response' END AS wire_error, CASE WHEN ok AND form IN (0, 1, 3) THEN n WHEN form = 4 THEN 1 END AS heading_level,
           CASE WHEN ok AND form IN (6, 7) THEN n = 1 WHEN form = 8 THEN true WHEN form = 9 THEN false END AS bold, CASE WHEN ok AND form = 12 THEN n = 1 END AS continues_previous,
           CASE WHEN form = 15 THEN n END AS box_left, CASE WHEN form = 15 THEN n END AS box_top, CASE WHEN form = 15 THEN 1 END AS box_right FROM j"""
ORACLES["request_summaries"] = """SELECT page_id, 'json_schema' AS format, page_id % 3 = 0 AS include_image, 8192 AS max_tokens, 'reader' AS model, sha256(url) AS schema_sha256, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS n_text_parts,
    CASE WHEN page_id % 3 = 0 THEN 'data:image/png;base64,' || base64(encode(coalesce(html, ''))) END AS picture FROM pages"""
ORACLES["completion_bodies"] = """SELECT event_id, ['invalid-http-response', 'invalid-completion-envelope', 'empty-response', 'output-token-limit', 'empty-response', 'empty-response', 'unexpected-reasoning-content', 'invalid-json', NULL][event_id % 9 + 1] AS code FROM events"""
ORACLES["server_builds"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b' || o_orderkey WHEN o_orderkey % 5 < 2 THEN 'c' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS build,
    CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 < 2 THEN 'inference-relocation-rejected' END AS relocation FROM orders"""
