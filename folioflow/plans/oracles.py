"""The same queries in SQL for DuckDB."""

from __future__ import annotations

from folioflow.operators.requests import PROMPT_HEAD

WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'), ' ')"


def kept(c: str) -> str:
    hyphens = f"regexp_replace({c}, '([A-Za-z])-\\n([A-Za-z])', '\\1\\2', 'g')"
    marked = f"regexp_replace(replace({hyphens}, chr(13) || chr(10), chr(10)), '\\n[{WS}]*\\n+', chr(57344), 'g')"
    return f"replace({norm(marked)}, chr(57344), chr(10) || chr(10))"


def flattened(c: str) -> str:
    return norm(f"regexp_replace({c}, '([A-Za-z])-\\n([A-Za-z])', '\\1\\2', 'g')")


def noise(c: str) -> str:
    return f"(length({strip(c)}) <= 1 OR regexp_matches({strip(c)}, '^\\p{{Nd}}+$'))"


BLOCKS = """lines AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
raw AS (SELECT doc_id, lang, unnest(range(len(l))) AS ordinal, unnest(l) AS text FROM lines),
b AS (SELECT doc_id, lang, ordinal, ordinal // 12 AS page, ordinal % 12 AS block_idx, text,
             CASE WHEN (doc_id * 3 + ordinal) % 11 = 0 THEN 20.0 ELSE 11.0 END::DOUBLE AS size,
             CASE WHEN (doc_id + ordinal) % 5 = 0 THEN 'F1' ELSE 'F0' END AS font,
             (40 + 280 * ((ordinal % 12) // 6))::DOUBLE AS x0,
             (60 + 100 * ((ordinal % 12) % 6) + CASE WHEN (doc_id + ordinal) % 7 = 0 THEN 30 ELSE 0 END)::DOUBLE AS y0,
             (40 + 280 * ((ordinal % 12) // 6) + 220)::DOUBLE AS x1,
             (60 + 100 * ((ordinal % 12) % 6) + CASE WHEN (doc_id + ordinal) % 7 = 0 THEN 30 ELSE 0 END + 80)::DOUBLE AS y1,
             2 + ordinal % 3 AS line_count FROM raw)"""

KINDS = BLOCKS + f""",
n AS (SELECT *, {norm('text')} AS flat, {noise('text')} AS noise FROM b),
k AS (SELECT *, CASE WHEN noise THEN 'noise'
      WHEN flat <> '' AND (contains(lower(flat), 'contents') OR contains(text, chr(9)) OR (regexp_matches(flat, '^(\\p{{Nd}}|/|[A-Za-z])') AND length(flat) <= 120)) THEN 'toc'
      WHEN regexp_matches(flat, '^([-•]|\\p{{Nd}}+[.)])[{WS}]+') THEN 'list'
      WHEN flat <> '' AND ((size >= 18 AND NOT (regexp_matches(flat, '[。！？!?.,;:—-]') OR length(flat) > 80 OR len(regexp_extract_all(flat, '[\\p{{L}}\\p{{N}}_]+')) > 14))
           OR (length(flat) <= 60 AND flat = upper(flat) AND regexp_matches(flat, '\\p{{L}}'))) THEN 'heading'
      ELSE 'paragraph' END AS kind FROM n)"""

REASONS = KINDS + f""",
p AS (SELECT *, lag(page) OVER w AS pp, lag(noise) OVER w AS pn, lag(x0) OVER w AS px, lag(y1) OVER w AS py, lag(size) OVER w AS ps, lag(font) OVER w AS pf,
             lag(kind) OVER w AS pk, lag(flat) OVER w AS pflat, lag({strip('text')}) OVER w AS pt, {strip('text')} AS st,
             row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_idx, ordinal)),
r AS (SELECT *, CASE WHEN rn = 1 THEN NULL WHEN pn OR noise THEN 'noise' WHEN pp <> page THEN 'cross_page' WHEN abs(px - x0) > 20 THEN 'column_change'
      WHEN y0 - py < -2 OR y0 - py > greatest(ps * 1.6, 24) THEN 'large_gap'
      WHEN pk = 'toc' AND kind = 'toc' THEN CASE WHEN length(pflat) <= 80 AND length(flat) <= 80 THEN 'toc_short_lines'
           WHEN abs(ps - size) <= 1.5 AND pf = font THEN 'toc_font_match' ELSE 'toc_break' END
      WHEN pk = 'list' AND kind = 'list' AND abs(ps - size) <= 1.5 AND pf = font THEN 'list_continuation'
      WHEN pk <> kind THEN 'kind_change' WHEN kind = 'heading' THEN 'heading'
      WHEN kind = 'paragraph' AND abs(ps - size) <= 1.5 AND pf = font AND pt <> '' AND NOT regexp_matches(pt, '[.!?:;。！？]$')
           AND regexp_matches(pt, '([,—/-]|\\p{{Ll}})$') THEN 'mid_sentence'
      WHEN kind = 'paragraph' AND abs(ps - size) <= 1.5 AND pf = font AND (regexp_matches(st, '^\\p{{Ll}}')
           OR regexp_matches(st, '(?i)^(and|or|but|to|for|with|of|the)([^\\p{{L}}\\p{{N}}_]|$)')) THEN 'continuation_start'
      WHEN kind = 'paragraph' AND abs(ps - size) <= 1.5 AND pf = font AND length(pflat) <= 80 AND length(flat) <= 80 THEN 'short_paragraph_lines'
      ELSE 'default_break' END AS reason FROM p)"""

RUNS = REASONS + """,
m AS (SELECT *, coalesce(reason IN ('toc_short_lines', 'toc_font_match', 'list_continuation', 'mid_sentence', 'continuation_start', 'short_paragraph_lines'), false) AS merged FROM r),
s AS (SELECT *, sum(CASE WHEN merged THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, block_idx, ordinal)::BIGINT - 1 AS segment_id FROM m)"""

ITEMS = KINDS + f""",
i AS (SELECT doc_id, page, ordinal, block_idx, 'p' || page || '_b' || block_idx AS id, {kept('text')} AS t, kind FROM k WHERE NOT noise),
g AS (SELECT doc_id, page, count(*) AS n_items, sum(length(t))::BIGINT AS input_chars, string_agg(id, ',' ORDER BY block_idx, ordinal) AS ids,
             string_agg(kind, ',' ORDER BY block_idx, ordinal) AS kinds, string_agg(t, chr(10) ORDER BY block_idx, ordinal) AS texts,
             to_json({{'items': list({{'id': id, 't': t}} ORDER BY block_idx, ordinal)}})::VARCHAR AS payload FROM i WHERE t <> '' GROUP BY doc_id, page)"""

SHOUT = KINDS + f""",
a AS (SELECT *, CASE WHEN NOT noise AND {flattened('text')} <> '' THEN 'T:' || {flattened('text')} ELSE text END AS said FROM k)"""

PEERS = KINDS + """,
near AS (SELECT a.doc_id, a.page, a.block_idx, min(q.x0) AS neighbor_x0 FROM k a JOIN k q ON a.doc_id = q.doc_id AND a.page = q.page
         AND q.x0 > a.x0 + 20 AND least(a.y1, q.y1) - greatest(a.y0, q.y0) > 0 AND least(a.y1, q.y1) - greatest(a.y0, q.y0) >= 0.3 * least(a.y1 - a.y0, q.y1 - q.y0)
         GROUP BY ALL),
nb AS (SELECT k.*, near.neighbor_x0 FROM k LEFT JOIN near USING (doc_id, page, block_idx)),
adj AS (SELECT *, least(600 - greatest(24, x0), x0 + greatest(220 * 1.35, 220 + 120.0)) AS wide,
        least(600 - greatest(24, x0), neighbor_x0 - 10) AS bound FROM nb),
adj2 AS (SELECT *, CASE WHEN kind <> 'paragraph' THEN x1 WHEN CASE WHEN neighbor_x0 IS NULL THEN wide ELSE least(wide, bound) END <= x0 + 20 THEN x1
                        WHEN neighbor_x0 IS NULL THEN wide ELSE least(wide, bound) END AS adjusted_x1 FROM adj)"""

MARK = "(?:[•・●◦▪■□◆◇▶▸▹▻]|\\([1-9]\\p{Nd}?\\)|[1-9]\\p{Nd}?[.)]|[①-⑳])"
CJK = "一-龥ぁ-ゔァ-ヴー々〆〤"


def close_cjk(c: str) -> str:
    for left, right in ((CJK, CJK), (CJK, CJK), (CJK, "0-9A-Za-z%"), ("0-9A-Za-z%", CJK), ("\\p{Nd}", "%")):
        c = f"regexp_replace({c}, '([{left}])[{WS}]+([{right}])', '\\1\\2', 'g')"
    return c


def blanks(c: str) -> str:
    return f"regexp_replace({c}, '[{WS}]{{2,}}', ' ', 'g')"


def flowed(c: str) -> str:
    return blanks(strip(f"regexp_replace({c}, '[{WS}]*\\n+[{WS}]*', ' ', 'g')"))


def rendered(table: str, text: str, kind: str) -> str:
    """CTEs that give the rows of a table ``set_text``; digits of the text stand in list markers only, so that these need no look around them."""
    lines = f"string_split(regexp_replace({text}, '[\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10))"
    quotes = ", ".join(f"'{q}'" for q in ['"', "''", "“", "”", "‘", "’", "「", "」", "『", "』"])
    item = blanks(f"regexp_replace({strip('x')}, '^({MARK})[{WS}]*', '\\1 ')")
    spaced = f"regexp_replace({flowed('cl')}, '[{WS}]*({MARK})[{WS}]*', ' \\1 ', 'g')"
    parts = f"string_split(regexp_replace({spaced}, '[{WS}]+({MARK})', chr(57345) || '\\1', 'g'), chr(57345))"
    return f"""ln AS (SELECT *, list_filter(list_transform({lines}, lambda x: {strip('x')}), lambda x: x <> '' AND x NOT IN ({quotes})) AS ls FROM {table}),
cleaned AS (SELECT *, {close_cjk(blanks(f"CASE WHEN len(ls) > 0 THEN array_to_string(ls, chr(10)) ELSE {strip(text)} END"))} AS cl FROM ln),
listed AS (SELECT *, list_filter({parts}, lambda x: {strip('x')} <> '') AS its, {spaced} AS spaced FROM cleaned),
kinded AS (SELECT *, CASE {kind} WHEN 'list' THEN CASE WHEN len(its) > 0 THEN array_to_string(list_transform(its, lambda x: {item}), chr(10)) ELSE spaced END
                     WHEN 'paragraph' THEN {close_cjk(flowed('cl'))} ELSE cl END AS kt FROM listed),
rendered AS (SELECT *, regexp_replace(kt, '[{WS}]*[“”‘’「」『』]+$', '') AS set_text FROM kinded)"""


def split_after(c: str, marks: str) -> str:
    """Pieces of a text after marks that white space follows, stripped, none empty."""
    cut = f"string_split(regexp_replace({c}, '([{marks}])[{WS}]+', '\\1' || chr(57345), 'g'), chr(57345))"
    return f"list_filter(list_transform({cut}, lambda x: {strip('x')}), lambda x: x <> '')"


ROOM = "greatest(8.0::DOUBLE, length(flat) * 0.6::DOUBLE + (220.0::DOUBLE / size) * line_count)"
SEGMENTS = RUNS + f""",
sg AS (SELECT doc_id, segment_id, min(kind) AS kind, count(*) AS m, string_agg({kept('text')}, chr(10) || chr(10) ORDER BY page, block_idx, ordinal) AS joined,
              list({ROOM} ORDER BY page, block_idx, ordinal) AS caps FROM s GROUP BY doc_id, segment_id)"""


def dealt(answer: str) -> str:
    """CTEs that deal the sentences of an answer to the blocks of ``sg``: ``texts``, null where there are too few."""
    return f"""an AS (SELECT *, {strip(answer)} AS an FROM sg),
ch AS (SELECT *, {split_after('an', '。！？!?')} AS c0 FROM an),
ch1 AS (SELECT *, CASE WHEN len(c0) > 0 THEN c0 ELSE [an] END AS c1 FROM ch),
ch2 AS (SELECT *, CASE WHEN len(c1) >= m THEN c1 ELSE flatten(list_transform(c1, lambda c: CASE WHEN len({split_after('c', '、，,')}) >= 2 THEN {split_after('c', '、，,')} ELSE [c] END)) END AS ps,
               list_reduce(caps, lambda a, c: a + c, 0.0::DOUBLE) AS al FROM ch1),
de AS (SELECT *, CASE WHEN len(ps) > 0 AND len(ps) >= m THEN list_reduce(caps, lambda a, c: {{'at': a.at + CASE WHEN m - len(a.k) = 1 THEN len(ps) - a.at
                   ELSE greatest(1, least(len(ps) - a.at - (m - len(a.k)) + 1, floor(greatest(1.0::DOUBLE, len(ps) * (c / al)))::BIGINT)) END,
                 'k': list_append(a.k, a.at)}}, {{'at': 0::BIGINT, 'k': []::BIGINT[]}}).k END AS ks FROM ch2),
dl AS (SELECT *, list_transform(ks, lambda k, i: {strip("array_to_string(list_slice(ps, k + 1, CASE WHEN i < len(ks) THEN ks[i + 1] ELSE len(ps) END), ' ')")}) AS t0 FROM de),
dealt AS (SELECT *, CASE WHEN list_contains(t0, '') THEN NULL ELSE t0 END AS texts FROM dl)"""


LADDER = f"WITH {ITEMS}, nh AS (SELECT doc_id, page, n_items AS n, n_items // 2 AS h, n_items - n_items // 2 AS o, input_chars FROM g)"


def half(m: str) -> tuple[str, str]:
    """Chunks and source texts that a half takes where chunks of more than two items fail."""
    quarters = (f"greatest(1, {m} // 2)", f"({m} - greatest(1, {m} // 2))")
    return f"CASE WHEN {m} <= 2 THEN 1 ELSE 3 END", f"CASE WHEN {m} <= 2 THEN 0 ELSE " + " + ".join(f"CASE WHEN {q} <= 2 THEN 0 ELSE {q} END" for q in quarters) + " END"


BODY = f"kind = 'paragraph' AND line_count >= 2 AND length({norm('text')}) >= 40 AND 220 >= 600 * 0.18 AND greatest(3.0, size) <= greatest(18.0, 800 * 0.03)"
HEAD = len(PROMPT_HEAD)

ORACLES = {
    "q01_line_blocks": f"WITH {BLOCKS} SELECT doc_id, ordinal, page, block_idx, text, size, font, x0, y0, x1, y1, line_count FROM b",
    "q02_normalized_text": f"SELECT doc_id, {norm('text')} AS flat, {kept('text')} AS kept, {flattened('text')} AS flattened FROM documents",
    "q03_block_kind": f"WITH {KINDS} SELECT doc_id, ordinal, kind FROM k",
    "q04_kind_histogram": f"WITH {KINDS} SELECT lang, kind, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM k GROUP BY lang, kind",
    "q05_kind_quality": f"WITH {KINDS} SELECT kind, quality::BIGINT AS quality, count(*) AS blocks, sum(toxic)::BIGINT AS toxic FROM k JOIN labels USING (doc_id) GROUP BY ALL",
    "q06_merge_reason": f"WITH {REASONS} SELECT doc_id, ordinal, reason FROM r",
    "q07_segments": f"WITH {RUNS} SELECT doc_id, ordinal, segment_id, merged FROM s",
    "q08_segment_rollup": f"""WITH {RUNS} SELECT doc_id, segment_id, min(kind) AS kind, count(*) AS blocks, sum(length(text))::BIGINT AS chars,
        coalesce(string_agg(reason, ',' ORDER BY page, block_idx, ordinal) FILTER (merged), '') AS reasons FROM s GROUP BY doc_id, segment_id""",
    "q09_page_items": f"WITH {ITEMS} SELECT doc_id, page, ids, kinds, texts FROM g",
    "q10_request_payload": f"WITH {ITEMS} SELECT doc_id, page, payload FROM g",
    "q11_page_stats": f"""WITH {ITEMS} SELECT doc_id, page, n_items AS items, input_chars, length(payload) AS payload_chars, length(payload) + {HEAD} AS prompt_chars,
        ceil((length(payload) + {HEAD}) / 4)::BIGINT AS estimated_prompt_tokens, 4096::BIGINT AS max_output_tokens,
        ceil((length(payload) + {HEAD}) / 4)::BIGINT + 4096 AS estimated_total_tokens, input_chars > 1000 AS over_input_char_limit, 1000::BIGINT AS max_input_chars FROM g""",
    "q12_conversation_items": f"""WITH i AS (SELECT conv_id, turn, {kept('text')} AS t FROM conversations WHERE NOT {noise('text')}),
        g AS (SELECT conv_id, count(*) AS n_items, sum(length(t))::BIGINT AS input_chars,
                     length(to_json({{'items': list({{'id': 'p' || conv_id || '_b' || turn, 't': t}} ORDER BY turn)}})::VARCHAR) AS payload_chars FROM i WHERE t <> '' GROUP BY conv_id)
        SELECT *, ceil((payload_chars + {HEAD}) / 4)::BIGINT AS estimated_prompt_tokens FROM g""",
    "q13_single_block": f"WITH {SHOUT} SELECT doc_id, ordinal, said AS text, text AS original_text FROM a",
    "q14_merge_results": f"""WITH {KINDS} SELECT doc_id, ordinal, CASE WHEN page IN (0, 2, 3) AND NOT noise THEN CASE WHEN block_idx % 2 = 0 THEN 'b:' ELSE 'a:' END || text ELSE text END AS text,
        text AS original_text, kind AS segment_kind FROM k""",
    "q15_capacity": f"WITH {KINDS} SELECT doc_id, ordinal, round(greatest(8.0, length(flat) * 0.6::DOUBLE + (220.0::DOUBLE / size) * line_count), 6) AS capacity FROM k",
    "q16_id_difference": f"""WITH {ITEMS}, x AS (SELECT doc_id, page, ordinal, id, CASE WHEN ordinal % 10 = 0 THEN id || 'x' ELSE id END AS back FROM i WHERE t <> ''),
        mi AS (SELECT doc_id, page, coalesce(string_agg(id, ',' ORDER BY id) FILTER (ordinal % 7 = 0 OR back <> id), '') AS missing,
                      coalesce(string_agg(back, ',' ORDER BY back) FILTER (ordinal % 7 <> 0 AND back <> id), '') AS extra,
                      coalesce(sum(ordinal) FILTER (ordinal % 7 <> 0), 0)::BIGINT AS ordinals FROM x GROUP BY doc_id, page) SELECT * FROM mi""",
    "q17_call_metrics": """WITH c AS (SELECT event_type <> 'error' AS ok, floor(value * 100)::DOUBLE AS elapsed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 10 AS worker FROM events)
        SELECT worker, count(*) AS requests_total, count(*) FILTER (ok) AS requests_ok, count(*) FILTER (NOT ok) AS requests_failed,
               coalesce(sum(ceil(k * 7 / 4)) FILTER (ok), 0)::BIGINT AS prompt_tokens, coalesce(sum(k) FILTER (ok), 0)::BIGINT AS completion_tokens,
               coalesce(sum(ceil(k * 7 / 4) + k) FILTER (ok), 0)::BIGINT AS total_tokens, coalesce(sum(greatest(0, elapsed)) FILTER (ok), 0)::DOUBLE AS successful_elapsed
        FROM c GROUP BY worker""",
    "q18_translated_count": f"WITH {SHOUT} SELECT lang, count(*) FILTER (said <> text AND NOT noise) AS translated, count(*) AS blocks FROM a GROUP BY lang",
    "q19_body_paragraphs": f"WITH {KINDS} SELECT doc_id, ordinal, {BODY} AS body, greatest(18.0, 800 * 0.03)::DOUBLE AS size_limit FROM k",
    "q20_decorative": f"""WITH {KINDS}, d AS (SELECT doc_id, ordinal, (200 + 40 * (ordinal % 9))::DOUBLE AS w, (60 * (ordinal % 11))::DOUBLE AS h, length({norm('text')}) AS c,
        y0 FROM k) SELECT doc_id, ordinal, (c <= 12 AND w * h >= 480000 * 0.2::DOUBLE) OR (c <= 8 AND h >= 800 * 0.45::DOUBLE) AS decorative FROM d""",
    "q21_right_neighbor": f"WITH {PEERS} SELECT doc_id, ordinal, neighbor_x0 FROM nb",
    "q22_adjusted_box": f"""WITH {PEERS} SELECT doc_id, ordinal, adjusted_x1::DOUBLE AS adjusted_x1,
        CASE WHEN kind = 'paragraph' AND neighbor_x0 IS NULL AND adjusted_x1 - x0 >= 600 * 0.45 THEN 3 ELSE 0 END::BIGINT AS align FROM adj2""",
    "q23_padded_box": f"""WITH {KINDS}, z AS (SELECT *, CASE kind WHEN 'paragraph' THEN greatest(3.0, least(14.0, size * 0.16::DOUBLE)) WHEN 'list' THEN greatest(2.0, least(8.0, size * 0.10::DOUBLE)) END AS pad FROM k)
        SELECT doc_id, ordinal, round(CASE WHEN pad IS NULL OR least(800, y1 + pad) <= greatest(0, y0 - pad) + 4 THEN y0 ELSE greatest(0, y0 - pad) END, 6)::DOUBLE AS top,
               round(CASE WHEN pad IS NULL OR least(800, y1 + pad) <= greatest(0, y0 - pad) + 4 THEN y1 ELSE least(800, y1 + pad) END, 6)::DOUBLE AS bottom FROM z""",
    "q24_column_size": f"""WITH {KINDS}, z AS (SELECT *, x0 + (doc_id + 13 * ordinal) % 50 AS x, (220 - 25 * (ordinal % 5))::DOUBLE AS w FROM k),
        f AS (SELECT doc_id, page, list({{'o': ordinal, 'x': x, 'w': w, 's': size}} ORDER BY x, block_idx) AS c FROM z WHERE {BODY.replace('220 >=', 'w >=')} GROUP BY doc_id, page),
        r AS (SELECT doc_id, page, c, list_reduce(c, lambda a, q: {{'n': CASE WHEN list_contains(list_transform(a.n, lambda e: abs(q.x - e.x) <= 36 AND abs(q.w - e.w) / greatest(q.w, e.w) <= 0.35), true)
                  THEN a.n ELSE list_append(a.n, {{'x': q.x, 'w': q.w}}) END,
                'g': list_append(a.g, coalesce(list_position(list_transform(a.n, lambda e: abs(q.x - e.x) <= 36 AND abs(q.w - e.w) / greatest(q.w, e.w) <= 0.35), true), len(a.n) + 1) - 1)}},
                {{'n': []::STRUCT(x DOUBLE, w DOUBLE)[], 'g': []::BIGINT[]}}).g AS g FROM f),
        u AS (SELECT doc_id, page, unnest(c) AS c, unnest(g) AS col_group FROM r)
        SELECT doc_id, c.o AS ordinal, col_group, round(quantile_cont(c.s, 0.25) OVER (PARTITION BY doc_id, page, col_group), 6) AS target_size FROM u""",
    "q25_paragraph_groups": f"""WITH {BLOCKS}, z AS (SELECT doc_id, page, list({{'x': x0 + 25 * (ordinal % 3), 't': text, 'st': {strip('text')}, 'y1': y1, 'size': size, 'font': font}} ORDER BY block_idx) AS l
             FROM b WHERE page % 7 <> 3 GROUP BY doc_id, page),
        f AS (SELECT doc_id, page, l, list_reduce(l, lambda a, x: CASE
                  WHEN x.st = '' THEN {{'g': a.g, 'open': false, 'least': 0.0::DOUBLE, 'px': 0.0::DOUBLE, 'pt': '', 'out': list_append(a.out, -1::BIGINT)}}
                  WHEN NOT a.open OR ((x.x - a.px >= 20 OR x.x - a.least >= 20) AND regexp_matches(a.pt, '[.!?:;。！？]$') AND a.pt NOT IN ('•', '-', '*', '・') AND x.st NOT IN ('•', '-', '*', '・'))
                       THEN {{'g': a.g + 1, 'open': true, 'least': x.x, 'px': x.x, 'pt': x.st, 'out': list_append(a.out, a.g + 1)}}
                  ELSE {{'g': a.g, 'open': true, 'least': least(a.least, x.x), 'px': x.x, 'pt': x.st, 'out': list_append(a.out, a.g)}} END,
                {{'g': -1::BIGINT, 'open': false, 'least': 0.0::DOUBLE, 'px': 0.0::DOUBLE, 'pt': '', 'out': []::BIGINT[]}}).out AS gs FROM z),
        u AS (SELECT doc_id, page, unnest(l) AS x, unnest(gs) AS g, unnest(range(len(l))) AS i FROM f)
        SELECT doc_id, page, g AS block_idx, string_agg(x.t, chr(10) ORDER BY i) AS text, min(x.x) AS x0, max(x.y1) AS y1, first(x.size ORDER BY i) AS size, first(x.font ORDER BY i) AS font,
               1.0::DOUBLE AS blue, count(*) AS line_count FROM u WHERE g >= 0 GROUP BY doc_id, page, g""",
    "q27_chunk_assign": f"""WITH {SEGMENTS}, {dealt(norm("replace(joined, '.', '!')"))}
        SELECT doc_id, segment_id, m::INT AS n_blocks, coalesce(array_to_string(texts, '|'), '-') AS dealt FROM dealt""",
    "q29_pages_translated": f"WITH {ITEMS} SELECT k.doc_id, k.ordinal, CASE WHEN i.t <> '' THEN 'T:' || i.t ELSE k.text END AS text, k.kind AS segment_kind FROM k LEFT JOIN i USING (doc_id, ordinal)",
    "q33_segment_records": f"""WITH {RUNS} SELECT doc_id, segment_id, min(kind) AS kind, to_json(list([page, block_idx] ORDER BY page, block_idx, ordinal))::VARCHAR AS block_refs,
        substr(string_agg({norm('text')}, ' ' ORDER BY page, block_idx, ordinal), 1, 180) AS source_preview FROM s GROUP BY doc_id, segment_id""",
    "q26_render_text": f"""WITH {BLOCKS}, pl AS (SELECT doc_id, ordinal, regexp_replace(text, '[0-9]', 'x', 'g') AS p FROM b),
        dr AS (SELECT doc_id, ordinal, ['list', 'paragraph', 'toc'][ordinal % 3 + 1] AS kd, CASE ordinal % 4
               WHEN 0 THEN '• ' || p || ' (2) two 3. three ③ four' WHEN 1 THEN '日 本 語 ' || p || ' 50 % 日本 A1 漢 字 '
               WHEN 2 THEN p || chr(10) || '」' || chr(10) || '  next   line' || chr(10) || '“' ELSE p || ' 12) end」” ' END AS tx FROM pl),
        {rendered('dr', 'tx', 'kd')} SELECT doc_id, ordinal, set_text FROM rendered""",
    "q28_structured_response": f"WITH {ITEMS} SELECT doc_id, page, n_items AS items, split_part(ids, ',', 1) AS first_id FROM g",
    "q30_render_plan": f"""WITH {PEERS}, body AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY x0) AS cg FROM k WHERE {BODY}),
        tz AS (SELECT doc_id, page, block_idx, quantile_cont(size, 0.25) OVER (PARTITION BY doc_id, page, cg) AS ct FROM body),
        sz AS (SELECT a.*, least(a.size, coalesce(tz.ct, a.size)) AS target_size FROM adj2 a LEFT JOIN tz USING (doc_id, page, block_idx)),
        pd AS (SELECT *, CASE kind WHEN 'paragraph' THEN greatest(3.0::DOUBLE, least(14.0::DOUBLE, target_size * 0.16::DOUBLE)) WHEN 'list' THEN greatest(2.0::DOUBLE, least(8.0::DOUBLE, target_size * 0.10::DOUBLE)) END AS pad FROM sz),
        bx AS (SELECT *, pad IS NOT NULL AND least(800, y1 + pad) > greatest(0, y0 - pad) + 4 AS grown, adjusted_x1::DOUBLE AS set_x1, text AS tx, kind AS kd FROM pd),
        bx2 AS (SELECT *, CASE WHEN grown THEN greatest(0, y0 - pad) ELSE y0 END::DOUBLE AS set_y0, CASE WHEN grown THEN least(800, y1 + pad) ELSE y1 END::DOUBLE AS set_y1 FROM bx),
        {rendered('bx2', 'tx', 'kd')},
        un AS (SELECT *, set_x1 - x0 AS w, set_y1 - set_y0 AS h, list_transform(string_split(set_text, chr(10)), lambda x: (length(x) + length(regexp_replace(x, '[\\x00-\\x{{2E7F}}]', '', 'g'))) / 2.0::DOUBLE) AS us FROM rendered),
        sr AS (SELECT *, list_reduce(range(12), lambda a, i: CASE WHEN list_reduce(us, lambda t, u: t + greatest(1.0::DOUBLE, ceil(u * ((a.lo + a.hi) / 2) / w)), 0.0::DOUBLE) * ((a.lo + a.hi) / 2) * 1.2::DOUBLE <= h
                  THEN {{'lo': (a.lo + a.hi) / 2 + 0.05::DOUBLE, 'hi': a.hi, 'best': (a.lo + a.hi) / 2}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2 - 0.05::DOUBLE, 'best': a.best}} END,
                {{'lo': 3.0::DOUBLE, 'hi': target_size * 1.05::DOUBLE, 'best': 3.0::DOUBLE}}).best AS font_size FROM un)
        SELECT doc_id, page, block_idx, x0 AS set_x0, set_y0, set_x1, set_y1, set_text, target_size, font_size,
               CASE WHEN kind = 'paragraph' AND neighbor_x0 IS NULL AND set_x1 - x0 >= 600 * 0.45 THEN 3 ELSE 0 END::BIGINT AS align FROM sr""",
    "q31_segments_translated": f"""WITH {SEGMENTS}, {dealt("'<' || replace(joined, '.', '!') || '>'")},
        pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment_id ORDER BY page, block_idx, ordinal) AS i, {flattened('text')} AS fl FROM s)
        SELECT doc_id, ordinal, CASE WHEN d.kind = 'paragraph' AND d.m > 1 AND d.texts IS NOT NULL THEN d.texts[i] WHEN NOT noise AND fl <> '' THEN '<' || replace(fl, '.', '!') || '>' ELSE text END AS text,
               d.kind AS segment_kind FROM pos JOIN dealt d USING (doc_id, segment_id)""",
    "q34_marked_split": f"""WITH {RUNS}, l AS (SELECT doc_id, segment_id, list({flattened('text')} ORDER BY page, block_idx, ordinal) AS t FROM s GROUP BY doc_id, segment_id),
        ms AS (SELECT *, CASE segment_id % 3 WHEN 1 THEN NULL WHEN 2 THEN list_concat(['again'], t[2:]) ELSE t END AS r FROM l)
        SELECT doc_id, segment_id, CASE WHEN r IS NULL OR list_contains(r, '') THEN '-' ELSE array_to_string(r, '|') END AS back FROM ms""",
    "q35_wrapped_answers": f"""WITH {ITEMS} SELECT doc_id, page, CASE WHEN page % 4 = 3 THEN -1 ELSE n_items END AS items,
        CASE WHEN page % 4 = 3 THEN '-' ELSE (SELECT string_agg(i.id || ':' || i.t, '|' ORDER BY i.block_idx) FROM i WHERE i.doc_id = g.doc_id AND i.page = g.page AND i.t <> '') END AS texts FROM g""",
    "q36_answer_repair": f"""WITH {ITEMS}, nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_idx, ordinal) - 1 AS r, count(*) OVER (PARTITION BY doc_id, page) AS c FROM i WHERE t <> '')
        SELECT doc_id, page, CASE WHEN page % 3 = 0 AND min(c) > 2 THEN '-' ELSE string_agg(id || '=a:' || t, '|' ORDER BY r) END AS placed,
               coalesce(string_agg(id, ',' ORDER BY r) FILTER (r % 2 = 1 OR length(t) % 5 = 0), '') AS missing FROM nr GROUP BY doc_id, page""",
    "q37_page_totals": """SELECT count(*) FILTER (user_id % 3 > 0) AS pages_retried, coalesce(sum(event_id % 5), 0)::BIGINT AS fallback_blocks,
        min(user_id % 100) FILTER (event_type = 'error') AS first_failed_page FROM events""",
    "q38_rates": """WITH c AS (SELECT event_type <> 'error' AS ok, floor(value * 100)::DOUBLE AS elapsed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 10 AS worker FROM events),
        m AS (SELECT worker, coalesce(sum(k) FILTER (ok), 0)::BIGINT AS n, coalesce(sum(greatest(0, elapsed)) FILTER (ok), 0)::DOUBLE AS e FROM c GROUP BY worker)
        SELECT worker, round(CASE WHEN e > 0 THEN n / e ELSE 0.0 END, 6)::DOUBLE AS tokens_per_second, 12.5::DOUBLE AS blocks_per_second FROM m""",
    "q39_blocks_as_json": f"WITH {BLOCKS} SELECT doc_id, ordinal, page, block_idx, text, size, font, y1 AS bottom, 0.5::DOUBLE AS green, x0, line_count FROM b",
    "q40_page_ladder": f"""{LADDER}, c AS (SELECT *, CASE WHEN n <= 2 THEN 1 ELSE 1 + {half('h')[0]} + {half('o')[0]} END AS api_calls,
               CASE WHEN n <= 2 THEN 0 ELSE {half('h')[1]} + {half('o')[1]} END AS source_fallback_blocks FROM nh)
        SELECT doc_id, page, n AS items, api_calls::BIGINT AS api_calls, 1::BIGINT AS retry_attempts, source_fallback_blocks::BIGINT AS source_fallback_blocks,
               CASE WHEN n <= 2 THEN 0 WHEN o <= 2 THEN 1 ELSE 2 END::BIGINT AS max_split_level, CASE WHEN source_fallback_blocks > 0 THEN 'ok_with_warnings' ELSE 'ok' END AS status FROM c""",
    "q41_document_outcomes": f"""{LADDER}, c AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE {half('h')[1]} + {half('o')[1]} END AS f FROM nh),
        d AS (SELECT doc_id, min(page) FILTER (input_chars > 2000) AS page, min_by(input_chars, page) FILTER (input_chars > 2000) AS input_chars, sum(f) AS f FROM c GROUP BY doc_id)
        SELECT doc_id, CASE WHEN page IS NOT NULL THEN 'page_too_large' WHEN f > 0 THEN 'ok_with_warnings' ELSE 'ok' END AS status, page, input_chars, 2000::BIGINT AS max_input_chars FROM d""",
    "q32_packed_requests": f"""WITH {RUNS}, c AS (SELECT doc_id, segment_id, length({flattened('min(text)')}) AS chars FROM s GROUP BY doc_id, segment_id
             HAVING count(*) = 1 AND min(kind) IN ('toc', 'heading', 'list')),
        q AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 4500 AS c,
                     (row_number() OVER (PARTITION BY doc_id ORDER BY segment_id) - 1) // 12 AS i FROM c),
        f AS (SELECT *, CASE WHEN lag(c) OVER w IS NULL OR lag(c) OVER w <> c OR lag(i) OVER w <> i THEN 1 ELSE 0 END AS new FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY segment_id))
        SELECT doc_id, segment_id, sum(new) OVER (PARTITION BY doc_id ORDER BY segment_id)::BIGINT - 1 AS pack FROM f""",
}
