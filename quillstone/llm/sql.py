"""DuckDB SQL for the registered queries that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: Rendered length: marks (12 + 10 + 10 code points a turn), role and text, and one backslash for each escape.
CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), turns AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS head
  FROM rows
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + length(head) + 32) AS BIGINT) AS formatted_chars
FROM turns
GROUP BY conv_id
"""

LINE_TEMPLATES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), masked AS (
  SELECT *, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM lines
), split AS (
  SELECT *, string_split(masked, ' ') AS tokens FROM masked
), pathed AS (
  SELECT *, len(tokens) AS n_tokens, array_to_string(tokens[1:3], ' ') AS path
  FROM split WHERE trim(line, ' ') <> ''
), inside AS (
  SELECT p.* FROM pathed p JOIN (
    SELECT n_tokens, path FROM pathed GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10
  ) USING (n_tokens, path)
), tokens AS (
  SELECT doc_id, place, n_tokens, path, unnest(tokens) AS token, unnest(range(n_tokens)) AS pos FROM inside
), fixed AS (
  SELECT n_tokens, path, pos, token FROM tokens WHERE pos >= 3 GROUP BY ALL HAVING count(*) >= 10
), parts AS (
  SELECT t.doc_id, t.place, t.n_tokens, t.pos,
         CASE WHEN t.pos < 3 OR f.token IS NOT NULL THEN t.token ELSE '<*>' END AS part
  FROM tokens t LEFT JOIN fixed f ON t.n_tokens = f.n_tokens AND t.path = f.path AND t.pos = f.pos AND t.token = f.token
), templated AS (
  SELECT doc_id, place, string_agg(part, ' ' ORDER BY pos) AS template
  FROM parts GROUP BY doc_id, place HAVING count(*) FILTER (part <> '<*>') >= 0.5 * count(*)
), dropped AS (
  SELECT doc_id, place FROM templated JOIN (
    SELECT template FROM templated GROUP BY template HAVING count(DISTINCT doc_id) >= 10
  ) USING (template)
)
SELECT l.doc_id, count(*) AS n_lines, count(d.doc_id) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (d.doc_id IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.place = d.place
GROUP BY l.doc_id
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), positions AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM docs
), windows AS (
  SELECT doc_id, p, array_to_string(list_slice(words, p, p + 19), ' ') AS w FROM positions WHERE p + 19 <= len(words)
), repeats AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS turn FROM windows) WHERE turn > 1
), marked AS (
  SELECT a.doc_id, a.p, a.words[a.p] AS word,
         max(r.p) OVER (PARTITION BY a.doc_id ORDER BY a.p ROWS UNBOUNDED PRECEDING) AS last_repeat
  FROM positions a LEFT JOIN repeats r ON a.doc_id = r.doc_id AND a.p = r.p
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (last_repeat IS NULL OR last_repeat < p - 19) AS text,
         count(*) FILTER (last_repeat >= p - 19) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

#: The lattice as a table: for each row and state the least (cost, audit, repaired rows), walked by recursion.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key,
         coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), hurt AS (  -- crc32: a byte is taken in, then eight bits are shifted out
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, range(9 * length(key))),
           lambda c, k: CASE WHEN k % 9 = 0 THEN xor(c, CAST(ascii(substr(key, k // 9 + 1, 1)) AS BIGINT))
                        WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 20 AS how
  FROM keyed
), copied AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN how = 3 THEN 2 WHEN how = 0 THEN 0 ELSE 1 END)) AS copy
  FROM hurt
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy) AS i FROM copied
), judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'fine' END AS fault
  FROM placed
), walk AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 'r': ''} AS s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) AS s1,
         {'c': 5, 'a': 'I', 'r': chr(10) || 'user:'} AS su, {'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS sa
  FROM (SELECT DISTINCT conv_id FROM conversations) c
  UNION ALL
  SELECT conv_id, i, s0, s1, su1,
         list_min([sa, CASE WHEN su1 IS NOT NULL THEN {'c': su1.c + 5, 'a': su1.a || 'I', 'r': su1.r || chr(10) || 'assistant:'} END]) AS sa
  FROM (
    SELECT conv_id, i, s0, s1, sa,
           list_min([su, CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 5, 'a': s0.a || 'I', 'r': s0.r || chr(10) || 'user:'} END,
                     CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 5, 'a': s1.a || 'I', 'r': s1.r || chr(10) || 'user:'} END,
                     CASE WHEN sa IS NOT NULL THEN {'c': sa.c + 5, 'a': sa.a || 'I', 'r': sa.r || chr(10) || 'user:'} END]) AS su1
    FROM (
      SELECT w.conv_id, j.i,
             {'c': s0.c + 2, 'a': s0.a || 'D', 'r': s0.r} AS s0,
             list_min([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D', 'r': s1.r} END,
                       CASE WHEN ok AND initial = 's' THEN {'c': s0.c + x, 'a': s0.a || 'K', 'r': s0.r || line} END]) AS s1,
             list_min([CASE WHEN su IS NOT NULL THEN {'c': su.c + 2, 'a': su.a || 'D', 'r': su.r} END,
                       CASE WHEN ok AND initial = 'u' THEN {'c': s0.c + x, 'a': s0.a || 'K', 'r': s0.r || line} END,
                       CASE WHEN ok AND initial = 'u' AND s1 IS NOT NULL THEN {'c': s1.c + x, 'a': s1.a || 'K', 'r': s1.r || line} END,
                       CASE WHEN ok AND initial = 'u' AND sa IS NOT NULL THEN {'c': sa.c + x, 'a': sa.a || 'K', 'r': sa.r || line} END,
                       CASE WHEN ok THEN {'c': s0.c + x + 1, 'a': s0.a || 'R', 'r': s0.r || as_user} END,
                       CASE WHEN ok AND s1 IS NOT NULL THEN {'c': s1.c + x + 1, 'a': s1.a || 'R', 'r': s1.r || as_user} END,
                       CASE WHEN ok AND sa IS NOT NULL THEN {'c': sa.c + x + 1, 'a': sa.a || 'R', 'r': sa.r || as_user} END]) AS su,
             list_min([CASE WHEN sa IS NOT NULL THEN {'c': sa.c + 2, 'a': sa.a || 'D', 'r': sa.r} END,
                       CASE WHEN ok AND initial = 'a' AND su IS NOT NULL THEN {'c': su.c + x, 'a': su.a || 'K', 'r': su.r || line} END,
                       CASE WHEN ok AND su IS NOT NULL THEN {'c': su.c + x + 1, 'a': su.a || 'R', 'r': su.r || as_assistant} END]) AS sa
      FROM walk w JOIN (
        SELECT conv_id, i, initial, fault IN ('fine', 'truncated') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x,
               chr(10) || role || ':' || text AS line, chr(10) || 'user:' || text AS as_user, chr(10) || 'assistant:' || text AS as_assistant
        FROM judged
      ) j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    )
  )
), last AS (
  SELECT conv_id, list_min([s0, sa]) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT l.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
FROM last l LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""

SQL = {"op11_conversation_repair": CONVERSATION_REPAIR, "op4_line_templates": LINE_TEMPLATES, "op5_exact_dedup": EXACT_DEDUP, "op6_chat_format": CHAT_FORMAT, "op8_substring_dedup": SUBSTRING_DEDUP}
