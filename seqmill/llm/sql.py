"""DuckDB SQL for the operators that SQL can express."""

#: WARC: digests of the full payloads, and which of equal large payloads responds.
WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""

#: Chat formatting: what the digests must be, from the rows themselves.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(text, chr(92), chr(92) || chr(92)) AS doubled FROM t
), f AS (
  SELECT *, regexp_replace(doubled, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]', 'XXXXX', 'g') AS x,
    length(doubled) + len(regexp_extract_all(doubled, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]')) AS escaped
  FROM e
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(escaped + CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 7 WHEN 'system' THEN 22
        ELSE 20 + length(role) END) AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c
"""

#: Filter audit: masks by document, then every step of every order against the cells.
AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS filter FROM o, range(1, 6) r(k)
), t AS (
  SELECT s.filter_order, s.step, s.filter, max(CASE WHEN f.letter = s.filter THEN f.bit END) AS bit,
    sum(CASE WHEN instr(s.filter_order, f.letter) < s.step THEN f.bit ELSE 0 END) AS earlier
  FROM s, f GROUP BY ALL
), x AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN CAST(mask AS BIGINT) & CAST(earlier + bit AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND CAST(mask AS BIGINT) & CAST(earlier AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND CAST(mask AS BIGINT) & CAST(earlier AS BIGINT) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND CAST(mask AS BIGINT) & CAST(earlier AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND CAST(mask AS BIGINT) & CAST(earlier AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, t GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM x
"""

#: Runs: pairs of equal words at each distance, islands of them, and the smallest period of each stretch.
RUNS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, words, len(words) AS n, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda crc, byte:
    list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h
  FROM d
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, h // 10 AS g FROM c
), i AS (
  SELECT doc_id, n, unnest(range(n)) AS i, a, 1 + (n - a) // (3 + g % 8) AS p, words FROM a
), w AS (
  SELECT doc_id, n, i, CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % p + 1] END AS word FROM i
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS q FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), found AS (
  SELECT doc_id, count(*) AS n_runs, max({'length': length, 's': -start, 'q': -q}) AS longest,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-longest.s AS BIGINT) AS start,
  CAST(longest.length AS BIGINT) AS length, CAST(-longest.q AS BIGINT) AS period,
  CAST(1000 * longest.length // -longest.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Nearest neighbours have no exact SQL here: the search is approximate. The rest is not SQL either.
ORACLES: dict[str, str] = {"op5_warc": WARC, "op1_chat_formatting": CHAT, "op12_periodic_runs": RUNS, "op13_filter_audit": AUDIT}
