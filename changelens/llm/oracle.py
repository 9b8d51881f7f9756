"""DuckDB statements for the queries that SQL can express."""

OP9_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    3.0::DOUBLE * source_size AS cap FROM sizes),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
final AS (
  SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, final.level * weight) AS target FROM levels, final),
taken AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mixing:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM taken
"""

# A word's unsigned CRC-32: a table of 256 entries, then one step per byte.
_CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(CAST(i AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) AS t)"""


def _crc32(text: str) -> str:
    """The checksum of a text in a query that joins `tab`."""
    return f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)])))"""


def _words(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"coalesce(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


# Base32 of a SHA-1: each five hexadecimal digits are four letters.
OP4_WARC = """
WITH hashed AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM last
"""


OP11_IMPORTANCE_RESAMPLING = f"""
WITH {_CRC_TABLE},
rows AS (SELECT row_number() OVER () AS row, doc_id, {_words("text")} AS words FROM documents),
held AS (SELECT row, unnest(words) AS w FROM rows),
wanted AS (SELECT unnest({_words("text")}) AS w FROM benchmark),
known AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM held UNION SELECT w FROM wanted), tab),
raw AS (SELECT bucket, count(*) AS s FROM held JOIN known USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN known USING (w) GROUP BY bucket),
gains AS (
  SELECT b.bucket, CAST(floor(1000 * ln(
      CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM held) + 10000) AS DOUBLE)
      / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM wanted) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN raw ON raw.bucket = b.bucket LEFT JOIN target ON target.bucket = b.bucket),
weights AS (
  SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM held JOIN known USING (w) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM rows LEFT JOIN weights USING (row)),
ranks AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (row)
"""


OP12_DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_words("text")} AS words FROM documents),
items AS (SELECT item_id, {_words("text")} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(words[s:s + 9], ' ') AS passage, least(len(words), 10) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT row, s, n, array_to_string(words[s:s + n - 1], ' ') AS passage
  FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM docs, sizes)),
hits AS (SELECT r.row, r.s, r.n, w.item_id FROM runs r JOIN windows w USING (passage, n)),
listed AS (
  SELECT row, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY row),
covered AS (
  SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(s, s + n)) AS place FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN listed USING (row)
"""


OP13_CONVERSATION_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY place) AS turns FROM turns GROUP BY conv_id),
sized AS (SELECT own.*, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, tab),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.turns[:s.h], []), s.turns[s.h + 1:]) AS turns
  FROM sized s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 5),
members AS (
  SELECT conv_id, len(turns) AS n_turns, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
  SELECT depth, turns[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * strlen(n.path[n.depth].t) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (conv_id, depth)),
up AS (
  SELECT conv_id, depth, parent_conv_id, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, saved FROM counted
  UNION ALL
  SELECT p.conv_id, p.depth, p.parent_conv_id, u.leaf, u.saved FROM up u JOIN linked p ON p.conv_id = u.parent_conv_id AND p.depth = u.depth - 1),
sums AS (SELECT conv_id, depth, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN sums USING (conv_id, depth)
"""


def statements() -> dict[str, str]:
    return {
        "op4_warc": OP4_WARC,
        "op9_mixing": OP9_MIXING,
        "op11_importance_resampling": OP11_IMPORTANCE_RESAMPLING,
        "op12_decontamination": OP12_DECONTAMINATION,
        "op13_conversation_trie": OP13_CONVERSATION_TRIE,
    }
