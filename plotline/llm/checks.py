"""Check SQL of the queries that SQL can state, from the contracts alone."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BENCHMARK_WINDOWS = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
wanted AS (SELECT DISTINCT item, least(10, len(words)) AS size, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS phrase
  FROM (SELECT item, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM wanted),
found AS (SELECT doc_id, i, p.size, item FROM (SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS phrase
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM texts, sizes)) p JOIN wanted w ON w.size = p.size AND w.phrase = p.phrase),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts t LEFT JOIN hit h ON h.doc_id = t.doc_id LEFT JOIN named n ON n.doc_id = t.doc_id"""

JACCARD_CLASSES = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM texts WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, m.least_id) AS component_id
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY 1) m ON m.a = t.doc_id"""


def feistel_shards(shards: int, keys: list[int], mix_a: int, mix_b: int, modulus: int) -> str:
    """Places by the published constants; the checksum bit by bit from its polynomial."""

    def permuted(source: str) -> str:
        """number, v of the permutation of column v of ``source``."""
        text = f"SELECT number, n, side, v // side AS l, v % side AS r FROM {source}"
        for key in keys:
            text = f"""SELECT number, n, side, r AS l, (l + (xor(t, t >> 15) * {mix_b}) % {modulus}) % side AS r
              FROM (SELECT *, ((r + {key}) * {mix_a}) % {modulus} AS t FROM ({text}))"""
        return f"SELECT number, n, side, l * side + r AS v FROM ({text})"

    return f"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS octets, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
summed AS (SELECT doc_id, octets, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, table_[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM raw, steps),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, octets, crc) - 1 AS number, count(*) OVER () AS n, ceil(sqrt(count(*) OVER ()))::BIGINT AS side FROM summed),
walk AS (
  {permuted("(SELECT number, n, side, number AS v FROM numbered)")}
  UNION ALL
  {permuted("(SELECT * FROM walk WHERE v >= n)")})
SELECT doc_id, octets + 1 AS size, crc AS text_crc32, 'rows' AS law, (v % {shards})::INT AS shard, v // {shards} AS slot, NULL::INT AS grown_shard, s.number AS number
FROM numbered s JOIN walk w ON w.number = s.number AND w.v < s.n"""


EXACT_COPIES = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""

PREFIX_TRIE = """
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_),
lists AS (SELECT conv_id AS c, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS seq FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
heads AS (SELECT c, seq, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda r, b: xor(r >> 8, table_[xor(r, b) % 256 + 1])), 4294967295) % 9 AS h FROM lists, steps),
rebuilt AS (SELECT x.c, list_concat(coalesce(b.seq, [])[1 : x.h], x.seq[x.h + 1 :]) AS seq FROM heads x LEFT JOIN lists b ON b.c = x.c - x.c % 5),
prefixes AS (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt),
nodes AS (SELECT seq[1 : depth] AS path, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (len(seq) = depth), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2),
kids AS (SELECT path[1 : depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.path[-1].text)) END AS saved FROM nodes n LEFT JOIN kids k ON k.path = n.path),
sums AS (SELECT path[1 : d] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1 : n.depth - 1]"""

RANKED_SEARCH = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
items AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
size AS (SELECT count(*) AS documents, sum(len(words))::BIGINT AS length FROM texts WHERE len(words) > 0),
asked AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(words) AS term FROM items) GROUP BY 1, 2, 3),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM texts) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3, 4),
weights AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY 1), size),
scores AS (SELECT i, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // length))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), size GROUP BY 1, 2, 3, 4),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20"""
