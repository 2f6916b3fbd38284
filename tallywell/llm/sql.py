"""SQL of the longer contracts, put together from parts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Remainders of the CRC-32 of one byte, by the rule of its polynomial.
_CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(r ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS r FROM range(256) AS x(i)))"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text of characters below U+0800; the table `crc_table` is in scope."""
    points = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)"
    coded = f"flatten(list_transform({points}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {coded}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, levels: int) -> str:
    """From {name}0 (g, p, h, c) on: nodes of each level, and beside them what stands before and after each in its run."""
    parts = []
    for k in range(levels):
        run = "PARTITION BY g, p // 3 ORDER BY p ROWS BETWEEN"
        parts.append(f"""{name}_side{k} AS MATERIALIZED (SELECT g, p, c, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT g, p // 3 AS p, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h,
  (max(c) + 2) // 3 AS c FROM {name}{k} GROUP BY g, p // 3)""")
    return ",\n".join(parts)


def _climb(name: str, rows: str, levels: int) -> str:
    """From {rows}0 (n, g, p, proof, f) on: the siblings gathered and the node folded, level by level."""
    return ",\n".join(
        f"""{rows}{k + 1} AS MATERIALIZED (SELECT n, g, p // 3 AS p, proof || b || a AS proof, CASE WHEN c = 1 THEN f ELSE sha256(b || f || a) END AS f
  FROM {rows}{k} JOIN {name}_side{k} USING (g, p))""" for k in range(levels))


def merkle(levels: int = 12) -> str:
    """Trees of up to 3 ** levels nodes."""
    return f"""WITH {_CRC_TABLE},
leaves AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, source, {_leaf("text")} AS leaf,
  CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS given FROM documents, crc_table),
placed AS MATERIALIZED (SELECT *, coalesce('=' || source, '') AS g,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS c FROM leaves),
s0 AS MATERIALIZED (SELECT g, p, leaf AS h, c FROM placed),
{_tree("s", levels)},
t0 AS MATERIALIZED (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS c, g AS source FROM s{levels}),
{_tree("t", levels)},
x0 AS MATERIALIZED (SELECT n, g, p, '' AS proof, given AS f FROM placed),
{_climb("s", "x", levels)},
y0 AS MATERIALIZED (SELECT n, 'all' AS g, t0.p, proof, f FROM x{levels} JOIN t0 ON t0.source = x{levels}.g),
{_climb("t", "y", levels)}
SELECT doc_id, leaf, s{levels}.h AS subroot, t{levels}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t{levels}.h AS verified
FROM y{levels} JOIN placed USING (n) JOIN s{levels} ON s{levels}.g = placed.g, t{levels}"""


def spellings(least_length: int = 7, least_count: int = 2, every: int = 31, ratio: int = 10) -> str:
    return f"""WITH RECURSIVE {_CRC_TABLE},
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]{{{least_length},}}')) AS run FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
  SELECT n, CASE WHEN h % {every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {least_length} GROUP BY word HAVING sum(n) >= {least_count}),
skipped AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS b, substr(word, i + 2) AS e
  FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other, y.n AS m FROM skipped x JOIN skipped y ON x.b = y.b AND x.e = y.e AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM skipped x JOIN words y ON x.b || x.e = y.word
  UNION SELECT y.word, x.word, x.n FROM skipped x JOIN words y ON x.b || x.e = y.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN other END AS form, CASE WHEN m >= {ratio} * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
ways AS (SELECT word, form AS root, 1 AS steps FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT ways.word, form, steps + 1 FROM ways JOIN judged ON judged.word = ways.root WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM judged LEFT JOIN roots USING (word)"""
