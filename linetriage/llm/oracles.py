"""SQL that must give the same rows as the queries it is named after."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_embedding_neardup"] = r"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT r.id, p.b FROM reach r JOIN p ON p.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM p GROUP BY a)
SELECT c.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.id = c.id"""

ORACLE_SQL["op4_html_extraction"] = r"""WITH inner_ AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1|br)>') AS parts FROM pages),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(x, '</?b>', '', 'g')) AS parts FROM inner_),
decoded AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&amp', '&')) AS parts FROM plain),
blocks AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM decoded),
t AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

ORACLE_SQL["op6_ngram_jaccard"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [hash(words)]
  ELSE list_transform(range(1, len(words) - 1), lambda i: hash(words[i:i + 2])) END) AS gram FROM w)),
s AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b FROM common JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, p.b FROM reach r JOIN p ON p.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN s ON s.doc_id = id"""

ORACLE_SQL["op8_line_dedup"] = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d),
c AS (SELECT doc_id, i, sum(len(regexp_extract_all(lines[i], '\S+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto, len(regexp_extract_all(lines[i], '\S+')) AS own FROM l),
win AS (SELECT x.doc_id, x.i AS a, y.i AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i
  WHERE y.upto - x.upto + x.own >= 50 AND (y.upto - y.own - x.upto + x.own < 50 OR y.upto - x.upto < 50)),
keyed AS (SELECT win.doc_id, a, b, hash(lines[a:b]) AS key, b - a AS span FROM win JOIN d ON d.doc_id = win.doc_id),
first AS (SELECT key, span, min(doc_id * 1000000 + a) AS place FROM keyed GROUP BY key, span),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM keyed JOIN first USING (key, span) WHERE doc_id * 1000000 + a > place),
kept AS (SELECT l.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS removed_lines,
  coalesce(string_agg(lines[l.i], chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT doc_id, text, length(text) AS n_chars, removed_lines FROM kept"""


def _merkle_sql(heights: int = 6, upper: int = 4) -> str:
    """Every level of the source trees and of the tree over their roots as a query of its own."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # CRC-32, reflected, bit by bit.
    byte = "list_reduce([xor(c, ascii(x)), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda c, x: {byte.replace('ascii(x)', 'x')}), 4294967295)"
    levels = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({head} || {field.format('text')}) AS leaf, "
        f"CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field.format(lowered)}) END AS tampered FROM documents)",
        "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS slot, count(*) OVER (PARTITION BY tree) AS total FROM d)",
        "a0 AS (SELECT tree, slot, total, leaf AS digest FROM l)",
    ]

    def climb(name: str, count: int) -> None:
        for i in range(count):
            levels.append(
                f"{name}{i + 1} AS MATERIALIZED (SELECT tree, slot // 16 AS slot, (any_value(total) + 15) // 16 AS total, "
                f"CASE WHEN any_value(total) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY slot)) END AS digest "
                f"FROM {name}{i} GROUP BY tree, slot // 16)")
            levels.append(
                f"{name}s{i} AS MATERIALIZED (SELECT x.tree, x.slot, coalesce(string_agg(y.digest, '' ORDER BY y.slot) FILTER (y.slot < x.slot), '') AS l, "
                f"coalesce(string_agg(y.digest, '' ORDER BY y.slot) FILTER (y.slot > x.slot), '') AS r, any_value(x.total) > 1 AS real "
                f"FROM {name}{i} x JOIN {name}{i} y ON x.tree = y.tree AND x.slot // 16 = y.slot // 16 GROUP BY x.tree, x.slot)")

    climb("a", heights)
    levels.append(
        f"b0 AS MATERIALIZED (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS slot, count(*) OVER () AS total, digest FROM a{heights})")
    climb("b", upper)
    digest, steps, joins, proof = "coalesce(tampered, leaf)", "", "", []
    for i in range(heights):
        joins += f" JOIN as{i} ON as{i}.tree = l.tree AND as{i}.slot = l.slot // {16 ** i}"
    joins += " JOIN b0 ON b0.name = l.tree"
    for i in range(upper):
        joins += f" JOIN bs{i} ON bs{i}.slot = b0.slot // {16 ** i}"
    names = [f"as{i}" for i in range(heights)] + [f"bs{i}" for i in range(upper)]
    for n, s in enumerate(names):
        last = f"f{n - 1}" if n else digest
        steps += f", CASE WHEN {s}.real THEN sha256({s}.l || {last} || {s}.r) ELSE {last} END AS f{n}"
        proof.append(f"CASE WHEN {s}.real THEN {s}.l || {s}.r ELSE '' END")
    levels.append(
        f"p AS (SELECT doc_id, leaf, b0.digest AS subroot, (SELECT digest FROM b{upper}) AS root, sha256({' || '.join(proof)}) AS proof_sha256{steps} FROM l{joins})")
    last = f"f{len(names) - 1}"
    return "WITH " + ",\n".join(levels) + (
        f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM p")


ORACLE_SQL["op12_merkle_manifest"] = _merkle_sql()
