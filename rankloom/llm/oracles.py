"""The SQL that must give the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations

from .secret_scan import BASE, RULES

TOP = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bytes_of = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, unused: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: {step}))"


def secrets() -> str:
    """Where a match starts follows from the lengths of what stands between matches and of the matches before it."""
    quote = lambda s: s.replace("'", "''")
    parts = []
    for k, r in enumerate(RULES):
        pattern = quote(("(?i)" if r.fold else "") + r.pattern)
        parts.append(f"""SELECT n, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {r.group}) AS graded,
            string_split_regex(t, '{pattern}') AS between FROM d""")
    both = " UNION ALL ".join(parts)
    text = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents), m AS ({both}
    ), each AS (SELECT n, k, kind, least, found, graded, between, unnest(range(1, len(found) + 1)) AS j FROM m
    ), s AS (SELECT n, k, kind, CAST(list_sum(list_transform(between[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(found[j]) AS size
      FROM each WHERE length(graded[j]) >= least
    ), spans AS (SELECT n, k, kind, a, a + size AS z FROM s
    ), sums AS (SELECT n, {counts}, {text} FILTER (k < {len(BASE)}) AS base, {text} AS whole FROM spans GROUP BY n)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(whole, '') AS spans FROM d LEFT JOIN sums USING (n)"""


def merkle() -> str:
    """Levels by recursion, what stands beside a node by windows, the way up as a fold over texts."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    digest = lambda t: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sides = lambda name, source, by, shift: f"""{name} AS (SELECT {by} lvl + {shift} AS lvl, pos // 16 AS up, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {source} WHERE size > 1 WINDOW w AS (PARTITION BY {by} lvl, pos // 16 ORDER BY pos))"""  # noqa: E731
    return f"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, {digest("text")} AS leaf, {digest(lower)} AS alt, coalesce({crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0, false) AS tampered FROM documents
    ), n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM d
    ), up AS (SELECT tree, 0 AS lvl, pos, size, leaf AS h FROM n UNION ALL SELECT tree, lvl + 1, pos // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE size > 1 GROUP BY tree, lvl, pos // 16, size
    ), tops AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM up WHERE size = 1
    ), crown AS (SELECT 0 AS lvl, pos, size, h FROM tops UNION ALL SELECT lvl + 1, pos // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE size > 1 GROUP BY lvl, pos // 16, size
    ), {sides("low", "up", "tree,", 0)}, {sides("high", "crown", "", 100)}
    , ways AS (SELECT n.tree, n.pos, lvl, l, r FROM n JOIN low ON low.tree = n.tree AND low.pos = n.pos // CAST(pow(16, lvl) AS BIGINT)
      UNION ALL SELECT n.tree, n.pos, lvl, l, r FROM n JOIN tops USING (tree) JOIN high ON high.pos = tops.pos // CAST(pow(16, lvl - 100) AS BIGINT)
    ), way AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS steps FROM ways GROUP BY tree, pos
    ), f AS (SELECT doc_id, leaf, tops.h AS subroot, (SELECT h FROM crown WHERE size = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
        list_reduce(list_prepend(CASE WHEN tampered THEN alt ELSE leaf END, coalesce(steps, CAST([] AS VARCHAR[]))), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
      FROM n JOIN tops USING (tree) LEFT JOIN way ON way.tree = n.tree AND way.pos = n.pos)
    SELECT *, folded_root = root AS verified FROM f"""


def trie() -> str:
    """A subtree's totals by adding each node to all that stand above its smallest member's beginning."""
    content = "strlen(role) || ':' || role || txt"
    return f"""WITH raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL
    ), t AS (SELECT c, sha256({content}) AS k, strlen(txt) AS b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256({content})) AS p FROM raw
    ), n AS (SELECT c, count(*) AS turns FROM t GROUP BY c
    ), convs AS (SELECT n.c, {crc32("CAST(n.c AS VARCHAR)")} % 9 AS h, n.c - n.c % 5 AS f, least({crc32("CAST(n.c AS VARCHAR)")} % 9, coalesce(g.turns, 0)) AS got FROM n LEFT JOIN n g ON g.c = n.c - n.c % 5
    ), r AS (SELECT convs.c, p, k, b FROM convs JOIN t ON t.c = f AND p <= got UNION ALL SELECT c, p - h + got, k, b FROM t JOIN convs USING (c) WHERE p > h
    ), pre AS (SELECT c, p AS depth, b, sha256(string_agg(k, '') OVER (PARTITION BY c ORDER BY p)) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM convs
    ), node AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b FROM pre GROUP BY depth, k
    ), m AS (SELECT c, depth, conv_id AS head FROM pre JOIN node USING (depth, k)
    ), named AS (SELECT node.*, m.head AS parent_conv_id FROM node LEFT JOIN m ON m.c = conv_id AND m.depth = node.depth - 1
    ), fan AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY ALL
    ), full_nodes AS (SELECT named.*, coalesce(n_children, 0) AS n_children FROM named LEFT JOIN fan USING (conv_id, depth)
    ), sums AS (SELECT m.head AS conv_id, m.depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens
      FROM full_nodes x JOIN m ON m.c = x.conv_id AND m.depth <= x.depth GROUP BY ALL
    ), ends AS (SELECT head AS conv_id, depth, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM m WHERE (c, depth) IN (SELECT (c, max(depth)) FROM pre GROUP BY c) GROUP BY ALL)
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM full_nodes JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)"""


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": TOP, "op11_secret_scan": secrets(), "op12_merkle_manifest": merkle(), "op13_prefix_trie": trie()}
