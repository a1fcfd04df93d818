"""SQL for DuckDB that gives the same rows as the queries of the catalog, from the same tables."""

from __future__ import annotations

from strandline.functions.seq import AFTER, BEFORE
from strandline.sources.reads import ADAPTER, BASES, LETTERS

G = f"translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}')"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"

#: Named steps; a query takes those that it needs, in this order.
STEPS = {
    "g": f"SELECT doc_id, g FROM (SELECT doc_id, {G} AS g FROM documents) WHERE length(g) >= 45",
    "f": "SELECT doc_id * 1048576 + k AS frag_id, substr(g, k * 50 + 1, 100) AS seq FROM (SELECT doc_id, g, unnest(range(0, (length(g) - 45) // 50 + 1)) AS k FROM g)",
    "reads": f"SELECT frag_id * 2 AS read_id, frag_id, 0::BIGINT AS strand, seq FROM f UNION ALL SELECT frag_id * 2 + 1, frag_id, 1, {RC.format('seq')} FROM f",
    "noisy": f"""SELECT read_id, frag_id, strand, CASE kind WHEN 1 THEN one WHEN 2 THEN substr(one, 1, p + 6) || translate(substr(one, p + 7, 1), 'ACGT', 'CGTA') || substr(one, p + 8)
        WHEN 3 THEN left(seq, length(seq) - {len(ADAPTER)}) || '{ADAPTER}' ELSE seq END AS seq FROM (SELECT *, substr(seq, 1, p - 1) || translate(substr(seq, p, 1), 'ACGT', 'CGTA') || substr(seq, p + 1) AS one
        FROM (SELECT *, 10 + frag_id % 30 AS p, (frag_id + strand) % 4 AS kind FROM reads))""",
    "sfx": "SELECT read_id, pos, substr(seq, pos + 1) || '$' AS suffix, CASE WHEN pos = 0 THEN '$' ELSE substr(seq, pos, 1) END AS sym, reverse(seq) AS ord FROM (SELECT read_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM reads)",
    "bwt": "SELECT row_number() OVER (ORDER BY suffix, ord, read_id) - 1 AS rk, read_id, pos, sym FROM sfx",
    "q": f"SELECT query, q FROM (SELECT item_id AS query, {G} AS q FROM benchmark)",
    "qs": "SELECT query, q, p, substr(q, p, 24) AS seed FROM (SELECT query, q, unnest(range(1, length(q) - 22)) AS p FROM q WHERE length(q) >= 24)",
    "hits": "SELECT query, read_id, p - 1 AS q_start, p - 1 + length(seq) AS q_end FROM qs JOIN reads ON seed = substr(seq, 1, 24) WHERE substr(q, p, length(seq)) = seq",
    "near": """SELECT DISTINCT query, read_id, st - 1 AS q_start, st - 1 + length(seq) AS q_end, hamming(substr(q, st, length(seq)), seq) AS mismatches FROM (
        SELECT query, q, read_id, seq, p - i * size AS st FROM (SELECT query, q, size, p, substr(q, p, size) AS seed FROM (SELECT query, q, size, unnest(range(1, length(q) - size + 2)) AS p FROM q, (SELECT DISTINCT length(seq) // 3 AS size FROM noisy) WHERE length(q) >= size))
        JOIN (SELECT read_id, seq, length(seq) // 3 AS size, i, substr(seq, i * (length(seq) // 3) + 1, length(seq) // 3) AS seed FROM noisy, (SELECT unnest([0, 1, 2]) AS i)) USING (size, seed))
        WHERE st >= 1 AND st - 1 + length(seq) <= length(q) AND hamming(substr(q, st, length(seq)), seq) <= 2""",
    "w": """SELECT query * 4096 + k AS query, substr(q, k * 60 + 1, 150) AS q FROM (SELECT query, q, unnest(range(0, greatest(length(q) - 90, 0) // 60 + 1)) AS k FROM q)
        UNION ALL SELECT query * 4096 + 2048 + k, substr(q, k * 70 + 1, 50) FROM (SELECT query, q, unnest(range(0, greatest(length(q) - 50, 0) // 70 + 1)) AS k FROM q)""",
    "wnear": """SELECT DISTINCT query, read_id FROM (
        SELECT query, q, read_id, seq, p - i * size AS st FROM (SELECT query, q, size, p, substr(q, p, size) AS seed FROM (SELECT query, q, size, unnest(range(1, length(q) - size + 2)) AS p FROM w, (SELECT DISTINCT length(seq) // 3 AS size FROM noisy) WHERE length(q) >= size))
        JOIN (SELECT read_id, seq, length(seq) // 3 AS size, i, substr(seq, i * (length(seq) // 3) + 1, length(seq) // 3) AS seed FROM noisy, (SELECT unnest([0, 1, 2]) AS i)) USING (size, seed))
        WHERE st >= 1 AND st - 1 + length(seq) <= length(q) AND hamming(substr(q, st, length(seq)), seq) <= 2""",
    "cand": """SELECT query, read_id, q, seq FROM (SELECT query, read_id FROM wnear UNION SELECT query, read_id FROM (SELECT query, substr(q, p, 24) AS seed FROM (SELECT query, q, unnest(range(1, length(q) - 22)) AS p FROM w WHERE length(q) >= 24))
        JOIN (SELECT read_id, left(seq, 24) AS seed FROM noisy UNION SELECT read_id, right(seq, 24) FROM noisy) USING (seed)
        UNION SELECT query, read_id FROM (SELECT query, left(q, 24) AS seed FROM w WHERE length(q) BETWEEN 24 AND 100) JOIN (SELECT read_id, substr(seq, p, 24) AS seed FROM (SELECT read_id, seq, unnest(range(1, length(seq) - 22)) AS p FROM noisy)) USING (seed)
        UNION SELECT query, read_id FROM w JOIN noisy ON contains(seq, q) WHERE length(q) BETWEEN 1 AND 23) JOIN w USING (query) JOIN noisy USING (read_id)""",
    # every stretch of equal bases on every diagonal of a pair
    "stretch": """SELECT query, read_id, min(i) - 1 AS qs, max(i) AS qe, min(j) - 1 AS rs, max(j) AS re FROM (SELECT *, i - row_number() OVER (PARTITION BY query, read_id, i - j ORDER BY i) AS island FROM (
        SELECT *, unnest(range(1, length(seq) + 1)) AS j FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM cand)) WHERE substr(q, i, 1) = substr(seq, j, 1)) GROUP BY query, read_id, i - j, island HAVING count(*) >= 10""",
    "longest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, read_id ORDER BY qe - qs DESC, qs, rs) AS place FROM stretch) WHERE place = 1",
    "cls": f"""SELECT query, read_id, CASE WHEN inside OR round_ OR cut_after OR cut_before THEN 'exact' WHEN qs IS NULL THEN 'unmatched' ELSE 'inexact' END AS class,
        CASE WHEN inside THEN 'inside' WHEN round_ THEN 'around' WHEN cut_after AND re = length(seq) THEN 'left' WHEN cut_after THEN 'after' WHEN cut_before AND rs = 0 THEN 'right' WHEN cut_before THEN 'before' ELSE '' END AS how,
        CASE WHEN inside THEN strpos(q, seq) - 1 WHEN round_ THEN 1 - strpos(seq, q) ELSE qs END AS q_start, CASE WHEN inside THEN strpos(q, seq) - 1 + length(seq) WHEN round_ THEN length(seq) + 1 - strpos(seq, q) ELSE qe END AS q_end,
        CASE WHEN inside OR round_ OR cut_after THEN 0 ELSE rs END AS r_start, CASE WHEN inside OR round_ OR NOT cut_after AND cut_before THEN length(seq) ELSE re END AS r_end,
        CASE WHEN inside THEN length(seq) WHEN round_ THEN length(q) ELSE coalesce(qe - qs, 0) END AS len FROM (
        SELECT *, contains(q, seq) AS inside, contains(seq, q) AS round_, coalesce((rs = 0 OR qs = 0) AND qe < length(q) AND starts_with('{AFTER}', substr(seq, CAST(re AS BIGINT) + 1, 3)), false) AS cut_after,
        coalesce((re = length(seq) OR qe = length(q)) AND qs > 0 AND starts_with('{BEFORE}', reverse(substr(seq, greatest(CAST(rs AS BIGINT) - 2, 1), least(CAST(rs AS BIGINT), 3)))), false) AS cut_before FROM cand LEFT JOIN longest USING (query, read_id))""",
    "c": "SELECT seq, min(frag_id) AS id, count(*) AS copies FROM f GROUP BY seq",
    "pairs": "SELECT l.id AS l, l.seq AS ls, l.p, r.id AS r, r.seq AS rs, r.copies FROM (SELECT id, seq, p, substr(seq, p, 45) AS seed FROM (SELECT id, seq, unnest(range(1, length(seq) - 43)) AS p FROM c)) l JOIN (SELECT id, seq, copies, substr(seq, 1, 45) AS seed FROM c) r USING (seed) WHERE l.id <> r.id",
    "ol": "SELECT l AS left_id, r AS right_id, max(length(ls) - p + 1) AS ol, max(copies) AS copies FROM pairs WHERE p > 1 AND length(rs) > length(ls) - p + 1 AND substr(ls, p) = substr(rs, 1, length(ls) - p + 1) GROUP BY ALL",
    "br": "SELECT l AS id, p + m - 2 AS coord, substr(rs, m, 1) AS base, CAST(sum(copies) AS BIGINT) AS cnt FROM (SELECT *, list_min(list_filter(range(1, least(length(ls) - p + 1, length(rs)) + 1), lambda i: substr(ls, p + i - 1, 1) <> substr(rs, i, 1))) AS m FROM pairs) WHERE m IS NOT NULL GROUP BY ALL",
    "depth": """SELECT query, pos, round(sum(sum(share)) OVER (PARTITION BY query ORDER BY pos), 6) AS depth FROM (
        SELECT query, q_start AS pos, 1.0::DOUBLE / count(*) OVER (PARTITION BY read_id) AS share FROM hits UNION ALL SELECT query, q_end, -(1.0::DOUBLE / count(*) OVER (PARTITION BY read_id)) FROM hits) GROUP BY query, pos""",
    "perbase": "SELECT query, unnest(range(pos, nx)) AS pos, depth FROM (SELECT query, pos, depth, lead(pos) OVER (PARTITION BY query ORDER BY pos) AS nx FROM depth) WHERE nx IS NOT NULL",
}
NEEDS = {
    "f": "g", "reads": "f", "sfx": "reads", "bwt": "sfx", "qs": "q", "hits": "qs reads", "noisy": "reads", "near": "q noisy", "w": "q", "wnear": "w noisy", "cand": "w noisy wnear", "stretch": "cand", "longest": "stretch", "cls": "cand longest", "c": "f", "pairs": "c", "ol": "pairs", "br": "pairs", "depth": "hits", "perbase": "depth",
}


def steps(needs: str, query: str) -> str:
    """``query`` with the named steps that it needs, directly or not."""
    wanted, todo = set(), needs.split()
    while todo:
        if (name := todo.pop()) not in wanted:
            wanted.add(name)
            todo += NEEDS.get(name, "").split()
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in STEPS.items() if n in wanted) + f" {query}"


