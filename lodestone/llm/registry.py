"""The queries of this subpackage."""

from __future__ import annotations

from . import balltree, codes, jaccard, licenses, mixing, packing, pfor, pii, quality, secrets, spelling, vptree, warc


def queries() -> dict:
    return {
        "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
        "op2_pii": pii.op2_pii,
        "op3_packing": packing.op3_packing,
        "op4_licenses": licenses.op4_licenses,
        "op5_token_files": pfor.op5_token_files,
        "op6_warc": warc.op6_warc,
        "op7_secrets": secrets.op7_secrets,
        "op8_mixing": mixing.op8_mixing,
        "op9_nearest": vptree.op9_nearest,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_near_vectors": codes.op11_near_vectors,
        "op12_centroid_clusters": balltree.op12_centroid_clusters,
        "op13_spelling": spelling.op13_spelling,
    }


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _near_vectors() -> str:
    dot = "list_inner_product(a.v, b.v)"
    return f"""
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND {_FINITE}),
        n AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS s FROM e WHERE list_inner_product(v, v) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE {dot} / (a.s * b.s) >= 0.98),
        r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a) USING (vec_id)"""


def _centroid_clusters() -> str:
    parts = [
        f"k AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        "c0 AS (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS c, x AS y FROM (SELECT *, sha256('1:' || vec_id) AS h FROM k ORDER BY h, vec_id LIMIT 16))",
    ]
    for i in range(4):
        parts.append(
            f"a{i} AS (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM "
            f"(SELECT vec_id, x, c, list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS d FROM k, c{i}) GROUP BY vec_id, x)"
        )
        parts.append(f"m{i} AS (SELECT c, list(z ORDER BY i) AS z FROM (SELECT c, i, floor(sum(x[i]) / count(*)) AS z FROM a{i}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c)")
        parts.append(f"c{i + 1} AS (SELECT c, coalesce(z, y) AS y FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(list_transform(y, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM a3 JOIN c3 USING (c)"""


def _spelling() -> str:
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    return f"""
        WITH RECURSIVE t(i, c, s) AS (SELECT i, i, 0 FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM t WHERE s < 8),
        tab AS (SELECT list(c ORDER BY i) AS tb FROM t WHERE s = 8),
        o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        q AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM o WHERE length(run) >= 5 GROUP BY doc_id, run),
        h AS (SELECT run, n, xor(list_reduce(list_transform(range(1, length(hx) // 2 + 1), lambda i: ('0x' || substr(hx, 2 * i - 1, 2))::BIGINT),
            lambda acc, b: xor(acc >> 8, tb[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM q, tab),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
        p AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y USING (cut, i) WHERE x.word <> y.word
            UNION SELECT d.word, w.word FROM d JOIN w ON d.cut = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.cut = w.word),
        b AS (SELECT a AS word, count(*) AS n_near, arg_min(p.b, (-w.n, p.b)) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = p.b GROUP BY a),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
        g(word, root) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL),
        e AS (SELECT g.word, g.root FROM g JOIN f ON f.word = g.root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""


def oracle_sql() -> dict[str, str]:
    """The others are not SQL (see README); tests hold them against brute force."""
    return {
        "op11_near_vectors": _near_vectors(),
        "op12_centroid_clusters": _centroid_clusters(),
        "op13_spelling": _spelling(),
        "op6_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
            k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS keep FROM p)
            SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
                CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN page_id < keep THEN keep END AS refers_to
            FROM k"""
    }
