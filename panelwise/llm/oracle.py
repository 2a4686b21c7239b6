"""The queries as SQL, where SQL expresses them."""


def _centroids_sql(rounds: int) -> str:
    """Every round as one more pair of named tables."""
    parts = ["""
        WITH kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        centroids0 AS (
            SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c
            FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16
        )"""]
    for i in range(rounds + 1):
        parts.append(f"""
        measured{i} AS (
            SELECT vec_id, v, cluster,
                   list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
            FROM kept CROSS JOIN centroids{i}
        ),
        assigned{i} AS (
            SELECT vec_id, arg_min(v, d) AS v, min(struct_pack(d := d, cluster := cluster)).d AS distance,
                   min(struct_pack(d := d, cluster := cluster)).cluster AS cluster
            FROM measured{i} GROUP BY vec_id
        )""")
        if i < rounds:
            parts.append(f"""
        means{i} AS (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c
            FROM (SELECT cluster, k, sum(x) AS s, count(*) AS n
                  FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS k FROM assigned{i}) GROUP BY cluster, k)
            GROUP BY cluster
        ),
        centroids{i + 1} AS (
            SELECT cluster, coalesce(m.c, o.c) AS c FROM centroids{i} o LEFT JOIN means{i} m USING (cluster)
        )""")
    return ",".join(parts) + f"""
        SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance,
               CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM assigned{rounds} JOIN centroids{rounds} USING (cluster)
    """


ORACLE = {
    "op5_topk_search": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 20 = 0
        ),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_decontamination": """
        WITH cut_docs AS (
            SELECT doc_id, list_filter(
                regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
            FROM documents
        ),
        cut_items AS (
            SELECT item_id, list_filter(
                regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
            FROM benchmark
        ),
        windows AS (
            SELECT DISTINCT item_id, size, array_to_string(list_slice(words, spot, spot + size - 1), ' ') AS phrase
            FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS spot
                  FROM (SELECT *, least(10, len(words)) AS size FROM cut_items WHERE len(words) > 0))
        ),
        places AS (
            SELECT doc_id, size, spot, array_to_string(list_slice(words, spot, spot + size - 1), ' ') AS phrase
            FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS spot
                  FROM cut_docs CROSS JOIN (SELECT DISTINCT size FROM windows))
        ),
        found AS (SELECT doc_id, item_id, size, spot FROM places JOIN windows USING (size, phrase)),
        hits AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit
            FROM (SELECT doc_id, unnest(range(spot, spot + size)) AS word FROM found) GROUP BY doc_id
        ),
        of_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM cut_docs LEFT JOIN hits USING (doc_id) LEFT JOIN of_items USING (doc_id)
    """,
    "op12_centroids": _centroids_sql(rounds=3),
    "op13_spelling": """
        WITH RECURSIVE bits AS (
            SELECT range AS i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
                       THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, range) AS c
            FROM range(256)
        ),
        crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits),
        runs AS (
            SELECT doc_id, run, count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(
                      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
                  FROM documents)
            GROUP BY ALL
        ),
        hexed AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
        hashed AS (
            SELECT run, times, xor(list_reduce(
                list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
            FROM hexed CROSS JOIN crc_table
        ),
        words AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n
            FROM (SELECT times, CASE WHEN h % 97 <> 0 THEN run
                         ELSE substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) END AS word FROM hashed)
            WHERE len(word) >= 5 GROUP BY word HAVING sum(times) >= 3
        ),
        cut AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)
        ),
        near AS (
            SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
        ),
        best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
            FROM near GROUP BY word
        ),
        forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
                   CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
            FROM words LEFT JOIN best USING (word)
        ),
        chain AS (
            SELECT word, word AS root FROM forms
            UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
        )
        SELECT word, form, root, f.n, n_near, form_n
        FROM forms f JOIN (SELECT c.word, c.root FROM chain c JOIN forms e ON e.word = c.root WHERE e.form IS NULL) USING (word)
    """,
}
