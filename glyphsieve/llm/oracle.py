"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

from .license_texts import TEMPLATES

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[^a-z0-9]+'), lambda w: w <> '')"
_QUOTED = ", ".join("({}, '{}', '{}', '{}')".format(i, name, kind, text.replace("'", "''")) for i, (name, kind, text) in enumerate(TEMPLATES))

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": r"""
        WITH c AS (
            SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text) AS before FROM c),
        p AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM before THEN length('<|im_sep|>')
                             ELSE length('<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1 + length('<|im_end|>') + 1 END
                        + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM p GROUP BY conv_id, own""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, html, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM q""",
    # exact: at the sizes that SQL is held against, the forest is a single leaf and the search sees every row
    "op6_nearest_neighbours": """
        WITH v AS (SELECT DISTINCT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
        k AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM w),
        twice AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM k SEMI JOIN twice USING (k)),
        p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM p ANTI JOIN gone USING (r, p) GROUP BY r),
        n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)""",
    "op9_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
        b AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
        i AS (SELECT *, len(ws) AS n, least(5, len(ws)) AS k, len(ws) - least(5, len(ws)) + 1 AS m FROM b WHERE len(ws) > 0),
        ig AS (SELECT b, n, k, m, g, count(*) AS c FROM (SELECT b, n, k, m, unnest(list_transform(range(1, m + 1), lambda x: array_to_string(ws[x:x + k - 1], ' '))) AS g FROM i) GROUP BY ALL),
        dp AS (SELECT r, len(ws) AS size, k, unnest(range(0, len(ws) - k + 1)) AS pos, ws FROM d, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k),
        dg AS (SELECT r, size, k, pos, array_to_string(ws[pos + 1:pos + k], ' ') AS g FROM dp),
        hit AS (SELECT * FROM dg JOIN ig USING (k, g)),
        win AS (SELECT r, b, g, n AS size, m + m AS weight, c, unnest(range(greatest(0, pos - m + 1), least(pos, size - n) + 1)) AS s FROM hit WHERE size >= n
                UNION ALL SELECT r, b, g, size, m + size - k + 1, c, 0 FROM hit WHERE size < n),
        g AS (SELECT r, b, s, size, weight, least(count(*), c) AS shared FROM win GROUP BY r, b, s, size, weight, g, c),
        v AS (SELECT r, b, s, size, 2 * sum(shared)::DOUBLE / weight AS similarity FROM g GROUP BY r, b, s, size, weight),
        best AS (SELECT *, row_number() OVER (PARTITION BY r, b ORDER BY similarity DESC, s) AS o FROM v WHERE similarity >= 0.8 - 1e-12)
        SELECT doc_id, item_id, similarity, s::BIGINT AS first_word, size::BIGINT AS n_words FROM best JOIN d USING (r) JOIN b USING (b) WHERE o = 1""",
    "op7_license_scan": rf"""
        WITH tpl(number, license, kind, text) AS (VALUES {_QUOTED}),
        t AS (SELECT number, license, kind, {_WORDS} AS ws FROM tpl),
        d AS (SELECT row_number() OVER () AS rid, doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, text IS NOT NULL AS present, {_WORDS} AS ws FROM documents),
        total AS (SELECT count(*) AS docs FROM d WHERE present),
        tw AS (SELECT number, word, count(*) AS c FROM (SELECT number, unnest(ws) AS word FROM t) GROUP BY ALL),
        df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT rid, unnest(ws) AS word FROM d) GROUP BY word),
        idf AS (SELECT word, ln((1 + docs) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word), total),
        raw AS (SELECT number, word, c, idf, c * idf AS x FROM tw JOIN idf USING (word)),
        unit AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY number)) AS weight FROM raw),
        picked AS (SELECT *, sum(weight * weight) OVER (PARTITION BY number ORDER BY idf DESC, c, word ROWS UNBOUNDED PRECEDING) - weight * weight AS before FROM unit),
        tp AS (SELECT number, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM t),
        anchor AS (SELECT number, n, word, place FROM tp JOIN picked USING (number, word) WHERE 1 - before >= (0.7 - 1e-9) * (0.7 - 1e-9)),
        dp AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d),
        cand AS (SELECT DISTINCT rid, number, n, pos - place AS start FROM dp JOIN anchor USING (word)),
        win AS (SELECT rid, number, n, start, unnest(ws[greatest(0, start) + 1:least(len(ws), start + n)]) AS word FROM cand JOIN d USING (rid)),
        tf AS (SELECT rid, number, n, start, word, count(*) AS c FROM win GROUP BY ALL),
        x AS (SELECT rid, number, n, start, c * coalesce(idf, ln(1 + docs) + 1) AS x, coalesce(weight, 0) AS weight FROM tf LEFT JOIN idf USING (word) LEFT JOIN (SELECT number, word, weight FROM unit) USING (number, word), total),
        scored AS (SELECT rid, number, n, start, least(round(sum(x * weight) / sqrt(sum(x * x)), 6), 1.0) AS score FROM x GROUP BY ALL),
        matched AS (SELECT rid, license, kind, score, greatest(0, start) AS first_word, start + n AS stop FROM scored JOIN t USING (number) WHERE score >= 0.7),
        own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, license, first_word) AS o FROM matched) WHERE o = 1),
        inside AS (SELECT DISTINCT rid, len(ws) AS size, unnest(range(first_word, least(stop, len(ws)))) AS p FROM matched JOIN d USING (rid) WHERE kind = 'text'),
        mainly AS (SELECT rid FROM inside GROUP BY rid, size HAVING count(*) >= 0.5 * size),
        grants AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, score, path AS origin FROM own JOIN d USING (rid)
                   WHERE rid IN (SELECT rid FROM mainly) OR regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$')),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, origin, license) AS o FROM grants) WHERE o = 1),
        near AS (SELECT rid, arg_max(struct_pack(license, score, origin), length(dir)) AS g FROM d JOIN best ON dir = '' OR starts_with(path, dir || '/') GROUP BY rid)
        SELECT d.doc_id, d.path, coalesce(own.license, g.license) AS license, coalesce(own.score, g.score) AS score, own.first_word::BIGINT AS first_word,
               CASE WHEN own.rid IS NOT NULL THEN 'header' WHEN g IS NOT NULL THEN 'inherited' END AS via, CASE WHEN own.rid IS NULL THEN g.origin END AS origin
        FROM d LEFT JOIN own USING (rid) LEFT JOIN near USING (rid)""",
}


def _framed(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR END"


def _merkle_sql(levels: int = 5, tops: int = 3) -> str:
    """Trees of up to 16 ** levels leaves under 16 ** tops groups; DuckDB has no CRC-32, so its bits are worked out."""
    digits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
    leaf = lambda text: " || ".join(map(_framed, ("doc_id", "source", "lang", "n_chars", text)))
    steps = [
        f"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS k, sha256({leaf("text")}) AS leaf,
            CASE WHEN {crc} % 5 = 0 THEN sha256({leaf(f"translate(text, {_LOWER})")}) END AS changed FROM documents)""",
        "t0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY k) AS n FROM d)",
        "f0 AS (SELECT r, k, place, n, coalesce(changed, leaf) AS h, '' AS proof FROM t0)",
    ]

    def tree(t: str, f: str, height: int) -> None:
        for i in range(height):
            steps.append(f"{t}r{i} AS (SELECT k, place // 16 AS up, (max(n) + 15) // 16 AS n, list(h ORDER BY place) AS kids FROM {t}{i} WHERE n > 1 GROUP BY ALL)")
            steps.append(f"{t}{i + 1} AS (SELECT k, up AS place, n, sha256(array_to_string(kids, '')) AS h FROM {t}r{i})")
            left, right = "array_to_string(kids[1:(place % 16)], '')", "array_to_string(kids[(place % 16) + 2:], '')"
            steps.append(
                f"""{f}{i + 1} AS (SELECT r, k, place // 16 AS place, (f.n + 15) // 16 AS n, CASE WHEN f.n > 1 THEN sha256({left} || h || {right}) ELSE h END AS h,
                CASE WHEN f.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof FROM {f}{i} AS f LEFT JOIN {t}r{i} AS x USING (k) WHERE f.n = 1 OR x.up = f.place // 16)"""
            )

    tree("t", "f", levels)
    every = lambda t, n: " UNION ALL ".join(f"SELECT k, h FROM {t}{i} WHERE n = 1" for i in range(n + 1))
    steps += [
        f"subs AS ({every('t', levels)})",
        "s0 AS (SELECT '' AS k, k AS grp, h, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM subs)",
        f"g0 AS (SELECT r, '' AS k, s0.place, s0.n, f.h, proof FROM f{levels} AS f JOIN s0 ON f.k = s0.grp)",
    ]
    tree("s", "g", tops)
    return f"""WITH {", ".join(steps)}, root AS ({every("s", tops)})
        SELECT d.doc_id, d.leaf, subs.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, g.h AS folded_root, g.h = root.h AS verified
        FROM d JOIN subs USING (k) JOIN g{tops} AS g USING (r), root"""


ORACLE_SQL["op13_merkle_manifest"] = _merkle_sql()


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    near = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assign = f"SELECT r, vec_id, v.q, cluster, {near} AS distance FROM v, c{{}} AS c QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1"
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS cluster, q FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({assign.format(i)})")
        steps.append(f"s{i} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}) GROUP BY ALL)")
        steps.append(f"m{i} AS (SELECT cluster, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{i} GROUP BY ALL)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.q, c.q) AS q FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster))")
    return f"""WITH {", ".join(steps)}, a AS ({assign.format(rounds)})
        SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a JOIN c{rounds} AS c USING (cluster)"""


ORACLE_SQL["op11_centroid_clustering"] = _clusters_sql()
