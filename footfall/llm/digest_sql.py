"""SQL for the operators that rest on digests: importance resampling and the Merkle manifest."""

from __future__ import annotations

from footfall.llm import resampling

#: One row: the table of the CRC-32 by its bitwise rule.
CRC_TABLE = (
    "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
)


def crc32_of(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, with ``crc`` in the FROM clause."""
    bytes_ = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    register = f"list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    return f"xor({register}, 4294967295)"


def resampling_sql() -> str:
    """Weights, scores and ranks by word counts per bucket and a window over all documents."""
    upper = "".join(map(chr, range(65, 91)))
    lower = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    words = f"unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
    n = resampling.BUCKETS
    return (
        f"WITH {CRC_TABLE}, "
        "docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), "
        f"source AS (SELECT r, {words} AS w FROM docs), "
        f"target AS (SELECT {words} AS w FROM benchmark), "
        f"known AS (SELECT w, {crc32_of('w')} % {n} AS b FROM (SELECT w FROM source UNION SELECT w FROM target), crc), "
        "s AS (SELECT b, count(*) AS n FROM source JOIN known USING (w) GROUP BY b), "
        "t AS (SELECT b, count(*) AS n FROM target JOIN known USING (w) GROUP BY b), "
        "sums AS (SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM s) AS all_s, (SELECT coalesce(sum(n), 0)::BIGINT FROM t) AS all_t), "
        f"gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::BIGINT * (all_s + {n}) / ((s.n + 1) * (all_t + {n}))))::BIGINT AS g "
        "FROM s LEFT JOIN t ON s.b = t.b, sums), "
        "mean AS (SELECT r, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS w FROM source JOIN known USING (w) JOIN gain USING (b) GROUP BY r), "
        "drawn AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight, "
        f"coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score "
        "FROM docs LEFT JOIN mean USING (r)), "
        f"ranked AS (SELECT *, n_features >= {resampling.LEAST_WORDS} AS able, "
        f"row_number() OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS i, "
        f"count(*) OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS}) AS able_n FROM drawn) "
        f"SELECT doc_id, n_features, weight, score, CASE WHEN able AND i <= {resampling.PERCENT} * able_n // 100 THEN i END AS rank FROM ranked"
    )


def manifest_sql() -> str:
    """Trees level by level, and every document's claim folded upwards through its siblings."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(field(v) for v in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"

    def tree(name: str, leaves: str) -> str:
        """All levels over (tree, pos, n, h), n being the nodes of the level."""
        return (
            f"{name} AS (SELECT tree, 0 AS level, pos, n, h FROM {leaves} UNION ALL "
            f"SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 "
            "GROUP BY tree, level, pos // 2, n)"
        )

    def fold(name: str, start: str, nodes: str) -> str:
        """The claim of each leaf and the text of its siblings, one level after another."""
        joined = f"FROM {name} f JOIN {nodes} own ON own.tree IS NOT DISTINCT FROM f.tree AND own.level = f.level AND own.pos = f.pos AND own.n > 1 " \
            f"LEFT JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1)"
        return (
            f"{name} AS (SELECT * FROM {start} UNION ALL SELECT f.r, f.tree, f.level + 1, f.pos // 2, "
            "sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos & 1 = 1 THEN s.h || f.h ELSE f.h || s.h END), "
            f"f.proof || coalesce(s.h, '') {joined})"
        )

    def ends(name: str, nodes: str) -> str:
        return f"SELECT f.* FROM {name} f JOIN {nodes} t ON t.tree IS NOT DISTINCT FROM f.tree AND t.level = f.level AND t.pos = f.pos AND t.n = 1"

    return (
        f"WITH RECURSIVE {CRC_TABLE}, "
        f"hashed AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, "
        f"CASE WHEN {crc32_of('doc_id::VARCHAR')} % 7 = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS claim FROM documents, crc), "
        "leaves AS (SELECT row_number() OVER () AS r, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, "
        "count(*) OVER (PARTITION BY lang) AS n, leaf AS h, * FROM hashed), "
        f"{tree('nodes', 'leaves')}, "
        "subroots AS (SELECT tree AS lang, h AS subroot, 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM nodes WHERE n = 1), "
        f"{tree('top', 'subroots')}, "
        f"low_start AS (SELECT r, tree, 0 AS level, pos, claim AS h, '' AS proof FROM leaves), {fold('low', 'low_start', 'nodes')}, "
        f"low_end AS ({ends('low', 'nodes')}), "
        "high_start AS (SELECT e.r, 0 AS tree, 0 AS level, s.pos, e.h, e.proof FROM low_end e JOIN subroots s ON s.lang IS NOT DISTINCT FROM e.tree), "
        f"{fold('high', 'high_start', 'top')}, high_end AS ({ends('high', 'top')}) "
        "SELECT doc_id, leaf, subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified "
        "FROM leaves l JOIN high_end e USING (r) JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang, (SELECT h FROM top WHERE n = 1) t"
    )
