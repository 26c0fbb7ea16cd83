"""SQL of operators whose text is built: trees level by level, and checksums byte by byte."""

from __future__ import annotations

#: CRC-32 of the bytes of a string, by the table ``tab.t`` that :data:`CRC_TABLE` makes
CRC_TABLE = """tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::bigint)) AS t)"""


def crc32(text: str) -> str:
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: 16 * (instr('0123456789ABCDEF', hex({text})[2 * i - 1]) - 1) + instr('0123456789ABCDEF', hex({text})[2 * i]) - 1)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::varchar) || ':' || {column}::varchar END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, levels: int) -> list[str]:
    """Levels ``name_k(tree, p, d, c)`` above ``name_0``, and siblings ``name_sk(tree, p, lo, hi, c)`` of each."""
    out = []
    for k in range(levels):
        now = f"{name}{k}"
        out.append(
            f"{name}s{k} AS (SELECT a.tree, a.p, any_value(a.c) AS c, coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS lo,"
            f" coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS hi FROM {now} a JOIN {now} b ON a.tree = b.tree AND a.p // 16 = b.p // 16 GROUP BY a.tree, a.p)"
        )
        out.append(
            f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM (SELECT tree, p // 16 AS p,"
            f" CASE WHEN any_value(c) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM {now} GROUP BY tree, p // 16))"
        )
    return out


def _merkle(levels: int = 6, top_levels: int = 4) -> str:
    """Trees of up to 16 ** levels leaves, of up to 16 ** top_levels sources."""
    chosen = crc32("doc_id::varchar")
    ctes = [
        CRC_TABLE,
        f"""leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_leaf("text")} AS leaf,
            CASE WHEN {chosen} % 5 = 0 THEN {_leaf(LOWER)} END AS altered FROM documents, tab)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves)",
        "a0 AS (SELECT tree, place AS p, leaf AS d, count(*) OVER (PARTITION BY tree) AS c FROM placed)",
        *_tree("a", levels),
        f"b0 AS (SELECT 0 AS tree, tree AS p, d, count(*) OVER () AS c FROM a{levels})",
        *_tree("b", top_levels),
    ]
    steps = [(f"as{k}", f"s.tree = w.tree AND s.p = w.place // {16**k}") for k in range(levels)] + [(f"bs{k}", f"s.p = w.tree // {16**k}") for k in range(top_levels)]
    ctes.append("w0 AS (SELECT *, coalesce(altered, leaf) AS folded, '' AS proof FROM placed)")
    for i, (name, on) in enumerate(steps):
        ctes.append(
            f"w{i + 1} AS (SELECT w.doc_id, w.tree, w.place, w.leaf, CASE WHEN s.c = 1 THEN w.folded ELSE sha256(s.lo || w.folded || s.hi) END AS folded, w.proof || s.lo || s.hi AS proof FROM w{i} w JOIN {name} s ON {on})"
        )
    return f"""WITH {", ".join(ctes)}
        SELECT w.doc_id, w.leaf, a.d AS subroot, b.d AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = b.d AS verified
        FROM w{len(steps)} w JOIN a{levels} a ON a.tree = w.tree, b{top_levels} b"""


MERKLE = _merkle()

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
TARGET_RESAMPLING = f"""
    WITH {CRC_TABLE},
    d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
    dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
    bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w),
    b AS (SELECT w, {crc32("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
    s AS (SELECT b, sum(n)::double AS s FROM dw JOIN b USING (w) GROUP BY b),
    t AS (SELECT b, sum(n)::double AS t FROM bw JOIN b USING (w) GROUP BY b),
    all_s AS (SELECT coalesce(sum(s), 0.0) AS total FROM s), all_t AS (SELECT coalesce(sum(t), 0.0) AS total FROM t),
    g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s.total + 10000) / ((s + 1) * (all_t.total + 10000))))::bigint AS g FROM s LEFT JOIN t USING (b), all_s, all_t),
    weights AS (SELECT r, sum(n * g)::bigint AS weight FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY r),
    scored AS (SELECT doc_id, len(ws)::bigint AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint AS score
        FROM (SELECT *, list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('2024:' || coalesce(doc_id::varchar, ''))[i]) - 1), lambda a, x: 16 * a + x)::double AS h FROM d) LEFT JOIN weights USING (r)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count_if(n_features >= 20) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
