"""DuckDB twin of the manifest query: one table for each level, the levels written out."""

#: Levels below a subroot and below the root: enough for 16 ** 6 rows of a source and 16 ** 4 sources.
IN_SOURCE, OVER_SOURCES = 6, 4


def _told(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BIT = "lambda c, i: xor(c >> 1, 3988292384 * (c & 1))"
_CRC = (f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)), "
        f"lambda crc, b: list_reduce([CAST(i AS BIGINT) for i in range(8)], {_BIT}, xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295)")


def _levels(name: str, levels: int) -> str:
    """Tables name1, name2, ... above name0 (g, p, h, n), and the siblings name_s0, ... of every node."""
    out = []
    for k in range(levels):
        a = f"{name}{k}"
        out.append(f"{name}_s{k} AS (SELECT a.g, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, "
                   f"coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r, a.n "
                   f"FROM {a} a JOIN {a} b ON a.g = b.g AND a.p // 16 = b.p // 16 GROUP BY a.g, a.p, a.n)")
        out.append(f"{name}{k + 1} AS (SELECT g, p // 16 AS p, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h, "
                   f"(n + 15) // 16 AS n FROM {a} GROUP BY g, p // 16, n)")
    return ",\n".join(out)


def _walk(name: str, levels: int, group: str, place: str) -> str:
    return "\n".join(f"JOIN {name}_s{k} {name}{k}_ ON {name}{k}_.g = {group} AND {name}{k}_.p = {place} // {16**k}" for k in range(levels))


def _fold(h: str) -> str:
    for name, levels in (("d", IN_SOURCE), ("s", OVER_SOURCES)):
        for k in range(levels):
            t = f"{name}{k}_"
            h = f"(SELECT CASE WHEN {t}.n > 1 THEN sha256({t}.l || v || {t}.r) ELSE v END FROM (SELECT {h} AS v))"
    return h


_PROOF = " || ".join(f"CASE WHEN {n}{k}_.n > 1 THEN {n}{k}_.l || {n}{k}_.r ELSE '' END"
                     for n, levels in (("d", IN_SOURCE), ("s", OVER_SOURCES)) for k in range(levels))

DIGEST = f"""
WITH leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOWER)} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaves),
d0 AS (SELECT g, p, leaf AS h, n FROM placed),
{_levels("d", IN_SOURCE)},
s0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS n, g AS of FROM d{IN_SOURCE}),
{_levels("s", OVER_SOURCES)},
folded AS (SELECT doc_id, leaf, s0.h AS subroot, top.h AS root, sha256({_PROOF}) AS proof_sha256, {_fold('coalesce(changed, leaf)')} AS folded_root
FROM placed JOIN s0 ON s0.of = placed.g CROSS JOIN s{OVER_SOURCES} top
{_walk("d", IN_SOURCE, "placed.g", "placed.p")}
{_walk("s", OVER_SOURCES, "''", "s0.p")})
SELECT *, folded_root = root AS verified FROM folded"""
