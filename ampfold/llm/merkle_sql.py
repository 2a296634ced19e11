"""DuckDB twin of the Merkle query."""

from ampfold.llm.merkle import LEAF, PARAGRAPH, SECTION


def _tree(text: str) -> str:
    leaf = "sha256('0' || l) || ':' || length(l)"
    return (
        f"list_transform(regexp_extract_all({text}, '{SECTION}'), lambda s: "
        f"list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: "
        f"list_transform(regexp_extract_all(p, '{LEAF}'), lambda l: {leaf})))"
    ).replace(r"\n", "\\n")


def _node(children: str) -> str:
    return f"sha256('1' || array_to_string({children}, ''))"


def _weight(leaves: str) -> str:
    return f"coalesce(list_sum(list_transform({leaves}, lambda w: CAST(split_part(w, ':', 2) AS BIGINT))), 0)"


def _likeness(a: str, b: str) -> str:
    return (f"CASE WHEN {a}_root = {b}_root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {_weight(f'list_intersect({a}_leaves, {b}_leaves)')} "
            f"/ greatest({_weight(f'{a}_leaves')} + {_weight(f'{b}_leaves')}, 1) END")


_NAMES = {"own": "t", "edited": "e", "nxt": "x"}

DIGEST = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS x FROM d WINDOW w AS (ORDER BY doc_id DESC)),
h AS (SELECT *, left(t, length(t) - length(t) // 2) || left(x, length(t) // 2) AS e FROM n),
trees AS (SELECT doc_id, t, e, {", ".join(f"{_tree(c)} AS {p}_tree" for p, c in _NAMES.items())} FROM h),
paragraphs AS (SELECT *, {", ".join(f"list_transform({p}_tree, lambda s: list_transform(s, lambda q: {_node('q')})) AS {p}_par" for p in _NAMES)}
  FROM trees),
roots AS (SELECT doc_id, t, e, own_par, edited_par,
  {", ".join(f"list_distinct(flatten(flatten({p}_tree))) AS {p}_leaves" for p in _NAMES)},
  {", ".join(f"{_node(f'list_transform({p}_par, lambda s: {_node(chr(115))})')} AS {p}_root" for p in _NAMES)} FROM paragraphs)
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, own_root AS fingerprint, edited_root AS edited_fingerprint,
  {_likeness("own", "edited")} AS near_edited, {_likeness("own", "nxt")} AS near_next,
  CAST(len(list_filter(list_distinct(flatten(edited_par)), lambda q: NOT list_contains(flatten(own_par), q))) AS BIGINT) AS edited_paragraphs
FROM roots"""
