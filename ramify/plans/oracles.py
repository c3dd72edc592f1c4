"""Comparison SQL: common table expressions shared by the oracle queries."""

from __future__ import annotations

from ramify.plans.views import VIEW_SQL

# geo with coordinates: children side by side on the diameter of their parent.
GEO_LINE = """
geo_o AS (
  SELECT id, parent_id, name, row_number() OVER (PARTITION BY parent_id ORDER BY name, id) AS i,
         count(*) OVER (PARTITION BY parent_id) AS n FROM geo
), geo_line AS (
  SELECT id, parent_id, name, 0 AS level, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(2000 AS DOUBLE) AS r
  FROM geo_o WHERE parent_id IS NULL
  UNION ALL
  SELECT o.id, o.parent_id, o.name, t.level + 1, t.x + t.r * (2 * o.i - 1 - o.n) / o.n, t.y, t.r / o.n
  FROM geo_o o JOIN geo_line t ON o.parent_id = t.id
)"""


def view_ctes(*names: str) -> str:
    needed = []
    for name in names:
        if name in ("geo_line", "geo_ph") and "geo" not in needed:
            needed.append("geo")
        if name not in needed:
            needed.append(name)
    return ",".join(GEO_LINE if n == "geo_line" else f"\n{n} AS ({VIEW_SQL[n]})" for n in needed)


def label_ctes(view: str) -> str:
    """``lab``: the labelled table of ``view`` computed by plain recursion."""
    return f"""
walk AS (
  SELECT id, parent_id, name, 0 AS level, [id] AS ids, [name] AS names, [{{'n': name, 'i': id}}] AS k
  FROM {view} WHERE parent_id IS NULL
  UNION ALL
  SELECT c.id, c.parent_id, c.name, w.level + 1, list_append(w.ids, c.id), list_append(w.names, c.name),
         list_append(w.k, {{'n': c.name, 'i': c.id}})
  FROM {view} c JOIN walk w ON c.parent_id = w.id
), kids AS (
  SELECT parent_id AS id, count(*) AS child_count FROM {view} WHERE parent_id IS NOT NULL GROUP BY parent_id
), flagged AS (
  SELECT w.*, coalesce(kids.child_count, 0) AS child_count FROM walk w LEFT JOIN kids ON kids.id = w.id
), below AS (
  SELECT a AS id, count(*) AS subtree_size, CAST(sum(CASE WHEN child_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaf_count
  FROM (SELECT unnest(ids) AS a, child_count FROM flagged) GROUP BY a
), numbered AS (
  SELECT f.*, row_number() OVER (ORDER BY k) AS pre,
    CAST(coalesce(sum(CASE WHEN child_count = 0 THEN 1 ELSE 0 END)
      OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS leaf_lo
  FROM flagged f
), lab AS (
  SELECT n.*, b.subtree_size, b.leaf_count, n.pre + b.subtree_size - 1 AS pre_end
  FROM numbered n JOIN below b ON b.id = n.id
)"""


def labelled_sql(view: str, query: str) -> str:
    return f"WITH RECURSIVE {view_ctes(view)},{label_ctes(view)}\n{query}"


def line_sql(query: str, labels: bool = False) -> str:
    """Over geo_line, with labels of geo as ``lab`` on request."""
    more = "," + label_ctes("geo") if labels else ""
    return f"WITH RECURSIVE {view_ctes('geo_line')}{more}\n{query}"


def view_sql(view: str, query: str) -> str:
    return f"WITH RECURSIVE {view_ctes(view)}\n{query}"


# --- expressions -----------------------------------------------------------------


def uri(expr: str) -> str:
    """encodeURIComponent: url_encode leaves - _ . ~ alone and escapes ! ' ( ) *."""
    out = f"url_encode({expr})"
    for enc, plain in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{enc}', '{plain}')"
    return out


def fuzzy_fold(name: str, q: str) -> str:
    """Struct (hit, run, best) of the greedy match of ``q`` in ``name``."""
    chars = f"list_transform(string_split(lower({name}), ''), lambda c: {{'c': c, 'hit': 0, 'run': 0, 'best': 0}})"
    start = f"list_prepend({{'c': '', 'hit': 0, 'run': 0, 'best': 0}}, {chars})"
    match = f"(a.hit < length({q}) AND s.c = substr({q}, a.hit + 1, 1))"
    done = f"(a.hit >= length({q}))"
    return (
        f"list_reduce({start}, lambda a, s: {{'c': s.c, "
        f"'hit': CASE WHEN {match} THEN a.hit + 1 ELSE a.hit END, "
        f"'run': CASE WHEN {done} THEN a.run WHEN {match} THEN a.run + 1 ELSE 0 END, "
        f"'best': CASE WHEN {match} THEN greatest(a.best, a.run + 1) ELSE a.best END}})"
    )


def score_ctes(terms: list[str] | str) -> str:
    """``scored``: every match of every term (a list, or SQL for ``query``) over ``lab`` with base and bonus."""
    values = terms if isinstance(terms, str) else "VALUES " + ", ".join(f"('{t}')" for t in terms if t.strip())
    fold = fuzzy_fold("l.name", "lower(q.query)")
    return f"""
terms(query) AS ({values}),
folded AS (
  SELECT q.query, l.id, l.name, l.level, l.child_count, l.pre_end, l.names, lower(q.query) AS ql, {fold} AS f
  FROM lab l, terms q
), based AS (
  SELECT *, CASE
      WHEN lower(name) = ql THEN 1000.0::DOUBLE
      WHEN starts_with(lower(name), ql) THEN 800.0::DOUBLE + greatest(0, 100 - length(name))
      WHEN contains(lower(name), ql) THEN 400.0::DOUBLE + greatest(0, 50 - (strpos(lower(name), ql) - 1))
        + greatest(0.0::DOUBLE, 50.0::DOUBLE - length(name) / 2.0::DOUBLE)
      ELSE 200.0::DOUBLE + f.best * 10 - greatest(0, length(name) - 2 * length(ql)) END
    + CASE WHEN child_count = 0 THEN 30 WHEN child_count < 10 THEN 20 ELSE 0 END
    + CASE WHEN level BETWEEN 2 AND 8 THEN 10 ELSE 0 END AS base
  FROM folded WHERE f.hit = length(ql)
), scored AS (
  SELECT *, CASE WHEN contains(lower(array_to_string(names, ' / ')), ql) THEN 100
      + CASE WHEN contains(lower(array_to_string(names[1:len(names) - 1], ' / ')), ql) THEN 50 ELSE 0 END
    ELSE 0 END AS bonus
  FROM based WHERE base > 0
)"""
