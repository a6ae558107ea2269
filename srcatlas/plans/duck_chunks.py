"""The separator-aware chunkers as DuckDB statements.

The text is never split row by row: each level of separators is a set of
offsets, runs of short pieces are lists of offsets, and one recursive query
walks every run from window to window.
"""

from __future__ import annotations

from .. import constants as K
from . import duck as D


def _buffers(size: int) -> list[tuple[str, str]]:
    """Line-aligned stretches of at least twice ``size`` as units of text."""
    return [
        ("line_ends", """SELECT doc_id, content, list_append(list_transform(range(1, len(parts)),
    lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p) + 1))), length(content)) AS ends
  FROM (SELECT doc_id, content, string_split(content, chr(10)) AS parts FROM docs)"""),
        ("buffers", f"""SELECT doc_id, content, ends, CAST(0 AS BIGINT) AS s,
    CAST(coalesce(list_min(list_filter(ends, lambda e: e >= {2 * size})), length(content)) AS BIGINT) AS e FROM line_ends
  UNION ALL
  SELECT doc_id, content, ends, e, CAST(coalesce(list_min(list_filter(ends, lambda x: x >= e + {2 * size})), length(content)) AS BIGINT)
  FROM buffers WHERE e < length(content)"""),
        ("units0", "SELECT doc_id, s, substring(content, s + 1, e - s) AS t FROM buffers"),
    ]


def _level(k: int, sep: str, size: int) -> list[tuple[str, str]]:
    """Units cut at one separator: short pieces make runs, long ones and units
    without the separator are the next level's units."""
    if sep == "":
        return [(f"runs{k}", f"SELECT doc_id, list_transform(range(0, length(t) + 1), lambda i: s + i) AS cuts FROM units{k} WHERE t <> ''")]
    q = D.q(sep)
    return [
        (f"pieces{k}", f"""SELECT doc_id, s, t, a, n, sum(CASE WHEN n >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s ORDER BY a) AS longs
  FROM (SELECT doc_id, s, t, n, s + CAST(coalesce(sum(n) OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
        FROM (SELECT doc_id, s, t, i, length(part) + CASE WHEN i > 1 THEN {len(sep)} ELSE 0 END AS n
              FROM (SELECT doc_id, s, t, unnest(string_split(t, {q})) AS part, generate_subscripts(string_split(t, {q}), 1) AS i
                    FROM units{k} WHERE contains(t, {q}))))
  WHERE n > 0"""),
        (f"runs{k}", f"SELECT doc_id, list_append(list(a ORDER BY a), max(a + n)) AS cuts FROM pieces{k} WHERE n < {size} GROUP BY doc_id, s, longs"),
        (f"units{k + 1}", f"""SELECT doc_id, s, t FROM units{k} WHERE NOT contains(t, {q})
  UNION ALL SELECT doc_id, a, substring(t, a - s + 1, n) FROM pieces{k} WHERE n >= {size}"""),
    ]


def chunks_sql(buffered: bool = False, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
               separators: list[str] | None = None) -> list[tuple[str, str]]:
    """CTEs from ``docs`` to ``split_chunks`` (doc_id, repo_id, chunk_num,
    content)."""
    seps = K.RECURSIVE_SEPARATORS if separators is None else separators
    ctes = _buffers(size) if buffered else [("units0", "SELECT doc_id, CAST(0 AS BIGINT) AS s, content AS t FROM docs")]
    for k, sep in enumerate(seps):
        ctes += _level(k, sep, size)
    every = " UNION ALL ".join(f"SELECT * FROM runs{k}" for k in range(len(seps)))
    over = f"list_min(list_filter(range(f + 1, len(cuts) + 1), lambda j: cuts[j] - cuts[f] > {size}))"
    again = (f"list_min(list_filter(range(f, over), lambda j: cuts[over - 1] - cuts[j] <= {overlap} "
             f"AND (cuts[over] - cuts[j] <= {size} OR j >= over - 1)))")
    return ctes + [
        ("windows", f"""SELECT doc_id, cuts, CAST(1 AS BIGINT) AS f, over FROM (SELECT doc_id, cuts, CAST(1 AS BIGINT) AS f, {over} AS over FROM ({every}))
  UNION ALL
  SELECT doc_id, cuts, f, {over} AS over FROM (SELECT doc_id, cuts, {again} AS f FROM windows WHERE over IS NOT NULL)"""),
        ("split_chunks", f"""SELECT doc_id, repo_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_num, content
  FROM (SELECT w.doc_id, d.repo_id, w.a, {D.strip('substring(d.content, w.a + 1, w.b - w.a)')} AS content
        FROM (SELECT doc_id, cuts[f] AS a, cuts[coalesce(over - 1, len(cuts))] AS b FROM windows) w JOIN docs d USING (doc_id))
  WHERE content <> ''"""),
    ]


def ctes(buffered: bool = False) -> str:
    """From the files to ``docs`` and ``split_chunks``, ready for a SELECT."""
    with_docs = D.with_ctes(["fx_files"], [("docs", D.docs_select("fx_files")), *chunks_sql(buffered)])
    return with_docs.replace("WITH", "WITH RECURSIVE", 1)


def statement(buffered: bool = False) -> str:
    repo = "" if buffered else "repo_id, "
    return ctes(buffered) + f"""
SELECT doc_id || ':' || md5(content) AS chunk_id, doc_id, {repo}chunk_num, CAST(length(content) AS BIGINT) AS size FROM split_chunks"""
