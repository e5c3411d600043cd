"""Queries of scopes as intervals: what a called name means, and calls by joins instead of a walk; and the same results in SQL."""

from __future__ import annotations

from ..functions.pyscopes import py_scopes
from ..operators import scopes
from ..sources.store import settled
from .corpus import corpus
from .corpus_queries import CALLS
from .registry import SQL, query
from .shape_queries import OF, shapes


@query("scope_calls", f"""{CALLS}
SELECT module_id, src, dst, CAST(line AS INTEGER) AS line FROM q""")
def scope_calls(spark, sf_dir):
    return scopes.scope_calls(settled(py_scopes(corpus(spark, sf_dir))))


@query("scope_shape_calls", SQL["shape_calls"])
def scope_shape_calls(spark, sf_dir):
    return scopes.scope_calls(settled(py_scopes(shapes(spark, sf_dir))))


#: A row for each name that a call calls or is handed (once a call), whom it counts for, and the innermost scope around that binds it.
@query("scope_meant", f"""{OF}
SELECT m AS module_id, replace(name, '#', k) AS name, line, replace(host, '#', k) AS host, scope_kind, replace(scope_name, '#', k) AS scope_name, CAST(scope_line AS INTEGER) AS scope_line
FROM c JOIN (VALUES
  (0, 'tool_#', 5, 'comp', 'function', 'comp', 4), (0, 'tool_#', 8, 'lam', 'lambda', NULL, 8), (0, 'tool_#', 11, 'plain', NULL, NULL, NULL),
  (0, 'y', 11, 'plain', 'function', 'plain', 10), (0, 'range', 11, 'plain', NULL, NULL, NULL),
  (1, 'helper_#', 8, 'Outer_#', 'class', 'Outer_#', 4), (1, 'sibling_#', 11, 'Outer_#', NULL, NULL, NULL), (1, 'helper_#', 11, 'Outer_#', 'class', 'Outer_#', 4),
  (2, 'go_#', 5, '<module>', NULL, NULL, NULL), (2, 'go_#', 7, '<module>', NULL, NULL, NULL), (2, 'go_#', 11, 'after', NULL, NULL, NULL),
  (4, 'base_#', 2, 'base_#', NULL, NULL, NULL), (4, 'base_#', 11, 'made_#', NULL, NULL, NULL), (4, 'wraps_#', 14, 'uses', NULL, NULL, NULL), (4, 'made_#', 14, 'uses', NULL, NULL, NULL),
  (5, 'start_#', 5, 'Holder_#', NULL, NULL, NULL), (5, 'start_#', 7, 'Holder_#', NULL, NULL, NULL), (5, 'start_#', 8, 'Holder_#', NULL, NULL, NULL),
  (5, 'start_#', 10, '<module>', NULL, NULL, NULL), (5, 'start_#', 11, '<module>', NULL, NULL, NULL), (5, 'Holder_#', 12, 'cond_#', NULL, NULL, NULL)
) x(kind, name, line, host, scope_kind, scope_name, scope_line) ON v = kind""")
def scope_meant(spark, sf_dir):
    return scopes.meant(settled(py_scopes(shapes(spark, sf_dir)))).drop("pos", "scope")
