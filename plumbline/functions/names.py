"""Names the running interpreter knows, and what is never scanned."""

from __future__ import annotations

import builtins
import sys

#: Of the interpreter that runs the engine, as in PYTHON; pass other sets where a scan must not depend on it.
PYTHON = ".".join(map(str, sys.version_info[:2]))
STDLIB = tuple(sorted(sys.stdlib_module_names))
BUILTINS = tuple(sorted(dir(builtins)))
#: Directory names that are pruned at any depth.
PRUNED = (".git", ".dagr", "__pycache__", ".venv", "venv", "node_modules", "dist", "build")
#: Path components that mark code as not production code.
NOISE = ("tests", "fixtures")
