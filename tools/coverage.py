"""Write COVERAGE.md from the registered queries.

usage: python tools/coverage.py
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

HEAD = """# COVERAGE

Generated by `tools/coverage.py` from the query registry: every registered query of the meter part, the SURVEY §2
operator ids it runs, and its check. Queries run the operators' default modes; L1-L3 are run through `plans/pipelines.py`.

| query | SURVEY §2 ids | check |
| --- | --- | --- |
"""


def main() -> None:
    from kwhlens.plans import queries  # noqa: F401
    from kwhlens.plans.registry import REGISTRY

    rows = [f"| `{name}` | {q.ops} | {'SQL' if q.sql else 'rows only'} |" for name, q in REGISTRY.items()]
    with open(os.path.join(ROOT, "COVERAGE.md"), "w", encoding="utf-8") as f:
        f.write(HEAD + "\n".join(rows) + "\n")


if __name__ == "__main__":
    main()
