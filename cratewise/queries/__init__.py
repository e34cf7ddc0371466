"""Named queries over the given tables, one or more per operator."""

import importlib

MODULES = ("q_sources", "q_relational", "q_scalar", "q_catalog", "q_taste", "q_playlist", "q_measure", "q_streaming")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"cratewise.queries.{name}")
