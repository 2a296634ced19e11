"""Operators for preparing training text at scale, each with one registered query.

``QUERIES`` and ``ORACLE`` are imported on demand: a Python worker that needs one operator then loads that alone.
"""


def __getattr__(name: str):
    if name in ("QUERIES", "ORACLE"):
        from ampfold.llm import queries

        return getattr(queries, name)
    raise AttributeError(name)
