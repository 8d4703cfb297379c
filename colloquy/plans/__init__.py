"""The catalogue of queries over the given tables."""

from ..sources.tables import with_views
from . import catalogue, collation, conversations, evals, experiments, factors, generated, judging, kept, models, runs, validation

__all__ = ["catalogue", "collation", "conversations", "evals", "experiments", "factors", "generated", "judging", "kept", "models", "oracle_sql", "queries", "runs", "validation"]


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in catalogue.SQL.items()}
