"""Registered queries by family."""

from tallyvane.plans.registry import ORACLES, QUERIES


def _load() -> None:
    from tallyvane.plans import curate, evaluate, fitting, protocol, report, score, split, stream, study  # noqa: F401


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
