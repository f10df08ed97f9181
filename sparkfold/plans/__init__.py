"""The registered queries and their oracle SQL."""

from . import encoding, files, media, profiles, redundancy  # noqa: F401
from .common import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
