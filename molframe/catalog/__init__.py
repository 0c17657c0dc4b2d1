"""Registered queries over the test tables, each with the SQL it must agree with."""

from molframe.catalog import (  # noqa: F401
    cleaning,
    features,
    forests,
    graphs,
    joins,
    metrics,
    runlogs,
    sources,
    splits,
    streams,
    stumps,
    transforms,
)
from molframe.catalog.base import ORACLE, QUERIES  # noqa: F401
