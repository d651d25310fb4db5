"""Named queries over the test tables, each with SQL that gives the same rows where SQL can."""

from tessera.catalog import analytics, formulas, panel, research  # noqa: F401
from tessera.catalog.base import QUERIES, SQL  # noqa: F401
