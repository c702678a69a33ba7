"""All queries of the library with their SQL; importing this registers them."""

from quire.plans import catalog_queries, layout_queries, retrieval_queries  # noqa: F401
from quire.plans.fixtures import QUERIES, SQL  # noqa: F401
