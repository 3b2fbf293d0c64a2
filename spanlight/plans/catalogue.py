"""All queries of the library: importing this registers them."""

from . import more_queries, python_queries, stat_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
