"""stridelog: product-usage analytics as PySpark DataFrame operators and reports."""

from .params import Params
from .sources.tables import Tables

__all__ = ["Params", "Tables"]
