"""Pool-based active learning over large candidate tables, as Spark DataFrame queries."""

__version__ = "0.1.0"
