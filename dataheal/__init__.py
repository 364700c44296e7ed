"""dataheal: measure and repair the quality of related tabular datasets with Spark."""

from dataheal.config import QualityConfig

__all__ = ["QualityConfig"]
