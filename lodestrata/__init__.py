"""lodestrata: data-quality analytics and corpus operators on Spark DataFrames."""

from .api import diff, fix, lint, profile
from .operators.config import ColumnPolicy, Config
from .operators.findings import Finding

__all__ = ["ColumnPolicy", "Config", "Finding", "diff", "fix", "lint", "profile"]
