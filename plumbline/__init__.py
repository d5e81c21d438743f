"""plumbline: data-reliability checks as Spark jobs.

Tables and streams go in as DataFrames; violations, verdicts, pass rates,
profiles and incidents come out as DataFrames.
"""

from plumbline.rules import RuleError, RuleSet

__all__ = ["RuleError", "RuleSet"]
