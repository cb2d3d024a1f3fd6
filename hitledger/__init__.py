"""Access-log analytics as Spark jobs: parse, count, rank, trend, save, merge and export."""

from hitledger.functions.grouping import GroupingRules, GroupRule
from hitledger.plans.ledger import Ledger, analyze

__all__ = ["GroupRule", "GroupingRules", "Ledger", "analyze"]
