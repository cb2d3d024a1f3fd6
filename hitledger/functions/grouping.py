"""User rules that rewrite address, path and user agent before counting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hitledger.functions.regex_dialect import Translated, UnsupportedPattern

# The default rule, which changes nothing.
IDENTITY_PATTERN = "^(.*)$"
IDENTITY_TEMPLATE = "$1"


@dataclass(frozen=True)
class GroupRule:
    """Replace every match of ``pattern`` by ``template``; text without a match stays as it is."""

    pattern: str = IDENTITY_PATTERN
    template: str = IDENTITY_TEMPLATE
    option: str = "group pattern"
    _java: tuple[str, str] | None = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        if self.is_identity:
            return
        try:
            translated = Translated(self.pattern)
        except UnsupportedPattern as problem:
            raise ValueError(f"Invalid {self.option}: {problem}") from None
        object.__setattr__(self, "_java", (translated.java, translated.java_template(self.template)))

    @property
    def is_identity(self) -> bool:
        return (self.pattern, self.template) == (IDENTITY_PATTERN, IDENTITY_TEMPLATE)

    def apply(self, text: Column) -> Column:
        if self.is_identity:
            return text
        pattern, template = self._java
        return F.regexp_replace(text, F.lit(pattern), F.lit(template))

    def validate(self, spark: SparkSession) -> None:
        """Have Spark compile the pattern now, before any log is read."""
        if self.is_identity:
            return
        try:
            spark.sql("SELECT '' RLIKE :pattern", {"pattern": self._java[0]}).collect()
        except PySparkException as problem:
            raise ValueError(f"Invalid {self.option}: {self.pattern}") from problem


@dataclass(frozen=True)
class GroupingRules:
    """One rule per rewritable field. Status codes are never rewritten."""

    ip: GroupRule = GroupRule()
    path: GroupRule = GroupRule()
    user_agent: GroupRule = GroupRule()

    @classmethod
    def from_options(
        cls,
        spark: SparkSession,
        group_ip_regex: str = IDENTITY_PATTERN,
        group_ip_replace: str = IDENTITY_TEMPLATE,
        group_path_regex: str = IDENTITY_PATTERN,
        group_path_replace: str = IDENTITY_TEMPLATE,
        group_ua_regex: str = IDENTITY_PATTERN,
        group_ua_replace: str = IDENTITY_TEMPLATE,
    ) -> GroupingRules:
        """Rules from option values; an invalid pattern is an error that names its option."""
        rules = cls(
            GroupRule(group_ip_regex, group_ip_replace, "group_ip_regex"),
            GroupRule(group_path_regex, group_path_replace, "group_path_regex"),
            GroupRule(group_ua_regex, group_ua_replace, "group_ua_regex"),
        )
        for rule in (rules.ip, rules.path, rules.user_agent):
            rule.validate(spark)
        return rules
