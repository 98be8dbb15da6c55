"""Column functions for tokens, prices, budgets and trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dollars per million input, cached input and output tokens, by model.
PRICES = (
    ("claude-sonnet-4-20250514", 3.0, 0.30, 15.0),
    ("claude-3-5-sonnet-20241022", 3.0, 0.30, 15.0),
    ("claude-3-5-haiku-20241022", 0.80, 0.08, 4.0),
    ("claude-3-opus-20240229", 15.0, 1.50, 75.0),
    ("claude-3-haiku-20240307", 0.25, 0.03, 1.25),
)
DEFAULT_MODEL = "claude-sonnet-4-20250514"

# Provider, dollars per million input and output tokens, for the monthly comparison.
MONTHLY_RATES = (
    ("OpenAI GPT-4o", 2.50, 10.00),
    ("OpenAI GPT-5.4", 2.50, 15.00),
    ("Anthropic Sonnet", 3.00, 15.00),
    ("Anthropic Opus", 5.00, 25.00),
    ("Anthropic Haiku", 1.00, 5.00),
)
TOOLS_PER_SERVER, TOKENS_PER_TOOL = 35, 75


def estimate_tokens(text: Column, ratio: float = 4) -> Column:
    """Bytes over ratio, rounded up; null and empty texts have none, a ratio of 0 or less counts as 4."""
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(float(ratio if ratio > 0 else 4))), F.lit(0)).cast("long")


def floor_tokens(text: Column) -> Column:
    """The compactor's estimate: bytes over 4, rounded down."""
    return F.coalesce(F.floor(F.octet_length(text) / F.lit(4)), F.lit(0)).cast("long")


def saved_tokens(original: Column, optimized: Column) -> tuple[Column, Column, Column]:
    """(optimized, at most the original; saved; percent) from token counts."""
    clamped = F.least(optimized, original)
    saved = original - clamped
    return clamped, saved, F.round(F.when(original > 0, saved / original * 100).otherwise(0.0), 6)


def price_table(spark):
    return spark.createDataFrame(PRICES, "model string, input_price double, cached_price double, output_price double")


def dollars_saved(tokens: Column, input_price: Column, cached_price: Column) -> Column:
    """Dollars that cached input saves; 0 for unknown models and for no tokens."""
    return F.when(tokens > 0, tokens / F.lit(1_000_000.0) * (input_price - cached_price)).otherwise(0.0)


def humanized(n: Column) -> Column:
    """1.5M, 2.0K or the number; one digit, rounded from the binary value, which format_string does not do."""
    short = lambda x, unit: F.concat(F.replace(F.format_number(x, 1), F.lit(","), F.lit("")), F.lit(unit))
    return F.when(n >= 1_000_000, short(n / 1e6, "M")).when(n >= 1000, short(n / 1e3, "K")).otherwise(n.cast("string"))


def recency_score(days: Column) -> Column:
    """30, 20 or 10 for a release up to 30, 90 or 365 days ago; a release up to a day ahead counts as recent."""
    return F.when(days.isNull(), 0).when((days >= -1) & (days <= 30), 30).when(days < 0, 0).when(days <= 90, 20).when(days <= 365, 10).otherwise(0)


def issue_score(n: Column) -> Column:
    """25, 15 or 5 below 5, 20 or 100 open issues; none reported gives nothing."""
    return F.when(n <= 0, 0).when(n < 5, 25).when(n < 20, 15).when(n < 100, 5).otherwise(0)


def download_score(n: Column) -> Column:
    return F.when(n <= 0, 0).when(n >= 100_000, 25).when(n >= 10_000, 20).when(n >= 1000, 15).when(n >= 100, 10).otherwise(5)


def trust_score(given: Column, days: Column, issues: Column, downloads: Column, is_empty: Column) -> Column:
    """The given score if positive, 100 for an entry without any data, else the sum of its signals, from 0 to 100."""
    total = recency_score(days) + issue_score(issues) + download_score(downloads)
    return F.when(given > 0, given).when(is_empty, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))


def trust_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def budget_action(known: Column, remaining: Column, daily: Column, used: Column, monthly: Column, hard_cap: Column, soft_pct: Column) -> tuple[Column, Column, Column]:
    """(action, daily percent, monthly percent): allow, reject or downgrade, in the order of the checks."""
    day = F.when(daily > 0, 100.0 - remaining / daily * 100.0).otherwise(0.0)
    month = F.when(monthly > 0, used / monthly * 100.0).otherwise(0.0)
    out = (daily > 0) & (remaining <= 0)
    over = (monthly > 0) & (used >= monthly)
    soft = (day >= soft_pct) | (month >= soft_pct)
    action = F.when(~known, "allow").when(out | over, "reject").when(hard_cap & soft, "reject").when(soft, "downgrade").otherwise("allow")
    return action, F.when(out, 100.0).otherwise(day), F.when(over & ~out, 100.0).otherwise(month)


def truncate_bytes(text: Column, n: int) -> Column:
    """Text of more than n bytes cut to n - 3 bytes and an ellipsis; a character that the cut would split goes."""
    if n <= 0:
        return text
    keep = n - 3 if n >= 3 else n
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(text.cast("binary"), 1, keep).cast("string")), "�+$", "")
    return F.when(F.octet_length(text) > n, F.concat(cut, F.lit("..." if n >= 3 else ""))).otherwise(text)
