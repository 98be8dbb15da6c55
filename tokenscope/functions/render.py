"""Column functions that render values as text, and parse them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenscope.functions.scalars import TOKENS_PER_TOOL, TOOLS_PER_SERVER

# Tokens of the gateway's own schema, tools per KiB of description.
GATEWAY_TOKENS, TOOLS_PER_KIB = 158, 40
# Methods with their likely sensitive fields.
SENSITIVE = (("tools/call", ("arguments", "input")), ("resources/read", ("uri", "contents")))
# Date formats in the order in which they are tried.
DATES = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "MMMM d, yyyy", "MMM d, yyyy")


def percent_text(p: Column) -> Column:
    """One decimal, left out if it would be under a twentieth; 0 for nothing and less."""
    whole = F.floor(p)
    return F.when(p <= 0, "0").when(p - whole < 0.05, whole.cast("string")).otherwise(F.replace(F.format_number(p, 1), F.lit(","), F.lit("")))


def duration_text(seconds: Column) -> Column:
    """The two largest of days, hours, minutes and seconds: 2d3h, 3h4m, 4m5s, 5s."""
    s = seconds.cast("long")
    d, h, m = F.floor(s / 86_400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    text = lambda *parts: F.concat(*[x for n, u in parts for x in (n.cast("string"), F.lit(u))])
    return F.when(d > 0, text((d, "d"), (h, "h"))).when(h > 0, text((h, "h"), (m, "m"))).when(m > 0, text((m, "m"), (s % 60, "s"))).otherwise(text((s % 60, "s")))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("\\`"))


def file_name(text: Column) -> Column:
    """Bytes other than ASCII letters, digits, hyphen and underscore become an underscore each."""
    one_byte = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.regexp_replace(one_byte, r"[^a-zA-Z0-9_-]", "_")


def env_list(env: Column) -> Column:
    """A map as sorted K=V strings."""
    return F.transform(F.array_sort(F.map_entries(env)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATES])


def sensitive_fields(method: Column) -> Column:
    out = F.array(F.lit("payload"))
    for m, fields in SENSITIVE:
        out = F.when(method == m, F.array(*map(F.lit, fields))).otherwise(out)
    return out


def estimated_tools(description: Column) -> Column:
    """At least 35, more for descriptions of a KiB and over."""
    kib = F.floor(F.octet_length(description) / 1024)
    return F.greatest(F.lit(TOOLS_PER_SERVER), kib * TOOLS_PER_KIB).cast("long")


def cost_preview(name: Column, transport: Column, tools: Column) -> Column:
    native = tools * TOKENS_PER_TOOL
    saved = F.greatest(F.lit(0), native - GATEWAY_TOKENS)
    full = F.format_string("%s (%s, ~%d tools): ~%d native against %d routed tokens (saves ~%d / %s%%)", name, transport, tools, native, F.lit(GATEWAY_TOKENS), saved, percent_text(saved / native * 100))
    return F.when(saved > 0, full).otherwise(F.format_string("%s (%s): ~%d native against %d routed tokens (no savings)", name, transport, native, F.lit(GATEWAY_TOKENS)))


def since(days: str | None, now: datetime) -> datetime | None:
    """The moment so many days before now; None for what is no positive integer."""
    digits = (days or "").strip()
    n = int(digits) if digits.isascii() and digits.isdigit() else 0
    return now - timedelta(days=n) if n > 0 else None


def valid_description_chars(n: Column) -> Column:
    """None, 0, or 50 to 500."""
    return n.isNull() | (n == 0) | n.between(50, 500)


def compact_description(text: Column) -> Column:
    """At most 50 bytes: 47 and an ellipsis."""
    from tokenscope.functions.scalars import truncate_bytes

    return truncate_bytes(text, 50)


def fits_signature(name: Column, description: Column, most: int = 500) -> Column:
    """Whether name and description as JSON take at most so many bytes."""
    return F.octet_length(F.to_json(F.struct(name.alias("name"), description.alias("description")))) <= most
