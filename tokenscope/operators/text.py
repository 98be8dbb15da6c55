"""Policy bands, quarantine and boilerplate over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenscope.functions import text as fn


def band_action(scored: DataFrame, policy=fn.BANDS) -> DataFrame:
    """Every row with the action of the first band (least risk, most risk or 0, action) that holds its risk, log where none does."""
    return scored.withColumn("action", fn.action_of(F.col("risk"), policy))


def quarantine(scored: DataFrame, path: str, batch: int = 0) -> None:
    """Rows with action quarantine as JSON, in the batch's own folder, with an identifier that follows from the row.

    A batch that is tried again replaces what it wrote; a write that fails fails the job, so nothing passes.
    """
    held = scored.where("action = 'quarantine'")
    rows = held.withColumn("quarantine_id", F.sha2(F.concat_ws("|", F.lit(batch), F.to_json(F.struct(*held.columns))), 256))
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def redact_or(text, count, fallback):
    """The regex result where something was found, else what fallback (a column, such as a model's pandas UDF) gives."""
    return F.when(count > 0, fn.redact_leftmost(text)).otherwise(fallback)


HEADS = (
    '/* Copyright 2024 Someone.\n * All rights. */\npackage main\nimport (\n\t"fmt"\n\t"os"\n)\nimport "strings"\nfunc main() {}\n',
    "#!/usr/bin/env python\nimport os\nfrom a.b import c, d\nprint(1)\n",
    "import x from 'y';\nimport {z} from \"w\"\ncall();\n",
    "no code here\n",
)
NAMES = ("a.go", "B.PY", "c.tsx", "d.txt")


def sample_files(rows: DataFrame) -> DataFrame:
    """Source files made from a table's keys."""
    at = (F.col("p_partkey") % len(HEADS) + 1).cast("int")
    return rows.select("p_partkey", F.element_at(F.array(*map(F.lit, NAMES)), at).alias("filename"), F.concat(F.element_at(F.array(*map(F.lit, HEADS)), at), F.lit("// "), "p_name").alias("content"))


def prune(files: DataFrame) -> DataFrame:
    """Pruned content with sizes; token savings are the bytes saved times 4/3, as the model has it."""
    pruned = files.withColumn("pruned", fn.prune_boilerplate(F.col("content"), fn.language_of(F.col("filename"))))
    before, after = F.octet_length("content"), F.octet_length("pruned")
    return pruned.select(files.columns[0], "pruned", before.alias("original_size"), after.alias("processed_size"), F.floor((before - after) * 4 / 3).cast("long").alias("token_savings"))
