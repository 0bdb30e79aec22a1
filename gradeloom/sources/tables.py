"""Table rows for documents, and stage checkpoints as JSON arrays."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latex_row(name: Column, values: list[Column], decimals: int = 3) -> Column:
    """A row of a LaTeX table: underscores of the name as blanks, a leading 'input/' left off, numbers to three decimals."""
    text = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "input/", "")
    return F.concat(text, *(F.concat(F.lit(" & "), F.when(v.isNotNull(), F.format_string(f"%.{decimals}f", v)).otherwise("")) for v in values), F.lit(" \\\\"))


def latex_table(lines: DataFrame, header: list[str], limit: int = 1000) -> str:
    """The table around rows (feature, line), in order of feature; a table for print, so of at most ``limit`` lines."""
    rows = [r.line for r in lines.orderBy("feature").limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} lines")
    return "\n".join([r"\begin{tabular}{l" + "r" * len(header) + "}", " & ".join(["", *header]) + r" \\", *rows, r"\end{tabular}"])


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """A stage's rows as JSON, non-ASCII kept: a folder of JSON lines written by the executors.

    With ``single`` one pretty JSON array is written by the driver instead, streaming partition by partition; for exports that are read by hand.
    """
    if not single:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    with Path(path).open("w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            f.write(",\n" if i else "\n")
            f.write(json.dumps(json.loads(r.j), indent=4, ensure_ascii=False))
        f.write("\n]\n")
