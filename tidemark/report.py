"""Small result tables as Markdown and files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shown(value) -> str:
    if value is None:
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def to_markdown(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a Markdown table."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in df.limit(rows).collect()])


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
