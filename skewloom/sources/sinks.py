"""Sinks: rounds as Parquet partitions, append-only logs, tidy tables, Markdown."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_round(df: DataFrame, path: str, t: int) -> None:
    """The survivors of round t as a partition, replaced as a whole if the round is repeated."""
    df.write.mode("overwrite").parquet(f"{path}/round={t}")


def append_log(df: DataFrame, path: str) -> None:
    """One more line of metrics; written after the round, so the log counts finished rounds."""
    df.coalesce(1).write.mode("append").json(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A result table as Parquet, JSON, or CSV with header."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else getattr(writer, form)(path)


def write_settings(spark: SparkSession, settings: Mapping, path: str) -> None:
    """Settings, a specification or statistics as one JSON document."""
    text = json.dumps(settings, indent=2, default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\x00")


def read_settings(spark: SparkSession, path: str) -> dict:
    """What ``write_settings`` wrote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0].rstrip("\x00\n"))


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """Ids with their split, a partition per split, so that a reader of one split opens no other."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def json_lines(columns: Sequence[str]):
    """The columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def mean_sd(mean: str, sd: str, digits: int = 4):
    """'mean ± sd' cells."""
    return F.format_string(f"%.{digits}f ± %.{digits}f", F.col(mean), F.coalesce(F.col(sd), F.lit(0.0)))


def signed_ci(mean: str, ci: str, n: str, digits: int = 4):
    """'+d ± ci (n=)' cells."""
    return F.format_string(f"%+.{digits}f ± %.{digits}f (n=%d)", F.col(mean), F.coalesce(F.col(ci), F.lit(float("nan"))), F.col(n))


def markdown(df: DataFrame, columns: Sequence[str] | None = None, most: int = 10_000) -> str:
    """A Markdown table of a report; reports are small, and more than ``most`` rows are refused."""
    names = list(columns or df.columns)
    rows = df.select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report may have {most} rows")
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
