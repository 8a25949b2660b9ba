"""Writers: Parquet, CSV, JSON, ORC and spreadsheets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from .xlsx import write_xlsx

FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "json", ".orc": "orc", ".xlsx": "xlsx"}


def export(df: DataFrame, path: str, kind: str | None = None, *, mode: str = "overwrite", single_file: bool = False) -> str:
    """Write a table in the format of the extension (or ``kind``); returns the path.

    Distributed formats give a folder of part files; ``single_file`` gathers them in one task.
    """
    kind = kind or FORMATS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"unknown format of {path}; one of {', '.join(FORMATS)}")
    if kind == "xlsx":
        write_xlsx(df, path.removeprefix("file:"))
        return path
    writer = (df.coalesce(1) if single_file else df).write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.options(header=True, sep="\t" if kind == "tsv" else ",", escape='"').csv(path)
    else:
        getattr(writer, kind)(path)
    return path
