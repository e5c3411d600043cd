"""Where results go: one JSON document, a table for each collection, or lines appended to a log."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(document: dict, path: str | None) -> str:
    """The document as JSON, indented by 2, other scripts as they are; to a file whose folders are made, or just returned."""
    text = json.dumps(document, indent=2, ensure_ascii=False)
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            out.write(text + "\n")
    return text


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """A table for each collection below folder, written by the executors; JSON lines leave null fields out."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def write_sections(sections: dict[str, tuple[DataFrame, list]], folder: str) -> None:
    """A document too large for the driver: a folder of JSON lines for each section below folder, in order from file to file,
    written by the executors. Null fields are left out, and so are columns that start with __, which only order."""
    for name, (df, order) in sections.items():
        fields = [c for c in df.columns if not c.startswith("__")]
        df.orderBy(*order).select(F.to_json(F.struct(*fields)).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def write_drawing(rows: DataFrame, folder: str) -> None:
    """The rows of a drawing (operators/diagram.drawn) as text in their order, from file to file."""
    rows.orderBy(*(c for c in rows.columns if c != "text")).select("text").write.mode("overwrite").text(folder)


def write_report(status: str, sections: dict[str, DataFrame], folder: str) -> None:
    """A report of any size: a folder of JSON lines for each section, each line with the report's status."""
    for name, df in sections.items():
        df.withColumn("status", F.lit(status)).write.mode("overwrite").json(f"{folder}/{name}")


def append_log(events: DataFrame, folder: str, run_id: str, role: str) -> None:
    """Appends events as JSON lines that carry run_id and role."""
    events.withColumns({"run_id": F.lit(run_id), "role": F.lit(role)}).write.mode("append").json(folder)


def report(status: str, sections: dict[str, DataFrame]) -> dict:
    """A report document: a status, and for each section (coverage, quality, warnings) its rows, as small as findings are."""
    return {"status": status} | {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in sections.items()}


def write_files(files: DataFrame, folder: str) -> int:
    """Writes a file for each row of files (module_id, content binary) below folder (a URI); returns how many. The
    executors write through Arrow's file systems; a file written again by a repeated task is the same."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for module, content in zip(frame["module_id"], frame["content"]):
                path = f"{root}/{module}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(frame)]})

    return files.select("module_id", "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
