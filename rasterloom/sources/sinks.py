"""Where results go: files, tables of outputs, text."""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


#: Folders of attempts begin so.
STAGING = ".attempt-"


@dataclass
class Staged(WriterCommitMessage):
    """Where an attempt's files are, by number, and their names."""

    folder: str
    names: list


class FileSink(DataSource):
    """format("image_files"): columns name and data; option path, a folder that every executor sees. Tasks write to a folder of their attempt below it; files get their names when the whole write commits."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def write(self, rows) -> WriterCommitMessage:
        staged, names = os.path.join(self.path, f"{STAGING}{uuid.uuid4().hex}"), []
        os.makedirs(staged, exist_ok=True)
        for row in rows:
            name = os.path.normpath(row["name"])
            if name.startswith(("..", "/")):
                raise ValueError(f"outside the folder: {row['name']}")
            with open(os.path.join(staged, str(len(names))), "wb") as f:
                f.write(row["data"])
            names.append(name)
        return Staged(staged, names)

    def commit(self, messages: list) -> None:
        """Only attempts that the driver accepted come here; what a lost or slower attempt wrote stays in its own folder and goes with it."""
        for message in messages:
            for i, name in enumerate(message.names if message else ()):
                target = os.path.join(self.path, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.replace(os.path.join(message.folder, str(i)), target)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if name.startswith(STAGING):
                shutil.rmtree(os.path.join(self.path, name), ignore_errors=True)


def write_outputs(results: DataFrame, path: str) -> None:
    """Rows with a column `result` as Parquet, by format: the form for large numbers."""
    results.withColumn("format", F.coalesce("result.format", F.lit("error"))).write.partitionBy("format").mode("overwrite").parquet(path)


def response_headers(fmt, negotiated: bool) -> dict:
    """Columns of the headers of an answer."""
    out = {"content_type": F.concat(F.lit("image/"), fmt), "cache_control": F.lit("public, max-age=31536000")}
    return out | ({"vary": F.lit("Accept")} if negotiated else {})
