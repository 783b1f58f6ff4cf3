"""Sinks for what people and other programs read: one JSON file a run, and Markdown tables."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from gaugeflow.sources.two_phase import TwoPhaseWriter, opened


def plain(value):
    """A value as JSON holds it: numbers that are not finite become null, dates and decimals text, keys text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value.hex() if isinstance(value, bytes) else str(value)


class DocumentWriter(TwoPhaseWriter):
    """Rows ``folder, file`` and others to ``<path>/<folder>/<file>``, each a JSON object of the others."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        super().__init__(path, overwrite)
        self.maps = {f.name: f.dataType for f in schema.fields}

    def parts(self, batches: Iterator):
        for batch in batches:
            for row in batch.to_pylist():
                folder, file = row.pop("folder"), row.pop("file")
                if not folder or not file or {"/", "\\"} & set(folder + file) or folder.startswith((".", "_")) or file.startswith((".", "_")):
                    raise ValueError(f"no name for a file: {folder}/{file}")
                document = {k: _with_maps(v, self.maps[k]) for k, v in row.items()}
                yield f"{folder}/{file}", json.dumps(plain(document), indent=2, allow_nan=False).encode()


def _with_maps(value, kind: T.DataType):
    """Arrow gives maps as lists of pairs; here they are objects again."""
    if value is None:
        return None
    if isinstance(kind, T.MapType):
        return {k: _with_maps(v, kind.valueType) for k, v in (value.items() if isinstance(value, dict) else value)}
    if isinstance(kind, T.ArrayType):
        return [_with_maps(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _with_maps(value[f.name], f.dataType) for f in kind.fields}
    return value


class MarkdownWriter(TwoPhaseWriter):
    """Rows to one file with a heading and a table; tasks write lines, the driver puts them together in the tasks' order."""

    def __init__(self, path: str, schema: T.StructType, title: str, bold: str | None):
        folder, self.file = path.rstrip("/").rsplit("/", 1)
        super().__init__(folder, overwrite=False)
        self.columns, self.title, self.bold = schema.fields, title, bold

    def parts(self, batches: Iterator):
        from pyspark import TaskContext

        lines = []
        for batch in batches:
            for row in batch.to_pylist():
                cells = (self._cell(f, row[f.name]) for f in self.columns)
                lines.append("| " + " | ".join(cells) + " |\n")
        yield f"{TaskContext.get().partitionId():08d}", "".join(lines).encode()

    def _cell(self, field: T.StructField, value) -> str:
        if value is None:
            return ""
        text = f"{value:.4f}" if isinstance(value, float) else str(value)
        text = text.replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")
        return f"**{text}**" if field.name == self.bold else text

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        number = lambda f: "---:" if isinstance(f.dataType, T.NumericType) else "---"
        text = [f"# {self.title}\n\n"] if self.title else []
        text += ["| " + " | ".join(f.name for f in self.columns) + " |\n", "|" + "|".join(number(f) for f in self.columns) + "|\n"]
        for at, _ in sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f[1]):
            with system.open_input_file(at) as f:
                text.append(f.read().decode())
        whole = f"{self.aside()}/whole"
        with system.open_output_stream(whole) as f:
            f.write("".join(text).encode())
        system.move(whole, f"{root}/{self.file}")
        self._clear(system)


class DocumentSource(DataSource):
    """Format ``run_documents``."""

    @classmethod
    def name(cls) -> str:
        return "run_documents"

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], schema, overwrite)


class MarkdownSource(DataSource):
    """Format ``markdown``: options ``path`` (the file), ``title`` and ``bold``, a column."""

    @classmethod
    def name(cls) -> str:
        return "markdown"

    def writer(self, schema: T.StructType, overwrite: bool) -> MarkdownWriter:
        return MarkdownWriter(self.options["path"], schema, self.options.get("title", ""), self.options.get("bold"))


def write_documents(rows: DataFrame, root: str, mode: str = "append") -> None:
    """Each row's columns but ``folder`` and ``file`` as a JSON file of that name, which ``runs.read_metrics`` can read.

    Files of other rows stay with ``append``; with ``overwrite`` those that earlier writes made and this one does not go.
    """
    rows.sparkSession.dataSource.register(DocumentSource)
    rows.write.format("run_documents").mode(mode).save(root)


def write_markdown(rows: DataFrame, file: str, title: str = "", bold: str | None = None) -> None:
    """A report as one Markdown file, its rows in the order of the DataFrame; numbers with a fraction have four places."""
    rows.sparkSession.dataSource.register(MarkdownSource)
    writer = rows.write.format("markdown").option("title", title)
    (writer.option("bold", bold) if bold else writer).mode("append").save(file)
