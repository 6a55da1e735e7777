"""Sinks: CSV, JSON, YAML, Markdown and command files. Tables are written by Spark; texts are made of small results."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numbers import finite
from .operators.sets import union_all


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, overwriting; `single` is for small reports that must be one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_union_csv(tables: list[DataFrame], path: str, single: bool = False) -> bool:
    """Rows of all tables under the union of their columns in the order first seen; nothing is written without a table.

    Files are as many as tasks, each with the header; `single` is for small reports that must be one file.
    """
    if not tables:
        return False
    write_csv(union_all(*tables), path, single)
    return True


def write_lines(lines: DataFrame, path: str, place: str = "place", line: str = "line") -> None:
    """Text files that hold the lines in the order of place, one range of places after the other by the files' names."""
    lines.repartitionByRange(F.col(place)).sortWithinPartitions(place).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def json_document(df: DataFrame, order: str) -> DataFrame:
    """(value): all rows as one JSON list, in order, made by an aggregate. A document is read whole: for rows as few as a document has."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*df.columns).alias("row"))))
    return finite_columns(df).agg(F.to_json(F.transform(rows, lambda r: r["row"]), {"ignoreNullFields": "false"}).alias("value"))


def markdown_lines(rows: DataFrame, columns: list[str], order: list) -> DataFrame:
    """(place, line) of a Markdown table of any number of rows: head and rule at -1 and 0, then the rows from 1 in an order without ties.

    Columns that the table lacks are left out; cells are written where the rows lie.
    """
    from .operators.ranking import ranked_together

    shown = [c for c in columns if c in rows.columns]
    laid = ranked_together(rows, order, "_place").select("_place", *shown)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cells = [[markdown_cell(v) for v in c.to_pylist()] for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([f"| {' | '.join(row)} |" for row in zip(*cells, strict=True)], pa.string())], names=["place", "line"])

    head = rows.sparkSession.createDataFrame([(-1, f"| {' | '.join(shown)} |"), (0, f"|{'---|' * len(shown)}")], "place long, line string")
    return head.unionByName(laid.mapInArrow(run, "place long, line string"))


def yaml_documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): every row's other columns as a YAML document, written where the row lies."""
    others = [c for c in rows.columns if c != key]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [yaml_text({c: r[c] for c in others}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, text string")


def finite_columns(df: DataFrame) -> DataFrame:
    """df with NaN and infinities as null."""
    return df.select(*(finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def json_rows(df: DataFrame) -> DataFrame:
    """(line): each row as a JSON object; NaN and infinities become null."""
    return finite_columns(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def append_json_lines(df: DataFrame, path: str) -> None:
    finite_columns(df).write.mode("append").json(path)


def append_facts(df: DataFrame, path: str) -> None:
    """Trial facts as they come; summaries are views on them, computed when read."""
    df.write.mode("append").parquet(path)


def write_normaliser(fitted: DataFrame, split: DataFrame, path: str) -> None:
    """Normalisation constants beside the keys of the split that they were fitted on: <path>/normaliser and <path>/split, Parquet each."""
    fitted.write.mode("overwrite").parquet(f"{path}/normaliser")
    split.write.mode("overwrite").parquet(f"{path}/split")


def read_normaliser(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/normaliser"), spark.read.parquet(f"{path}/split")


def jsonable(value):
    """Plain JSON data: keys as text, non-finite numbers as null, library scalars as their own."""
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [jsonable(v) for v in value]
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def json_text(value) -> str:
    return json.dumps(jsonable(value), indent=2, ensure_ascii=False)


def _yaml_scalar(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    text = str(value)
    plain = re.fullmatch(r"[A-Za-z_./][A-Za-z0-9_./ -]*", text) and text.strip() == text and text.lower() not in ("true", "false", "null", "yes", "no")
    return text if plain else json.dumps(text, ensure_ascii=False)


def yaml_text(value, depth: int = 0) -> str:
    """Nested dictionaries and lists as block YAML; texts are quoted unless plainly safe."""
    value, pad = jsonable(value) if depth == 0 else value, "  " * depth
    lines = []
    items = value.items() if isinstance(value, dict) else ((None, v) for v in value)
    for key, v in items:
        head = f"{pad}{key}:" if key is not None else f"{pad}-"
        if isinstance(v, (dict, list)) and v:
            lines += [head, yaml_text(v, depth + 1).rstrip("\n")]
        else:
            lines.append(f"{head} {'{}' if v == {} else '[]' if v == [] else _yaml_scalar(v)}")
    return "\n".join(lines) + "\n"


def markdown_cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    text = f"{value:.6g}" if isinstance(value, float) else str(value)
    return text.replace("|", r"\|").replace("\n", " ")


def markdown_table(rows: Iterable[dict], columns: list[str], limit: int | None = None) -> str:
    """A Markdown table of the columns that some row has, the first `limit` rows."""
    rows = list(rows)
    shown = [c for c in columns if any(c in r for r in rows)]
    if not rows or not shown:
        return "_no rows_\n"
    lines = ["| " + " | ".join(shown) + " |", "|" + "---|" * len(shown)]
    lines += ["| " + " | ".join(markdown_cell(r.get(c)) for c in shown) + " |" for r in rows[:limit]]
    return "\n".join(lines) + "\n"


def report(title: str, sections: list[tuple[str, str]]) -> str:
    """A Markdown document of titled sections."""
    return "\n".join([f"# {title}", "", *(f"## {head}\n\n{body.rstrip()}\n" for head, body in sections)])


def powershell_quoted(text: str) -> str:
    """The argument as PowerShell takes it: plain, or in single quotes with those inside doubled."""
    return text if re.fullmatch(r"[A-Za-z0-9_./:=\\-]+", text) else "'" + text.replace("'", "''") + "'"


def powershell_quoted_column(text: Column) -> Column:
    """powershell_quoted of a column."""
    return F.when(text.rlike(r"\A[A-Za-z0-9_./:=\\-]+\z"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))


def command_text(parts: Iterable[str]) -> str:
    return " ".join(powershell_quoted(str(p)) for p in parts)
