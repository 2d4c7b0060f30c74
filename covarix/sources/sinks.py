"""Sinks: JSON summaries, matrices, entropy tables, per-sequence dumps, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_matrix_csv(pairs: DataFrame, row: str, col: str, value: str, path: str) -> None:
    """Wide CSV of a long matrix, rows in order; for matrices whose columns fit a table."""
    wide = pairs.groupBy(row).pivot(col).agg(F.first(value)).na.fill(0).orderBy(row)
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_matrix(pairs: DataFrame, path: str) -> None:
    """The long form, which scales."""
    pairs.write.mode("overwrite").parquet(path)


def write_entropies(stats: DataFrame, path: str) -> None:
    """``pos,entropy,perplexity`` with 6 and 4 decimals."""
    rows = stats.select("pos", F.format_string("%.6f", F.col("entropy") + 0.0).alias("entropy"), F.format_string("%.4f", "perplexity").alias("perplexity"))
    rows.orderBy("pos").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_kmaps(maps: DataFrame, path: str) -> None:
    """Per-sequence maps, one folder a sequence."""
    maps.write.mode("overwrite").partitionBy("seq_id").csv(path, header=True)


def markdown_table(df: DataFrame, max_rows: int = 100) -> str:
    """A report table of at most ``max_rows`` rows."""
    rows = df.limit(max_rows).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)


def code_grid(cells: dict[tuple[int, int], object], size: int = 20) -> str:
    """A Markdown grid of the cells of a K-map; empty cells are 0."""
    head = "| |" + "".join(f" {j} |" for j in range(size)) + "\n|" + "---|" * (size + 1) + "\n"
    return head + "".join(f"| {i} |" + "".join(f" {cells.get((i, j), 0)} |" for j in range(size)) + "\n" for i in range(size))


def markdown_kmap(cells: DataFrame, size: int = 20) -> str:
    """A K-map of ``(code_i, code_j, value)`` as a Markdown grid; at most size * size cells."""
    return code_grid({(r[0], r[1]): r[2] for r in cells.where((F.col("code_i") < size) & (F.col("code_j") < size)).select("code_i", "code_j", "value").collect()}, size)


def heat_map_svg(cells: DataFrame, row: str, col: str, value: str, size: int = 500, side: int = 6) -> str:
    """The matrix of a long table as a picture: rows and columns below ``size``, darker for larger values, a title a cell."""
    at = cells.where((F.col(row) < size) & (F.col(col) < size)).select(row, col, F.col(value).cast("double")).collect()
    most, width = max((r[2] for r in at), default=0) or 1, side * (max((max(r[0], r[1]) for r in at), default=-1) + 1)
    boxes = "".join(f'<rect x="{side * r[1]}" y="{side * r[0]}" width="{side}" height="{side}" fill="rgb({(shade := round(255 * (1 - r[2] / most)))},{shade},255)"><title>{r[0]}, {r[1]}: {r[2]:.4f}</title></rect>' for r in at)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{width}">{boxes}</svg>\n'
