"""Writers: graph JSON, review and evidence CSV, JSON lines, Markdown, manifests."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATRIX = ["paper_id", "title", "item_type", "item_id", "text", "section", "page", "evidence_span", "confidence"]
_NODE = ["id", "label", "type", "paper_id", "section", "page", "evidence_span", "confidence"]
_EDGE = ["source", "target", "type", "paper_id", "section", "page", "evidence_span", "confidence"]


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV parts with header, minimal quoting, doubled quotes and CRLF, sorted within
    and across parts if an order is given."""
    rows = df.orderBy(*order).drop(*[c for c in order if c not in MATRIX and c in ("doc_idx", "type_ord", "ord")]) if order else df
    rows.write.mode("overwrite").csv(path, header=True, escape='"', lineSep="\r\n", emptyValue="")


def write_evidence_matrix(matrix: DataFrame, path: str) -> None:
    ordered = matrix.orderBy("doc_idx", "type_ord", "ord").select(*MATRIX)
    ordered.write.mode("overwrite").csv(path, header=True, escape='"', lineSep="\r\n", emptyValue="")


def write_json_lines(df: DataFrame, path: str) -> int:
    """JSON lines with sorted keys and nulls kept; the number of rows."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path, ignoreNullFields="false")
    return df.sparkSession.read.text(path).count()


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON file streamed row by row through the driver; for graphs meant to be read by
    people. Large graphs go to :func:`write_parquet`."""

    def rows(df: DataFrame, cols: list[str]) -> Iterable[str]:
        last = ["ord2"] if "ord2" in df.columns else []
        ordered = df.orderBy("doc_idx", "type_ord", "ord", *last)
        return (r[0] for r in ordered.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).toLocalIterator())

    def block(items: Iterable[str], out) -> None:
        for n, x in enumerate(items):
            text = json.dumps(json.loads(x), ensure_ascii=False, indent=2)
            out.write((",\n" if n else "\n") + "\n".join("    " + y for y in text.split("\n")))

    with Path(path).open("w", encoding="utf-8", newline="\n") as out:
        out.write('{\n  "nodes": [')
        block(rows(nodes, _NODE), out)
        out.write('\n  ],\n  "edges": [')
        block(rows(edges, _EDGE), out)
        out.write("\n  ]\n}\n")


def write_markdown(blocks: DataFrame, path: str, title: str, question: str = "") -> None:
    """Blocks of papers in order under a title and an optional question."""
    with Path(path).open("w", encoding="utf-8", newline="\n") as out:
        out.write(f"# {title}\n" + (f"\n## 질문\n\n{question}\n" if question else ""))
        for r in blocks.orderBy("doc_idx").select("block").toLocalIterator():
            out.write("\n" + r[0] + "\n")


def manifest(path: str, source: str, files: dict[str, str], counts: dict[str, int], **more: object) -> dict:
    row = {"source": source, "files": files, "rows": counts, **more}
    Path(path).write_text(json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return row
