"""Writers (rows K1-K14, A13, A14)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = f"\n{'=' * 50}\n"


def csv(df: DataFrame, path: str, parts: int = 1) -> None:
    """With a header; the folder is replaced."""
    df.coalesce(parts).write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _file(path: str, data: bytes) -> None:
    """One file of a driver-side result, in place by a rename."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with files.open_output_stream(f"{at}.part") as out:
        out.write(data)
    files.move(f"{at}.part", at)


#: Rows that a single file for a spreadsheet program may have: its own bound.
SHEET_ROWS = 1_048_575


def _rows(df: DataFrame) -> tuple[list[str], list]:
    rows = df.limit(SHEET_ROWS + 1).collect()
    if len(rows) > SHEET_ROWS:
        raise ValueError(f"more than {SHEET_ROWS} rows don't fit into a sheet")
    return df.columns, rows


def csv_with_mark(df: DataFrame, path: str) -> None:
    """K3: one CSV file with a byte order mark, as spreadsheet programs want; a sheet's rows at most."""
    import csv as writer

    names, rows = _rows(df)
    out = io.StringIO()
    w = writer.writer(out, lineterminator="\n")
    w.writerows([names, *rows])
    _file(path, b"\xef\xbb\xbf" + out.getvalue().encode())


def xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """K5: one workbook with one sheet, numbers as numbers, all else as text."""
    names, rows = _rows(df)

    def cell(v) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
            return f"<c><v>{v}</v></c>"
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", "" if v is None else str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [names, *rows])
    main, rel, pack = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, x in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + x)
    _file(path, out.getvalue())


def text_files(df: DataFrame, path: str, by: str, text: str) -> None:
    """One folder per value of ``by``."""
    df.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


def named_files(df: DataFrame, folder: str, name: str, text: str, suffix: str = "") -> DataFrame:
    """K6-K9: a file a row, ``name`` + ``suffix``, written by the executors, in place by a rename; (name, bytes, error).

    Names of one row each: a task that runs again writes the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for n, t in zip(pdf[name], pdf[text]):
                try:
                    data = (t or "").encode()
                    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
                    files.create_dir(root, recursive=True)
                    _file(f"{folder}/{n}{suffix}", data)
                    rows.append((n, len(data), None))
                except Exception as e:
                    rows.append((n, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["name", "bytes", "error"])

    return df.select(F.col(name).cast("string").alias(name), text).mapInPandas(run, "name string, bytes long, error string")


def cleared(spark, path: str, tree: bool = False) -> int:
    """Deletes a folder's files, or all of it; how many entries went."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return 0
    gone = [s for s in files.listStatus(hadoop) if tree or s.isFile()]
    for s in gone:
        files.delete(s.getPath(), True)
    if tree:
        files.delete(hadoop, True)
    return len(gone)


def save_journal(rows: DataFrame, path: str) -> None:
    """The journal's new rows are appended; a row lost with its task is written again by its retry."""
    rows.select("url", "status", F.col("detail").cast("string").alias("detail")).write.mode("append").json(path)


def joined(order: list[str], text: str, separator: str = SEPARATOR) -> Column:
    """An aggregate that joins texts in order, the separator only between them."""
    items = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col(text).alias("t"))))
    return F.array_join(F.transform(items, lambda s: s["t"]), separator)


def by_number(name: str) -> list[Column]:
    """The order of names by their number before the extension, those without one last, then by name."""
    from ..functions import text as tx

    n = tx.number_suffix(name)
    return [n.isNull().alias("_none"), n.alias("_number"), F.col(name).alias("_name")]
