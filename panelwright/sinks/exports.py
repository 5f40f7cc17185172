"""CSV files, CSV as a data link, export names, HTML tables."""

from __future__ import annotations

import datetime as dt
import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.numbering import summed

#: Rows of a report that may be rendered on the driver; ``write_html`` takes any number.
RENDERED = 10_000
#: Bytes of a CSV text that a part of its base64 encodes.
PART = 3 << 16
#: Columns whose cells are HTML already.
MARKED = ("signal", "pct_change", "confidence", "grade", "details")
# The label and classes of the download link, and the table's class.
_LINK, _LINK_CLASS, _TABLE_CLASS = "📥 Download CSV Report", "download-link", "stMarkdown table"


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def quoted(c: Column) -> Column:
    """A CSV field; quoted if it has a comma, a quote or a line feed. Null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, order: str) -> DataFrame:
    """(pos, line): one CSV line per row."""
    fields = [c for c in rows.columns if c != order]
    return rows.select(F.col(order).alias("pos"), F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in fields]).alias("line"))


def csv_base64(rows: DataFrame, order: str) -> DataFrame:
    """One row with the base64 of the whole CSV text, lines by ``order``. A report's rows meet in one task by nature of the cell; ``csv_base64_parts`` has parts instead."""
    header = ",".join(c for c in rows.columns if c != order)
    lines = csv_lines(rows, order).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    text = F.concat(F.lit(header + "\n"), F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), ""))
    return lines.select(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", "").alias("csv_base64"))


def csv_base64_parts(rows: DataFrame, order: str, size: int = PART) -> DataFrame:
    """(part, csv_base64): the base64 of the whole CSV text, lines by ``order``, in parts that give ``csv_base64`` when joined in their order.

    Each part encodes ``size`` bytes, a multiple of three, so only the last can need padding. Where a line's bytes lie
    follows from prefix sums over ranges of lines; a line is cut where a part ends. No task holds more than its range
    of lines and its parts.
    """
    if size % 3 or size <= 0:
        raise ValueError(f"a part has a multiple of three bytes, not {size}")
    header = ",".join(c for c in rows.columns if c != order) + "\n"
    lines = csv_lines(rows, order).select("pos", F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias("bytes"))
    lines = summed(lines.withColumn("n", F.octet_length("bytes")), ["pos"], "n", "at").select("bytes", "n", (F.col("at") + len(header.encode())).alias("at"))
    first = rows.sparkSession.range(1).select(F.encode(F.lit(header), "UTF-8").alias("bytes"), F.lit(len(header.encode())).alias("n"), F.lit(0).cast("long").alias("at"))
    part = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)))
    pieces = first.union(lines).select("bytes", "n", "at", part.alias("part"))
    start = F.greatest(F.col("at"), F.col("part") * size)
    end = F.least(F.col("at") + F.col("n"), (F.col("part") + 1) * size)
    pieces = pieces.select("part", start.alias("at"), F.substring("bytes", (start - F.col("at") + 1).cast("int"), (end - start).cast("int")).alias("piece"))
    # a character of ISO-8859-1 for each byte: text joins fast, and gives the same bytes again
    texts = pieces.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("at", F.decode("piece", "ISO-8859-1").alias("t")))).alias("l"))
    whole = F.encode(F.array_join(F.transform("l", lambda x: x["t"]), ""), "ISO-8859-1")
    return texts.select("part", F.regexp_replace(F.base64(whole), "[\r\n]", "").alias("csv_base64"))


def link(encoded: Column, filename: str) -> Column:
    return F.concat(F.lit('<a href="data:file/csv;base64,'), encoded, F.lit(f'" download="{html.escape(filename)}" class="{_LINK_CLASS}">{_LINK}</a>'))


def export_name(title: str, as_of: dt.date, part: str = "complete") -> str:
    if part not in ("all_long", "all_short", "complete"):
        raise ValueError(part)
    return f"{title}_{as_of}_{part}.csv"


def _head(columns: list[str]) -> str:
    return f'<table class="{_TABLE_CLASS}"><thead><tr>{"".join(f"<th>{html.escape(c)}</th>" for c in columns)}</tr></thead><tbody>'


_FOOT = "</tbody></table>"


def html_rows(cells: DataFrame, marked: tuple[str, ...] = MARKED, keep: dict[str, str] | None = None) -> DataFrame:
    """(line) of a report's rows as HTML; cells of columns that aren't ``marked`` are escaped, nulls are empty.

    Columns to ``keep`` (their names, and those of the result) are no cells.
    """
    keep = keep or {}

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        if name not in marked:
            for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
                text = F.replace(text, F.lit(sign), F.lit(to))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    return cells.select(*[F.col(c).alias(to) for c, to in keep.items()], F.concat(F.lit("<tr>"), *[cell(c) for c in cells.columns if c not in keep], F.lit("</tr>")).alias("line"))


def html_table(cells: DataFrame, marked: tuple[str, ...] = MARKED) -> str:
    """A report as an HTML table. Longer ones are an error here: ``write_html`` writes them."""
    rows = html_rows(cells, marked).limit(RENDERED + 1).collect()
    if len(rows) > RENDERED:
        raise ValueError(f"more than {RENDERED} rows: use write_html")
    return _head(cells.columns) + "".join(r.line for r in rows) + _FOOT


def write_html(cells: DataFrame, path: str, marked: tuple[str, ...] = MARKED) -> tuple[str, str]:
    """Writes the rows of a report of any length as text files, in their order, and returns what goes before and after them."""
    html_rows(cells, marked).write.mode("overwrite").text(path)
    return _head(cells.columns), _FOOT
