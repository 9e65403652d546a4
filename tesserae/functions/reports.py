"""Small reports: markdown tables out of aggregates, and HTML pages made ready for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(table: DataFrame, order: str) -> DataFrame:
    """One row `value`: the table of strings as markdown, its rows in order.  For aggregates of a few rows."""
    names = table.columns
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *names), F.lit(" |"))
    rows = table.agg(F.sort_array(F.collect_list(F.struct(order, row.alias("line")))).alias("rows"))
    head = f"| {' | '.join(names)} |\n|{'-|' * len(names)}"
    return rows.select(F.concat_ws("\n", F.lit(head), F.transform("rows", lambda r: r["line"])).alias("value"))


def html_parts(html: Column) -> dict[str, Column]:
    """Linked assets, words without tags, tables in a wrapper, and coloured lines of a diff."""
    words = F.filter(F.split(F.regexp_replace(html, "<[^>]*>", " "), "[ \t\n\r]+"), lambda w: w != "")
    wrapped = F.replace(F.replace(html, F.lit("<table"), F.lit('<div class="wide"><table')), F.lit("</table>"), F.lit("</table></div>"))
    marked = F.filter(F.split(html, "\n"), lambda s: F.substring(s, 1, 1).isin("+", "-"))
    colour = lambda s: F.concat(F.lit('<span class="'), F.when(s.startswith("+"), "added").otherwise("removed"), F.lit('">'), s, F.lit("</span>"))
    return {
        "links": F.sort_array(F.array_distinct(F.regexp_extract_all(html, F.lit('(?:href|src)="([^"]+)"'), 1))),
        "n_words": F.size(words).cast("long"), "wrapped": F.sha2(wrapped, 256), "coloured": F.transform(marked, colour),
    }
