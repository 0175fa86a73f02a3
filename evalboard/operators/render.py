"""Ranked rows as text: cells of a table, table rows, page footers."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import PERCENT, TASKS
from ..functions.columns import html, one_decimal, text
from .view import is_baseline


@dataclass(frozen=True)
class SiteConfig:
    """footer_parts: templates of the footer's sentences, over the other fields and `lab_link`, `source_link` and `mail_link`; one with an empty field is left out."""

    title: str = "Board"
    version: str = "1.0"
    lab: str = ""
    lab_url: str | None = None
    csv_path: str = "leaderboard.csv"
    csv_source_url: str | None = None
    repository: str | None = None
    contact: str | None = None
    anonymous: bool = False
    footer_parts: tuple[str, ...] = ("{title} v{version}", "{lab_link}", "Table: {source_link}", "{mail_link}")

    def footer(self) -> str:
        source = self.csv_source_url or (f"{self.repository}/blob/main/{self.csv_path}" if self.repository else None)
        fields = {k: v or "" for k, v in vars(self).items()} | {
            "lab_link": f'<a href="{self.lab_url}">{self.lab}</a>' if self.lab_url and self.lab else self.lab,
            "source_link": f'<a href="{source}">{self.csv_path}</a>' if source else "",
            "mail_link": f'<a href="mailto:{self.contact}">{self.contact}</a>' if self.contact else "",
        }
        whole = [p for p in self.footer_parts if all(fields[name] for _, name, _, _ in Formatter().parse(p) if name)]
        return " · ".join(p.format(**fields) for p in whole)

    def link(self, name: str) -> str | None:
        """The URL of a link; None hides it."""
        return getattr(self, name, None) or None


def cells(rows: DataFrame, chance: Column | None = None) -> DataFrame:
    """The display columns of each row of ranked(): strings, tags, bar widths and colours."""
    base = is_baseline()
    name = html(text(F.col("model")))
    linked = F.when(text(F.col("model_url")) != "", F.concat(F.lit('<a href="'), html(F.col("model_url")), F.lit('">'), name, F.lit("</a>"))).otherwise(name)
    size = F.concat(F.nullif(F.col("params_b").cast("string"), F.lit("")), F.lit("B"))
    meta = F.when(base, F.lit("Reference line")).otherwise(F.concat_ws(", ", F.nullif(F.col("organization"), F.lit("")), size))
    tags = F.when(base, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.col("access"), F.when(text(F.col("verified")) != "yes", F.lit("self-reported")))))
    source = F.when(text(F.col("source_url")) != "", F.concat(F.lit('<a href="'), html(F.col("source_url")), F.lit('">source</a>'))).otherwise(F.lit(""))
    widths = {f"{c}_width": F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in (*TASKS, "overall", "acc_fs")}
    return rows.select(
        "group_ord", "group_title", "line", F.coalesce(F.col("rank").cast("string"), F.lit("")).alias("rank"), linked.alias("name"), meta.alias("meta"), tags.alias("tags"), source.alias("source"),
        F.when(base, F.lit("")).otherwise(text(F.col("notes"))).alias("note"), F.when(base, text(F.col("notes"))).otherwise(F.lit("")).alias("tooltip"), html(text(F.col("method"))).alias("method"),
        *[one_decimal(F.col(c)).alias(c) for c in PERCENT], *[w.alias(k) for k, w in widths.items()], (chance if chance is not None else F.lit(50.0)).alias("tick"),
    )


def _element(name: str, body: Column, **attributes: str | Column) -> Column:
    """An element of the table; a null attribute is left out."""
    marks = [F.coalesce(F.concat(F.lit(f' {k.rstrip("_")}="'), F.lit(v) if isinstance(v, str) else v, F.lit('"')), F.lit("")) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *marks, F.lit(">"), body, F.lit(f"</{name}>"))


def _where(test: Column, made: Column) -> Column:
    return F.when(test, made).otherwise(F.lit(""))


def bar_cell(column: str) -> Column:
    """A score with its bar, whose colour, width and chance tick are style variables."""
    style = F.concat(F.lit(f"--c:{bar_colour(column)};--chance:"), F.col("tick").cast("string"), F.lit("%"))
    bar = _element("div", _element("i", F.lit(""), style=F.concat(F.lit("width:"), F.col(f"{column}_width").cast("string"), F.lit("%"))), class_="bar")
    return _element("td", _element("div", F.concat(_element("span", F.col(column)), bar), class_="score"), class_="num" if column in TASKS else "num overall", style=style)


def table_rows(shown: DataFrame) -> DataFrame:
    """(group_ord, line, html): one table row for each row of cells(): rank, model with its facts, note and tags, method, scores with bars, plain rates. Class names are fixed values."""
    reference = F.size("tags") == 0
    tag = lambda t: F.when(t == "self-reported", _element("span", html(t), class_="tag self", title=SELF_REPORTED)).otherwise(_element("span", html(t), class_="tag"))
    facts = _element("small", F.concat(html(F.col("meta")), _where(F.col("source") != "", F.concat(F.lit(" "), F.col("source")))))
    note = _where(F.col("note") != "", _element("small", html(F.col("note")), class_="note"))
    tags = _where(~reference, _element("div", F.array_join(F.transform("tags", tag), ""), class_="tags"))
    model = _element("td", F.concat(_element("b", F.col("name")), facts, note, tags), class_="model", title=F.when(F.col("tooltip") != "", html(F.col("tooltip"))))
    scores = [bar_cell(c) for c in (*TASKS, "overall", "acc_fs")]
    rates = [_element("td", _element("span", F.col(c)), class_="num plain") for c in ("miss_rate", "false_flip_rate", "a_rate")]
    row = _element("tr", F.concat(_element("td", F.col("rank"), class_="rank"), model, _element("td", F.col("method"), class_="method"), *scores, *rates), class_=F.when(reference, "baseline"))
    return shown.select("group_ord", "line", row.alias("html"))


def table_html(shown: DataFrame, place: str = "place") -> DataFrame:
    """(group_ord, place, html) of the whole table, to be read in that order: a heading before each group that has rows, then its rows by `place`."""
    headings = shown.select("group_ord", "group_title").distinct()
    made = headings.select("group_ord", F.lit(0).cast("long").alias(place), F.concat(F.lit(f'<tr class="group"><th scope="colgroup" colspan="{SHOWN_COLUMNS}">'), html(F.col("group_title")), F.lit("</th></tr>")).alias("html"))
    rows = table_rows(shown).join(shown.select("line", F.col(place).cast("long").alias(place)), "line").select("group_ord", place, "html")
    return made.unionByName(rows)


def bar_colour(column: str) -> str:
    """Style variable of a score's bar: a task's own, else ink."""
    return f"var(--{column})" if column in TASKS else "var(--ink)"


#: Columns of the table.
SHOWN_COLUMNS = 12
#: What a reader is told about results that nobody has repeated.
SELF_REPORTED = "Reported by its authors; not repeated yet"


def empty_row(columns: int = SHOWN_COLUMNS) -> str:
    """What the table shows where no row passes the filters."""
    return f'<tr><td colspan="{columns}" class="empty">No row passes these filters.</td></tr>'
