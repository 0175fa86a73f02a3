"""Anonymous builds: redacted columns, rewritten pages, and a gate that no listed term survives."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_term, quoted_replacement, text
from ..sources.documents import fresh, with_file
from .terms import find_terms

#: Fixed values.
ANONYMOUS_ORGANIZATION, MAINTAINERS = "Anonymous (this paper)", "maintainers"
ROBOTS = "User-agent: *\nDisallow: /\n"


def redact_board(board: DataFrame, terms: list[str]) -> DataFrame:
    """Organization, links, submitter and notes that hold a term are replaced or emptied; a verified row's submitter always is."""
    organization = F.when(has_term(F.col("organization"), terms), F.lit(ANONYMOUS_ORGANIZATION)).otherwise(F.col("organization"))
    emptied = {c: F.when(has_term(F.col(c), terms), F.lit("")).otherwise(F.col(c)) for c in ("model_url", "source_url", "notes")}
    submitter = F.when((text(F.col("verified")) == "yes") | has_term(F.col("submitted_by"), terms), F.lit(MAINTAINERS)).otherwise(F.col("submitted_by"))
    return board.withColumns({"organization": organization, "submitted_by": submitter, **emptied})


@dataclass(frozen=True)
class Rewrite:
    """A replacement in pages: of a pattern (with groups as $1), or of a literal; first: only the first place; page: only in pages of that name."""

    find: str
    put: str = ""
    literal: bool = False
    first: bool = False
    page: str | None = None

    def of(self, path: Column, body: Column) -> Column:
        put = quoted_replacement(self.put) if self.literal else self.put
        if self.first:
            pattern = re.escape(self.find) if self.literal else self.find
            done = F.regexp_replace(body, rf"(?s)\A(.*?)(?:{pattern})", "$1" + put)
        elif self.literal:
            done = F.replace(body, F.lit(self.find), F.lit(self.put))
        else:
            done = F.regexp_replace(body, self.find, put)
        return done if self.page is None else F.when(F.substring_index(path, "/", -1) == self.page, done).otherwise(body)


def page_rewrites(brand: str, cite: str, main: str) -> list[Rewrite]:
    """The anonymous build's: brand name, citation, submission links and page, and no indexing. Patterns of markup are fixed values."""
    return [
        Rewrite(r'(<a class="brand"[^>]*>\s*<b>[^<]*</b>\s*<span>)[^<]*(</span>)', "$1" + quoted_replacement(brand) + "$2"),
        Rewrite(r'(?s)<section class="block" id="cite">.*?</section>', quoted_replacement(cite)),
        Rewrite('<a class="btn" href="submit.html">Submit a result</a>', literal=True),
        Rewrite(r'\s*<a href="submit.html"[^>]*>Submit</a>'),
        Rewrite("<head>", '<head>\n<meta name="robots" content="noindex, nofollow">', literal=True, first=True),
        Rewrite(r'(?s)<main id="main" class="wrap">.*?</main>', quoted_replacement(f'<main id="main" class="wrap">\n  {main}\n</main>'), page="submit.html"),
    ]


def rewrite(docs: DataFrame, steps: list[Rewrite], pages: str = r"\.html$") -> DataFrame:
    """(path, text) after the steps, in order, in the pages whose path the pattern finds."""
    body = F.col("text")
    for step in steps:
        body = step.of(F.col("path"), body)
    return docs.withColumn("text", F.when(F.col("path").rlike(pages), body).otherwise(F.col("text")))


def leaks(docs: DataFrame, terms: list[str] | DataFrame, name: str = "path", body: str = "text") -> DataFrame:
    """name, line, term and n: how often each term stands in each line, in any case; a term that spans lines counts where it begins. terms: a list, or a table of any length."""
    return find_terms(docs, terms, name, body)


def todo_files(docs: DataFrame) -> DataFrame:
    """Paths of pages and tables that still hold the word TODO; a warning, not a leak."""
    return docs.filter(F.col("path").rlike(r"\.(html|csv)$") & F.contains("text", F.lit("TODO"))).select("path").distinct()


def anonymous_build(docs: DataFrame, steps: list[Rewrite], config: tuple[str, str] = ("assets/config.js", "assets/config.anon.js")) -> DataFrame:
    """The document set of the anonymous build."""
    return with_file(rewrite(fresh(docs, (config[1],), {config[0]: config[1]}), steps), "robots.txt", ROBOTS)


class LeakError(Exception):
    """Some term survived."""


#: Leaks that the message shows; all are in the table.
SHOWN_LEAKS = 1000


def gate(found: DataFrame, table: str | None = None) -> None:
    """Raises LeakError if there is a leak, with their number and the first of them, sorted. table: a path at which all leaks are written as Parquet, before anything is raised."""
    if table:
        found.write.mode("overwrite").parquet(table)
        found = found.sparkSession.read.schema(found.schema).parquet(table)
    rows = found.orderBy(*found.columns).limit(SHOWN_LEAKS + 1).collect()
    if not rows:
        return
    shown = [f"{r[0]}:{r['line']}: '{r['term']}'" for r in rows[:SHOWN_LEAKS]]
    if len(rows) > SHOWN_LEAKS:
        shown.append(f"{found.count()} leaks in all" + (f", in {table}" if table else ""))
    raise LeakError("\n".join(shown))
