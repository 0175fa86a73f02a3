"""Commands: check a result table, score a submission, build the public and the anonymous site."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.redact import LeakError, anonymous_build, gate, leaks, page_rewrites, redact_board, todo_files
from .operators.scoring import answer_report, board_row
from .operators.validate import annotations, misshapen, validate, violations
from .sources.board import read_board, write_board
from .sources.documents import fresh, read_documents, write_tree
from .sources.submission import read_submission

#: Lines of a submission that are shown as malformed; their number always is.
SHOWN = 20
TABLE, CONFIG = "leaderboard.csv", ("assets/config.js", "assets/config.anon.js")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="evalboard", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="report every violation of the contract")
    check.add_argument("file")
    score = commands.add_parser("score", help="a submission as a record of the table, checked against the contract")
    score.add_argument("submission", help="JSON Lines")
    score.add_argument("key", help="CSV: item_id, task, variant, key")
    score.add_argument("out", help="CSV of one record")
    score.add_argument("--set", action="append", default=[], metavar="COLUMN=VALUE", help="what the submission does not say")
    public = commands.add_parser("build", help="the site's tree with the table")
    build = commands.add_parser("anonymize", help="the same without identities; fails if a term survives")
    for p in (public, build):
        p.add_argument("site")
        p.add_argument("csv")
        p.add_argument("out")
    build.add_argument("--term", action="append", default=[], required=True)
    build.add_argument("--brand", default="Anonymous", help="name on the pages")
    build.add_argument("--cite", default="", help="markup in place of the citation")
    build.add_argument("--main", default="", help="markup in place of the submission page's body")
    return parser


def printed(lines: DataFrame) -> int:
    found = 0
    for line in lines.toLocalIterator():
        found = 1
        print(line[0])
    return found


def score(spark: SparkSession, given: argparse.Namespace) -> int:
    header, answers, rest = read_submission(spark, given.submission)
    key = spark.read.option("header", True).csv(given.key)
    for name, n in answer_report(key, answers).first().asDict().items():
        print(f"{name}: {n}")
    n = rest.count()
    for row in rest.limit(SHOWN).collect():
        print(f"::warning::neither header nor answer: {row[0]}")
    if n > SHOWN:
        print(f"::warning::{n} lines are neither header nor answer")
    if header.count() != 1:
        print(f"::error file={given.submission}::a submission has one header, this one has {header.count()}")
        return 1
    row = board_row(header, answers, key, dict(x.split("=", 1) for x in given.set))
    write_board(row, given.out)
    return printed(annotations(violations(row.selectExpr("*", "2 as line")).orderBy("ord"), given.out))


def anonymize(spark: SparkSession, given: argparse.Namespace) -> int:
    redacted = f"{given.out}-table"
    write_board(redact_board(read_board(spark, given.csv), given.term), redacted)
    pages = anonymous_build(read_documents(spark, given.site), page_rewrites(given.brand, given.cite, given.main), CONFIG)
    table = read_documents(spark, redacted, "part-*").selectExpr(f"'{TABLE}' as path", "text")
    write_tree(pages.filter(f"path <> '{TABLE}'").unionByName(table), given.out)
    built = read_documents(spark, given.out)
    for row in todo_files(built).orderBy("path").toLocalIterator():
        print(f"::warning::TODO left in {row['path']}")
    try:
        gate(leaks(built, given.term), f"{given.out}-leaks")
    except LeakError as e:
        print(f"::error::identifying terms remain\n{e}")
        return 1
    return 0


def main(args: list[str] | None = None) -> int:
    given = arguments().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.command == "check":
        printed(annotations(misshapen(read_board(spark, given.file, bad=True)), given.file, "warning"))
        return printed(annotations(validate(spark, given.file), given.file))
    if given.command == "score":
        return score(spark, given)
    if given.command == "build":
        write_tree(fresh(read_documents(spark, given.site), (CONFIG[1],)), given.out, {TABLE: given.csv})
        return 0
    return anonymize(spark, given)


if __name__ == "__main__":
    sys.exit(main())
