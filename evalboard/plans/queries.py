"""Queries on the test tables, by name, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as C
from ..functions import columns as X
from ..operators import notes as N
from ..operators import redact as R
from ..operators import render, scoring, submissions, validate, view
from ..operators.maintained import MaintainedView
from ..operators.ranking import numbered
from ..operators.search import build_index, search
from ..sources.board import read_board, write_board
from ..sources.site import Site
from ..sources.staged import fixed, new_path
from ..sources.submission import read_submissions
from .stand_in import BOARD_SQL, CARDS_SQL, RAW_SQL, SCORED_SQL, answers, board, items, raw_board, scored, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SCORES = (*C.TASKS, "overall", "acc_fs", "miss_rate", "false_flip_rate", "a_rate")


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Scoring.


def _share_sql(hit: str, of: str) -> str:
    return f"case when count(*) filter (where {of}) > 0 then 100.0::double * count(*) filter (where {of} and {hit}) / count(*) filter (where {of}) end"


@query(f"with {SCORED_SQL} select source, {', '.join(_share_sql('correct', f"variant = 'clean' and task = '{t}'") + f' as {t}' for t in C.TASKS)} from scored group by source")
def score_by_task(spark, sf_dir):
    return scoring.task_accuracy(scored(spark, sf_dir), ["source"], list(C.TASKS))


@query(f"""with {SCORED_SQL}, per as (select source, task, count(*) as n, count(*) filter (where correct) as r from scored where variant = 'clean' group by all)
select source, 100.0::double * sum(r) / sum(n) as micro, round(avg(100.0::double * r / n), 6) as macro from per group by source""")
def score_overall_micro_macro(spark, sf_dir):
    return scoring.overall(scored(spark, sf_dir), ["source"]).withColumn("macro", F.round("macro", 6))


@query(f"with {CARDS_SQL} select source, miss_rate, false_flip_rate, acc_fs from cards")
def miss_false_flip_rates(spark, sf_dir):
    return scoring.error_rates(scored(spark, sf_dir), ["source"])


@query(f"with {CARDS_SQL} select source, a_rate from cards")
def a_rate(spark, sf_dir):
    return scoring.a_rate(scored(spark, sf_dir), ["source"])


@query(f"with {CARDS_SQL} select source, {', '.join(SCORES)} from cards")
def scorecard(spark, sf_dir):
    return scoring.scorecard(scored(spark, sf_dir), ["source"], list(C.TASKS)).select("source", *SCORES)


@query(f"with {SCORED_SQL} select source, task, count(*) as n, count(*) filter (where answer is null) as missing, count(*) filter (where correct) as n_right from scored group by all")
def missing_counts_wrong(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("source", "task").agg(F.count("*").alias("n"), F.count_if(F.col("answer").isNull()).alias("missing"), F.count_if("correct").alias("n_right"))


@query(f"""with {SCORED_SQL}, letters as (select unnest(['A', 'B']) as letter)
select letter, variant, count(*) as n, count(*) filter (where key = letter) as n_right from items, letters group by all""")
def constant_answer_baseline(spark, sf_dir):
    key = items(spark, sf_dir)
    both = [scoring.marked(key, scoring.constant_answers(key, letter)).withColumn("letter", F.lit(letter)) for letter in scoring.LETTERS]
    return both[0].unionByName(both[1]).groupBy("letter", "variant").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_right"))


@query(f"""with {SCORED_SQL}, given as (select doc_id as item_id, case when doc_id % 13 = 0 then 'C' when n_chars > 1500 then 'A' else 'B' end as answer from documents where n_chars % 7 <> 0
union all select doc_id, 'A' from documents where doc_id % 11 = 0), per as (select item_id, count(*) as n, bool_or(answer in ('A', 'B')) as valid from given group by item_id)
select count(i.item_id) as items, count(*) filter (where i.item_id is not null and n = 1 and valid) as answered, count(*) filter (where i.item_id is not null and n = 1 and not valid) as invalid,
count(*) filter (where i.item_id is not null and n > 1) as repeated, count(*) filter (where i.item_id is null) as unknown from items i full join per p on i.item_id = p.item_id""")
def answer_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    once = docs.filter("n_chars % 7 <> 0").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 13 == 0, "C").when(F.col("n_chars") > 1500, "A").otherwise("B").alias("answer"))
    given = once.union(docs.filter("doc_id % 11 = 0").select("doc_id", F.lit("A")))
    return scoring.answer_report(items(spark, sf_dir), given)


@query(f"""with {SCORED_SQL} select base_id, {', '.join(f"bool_or(correct) filter (where variant = '{v}') as {v.lower()}" for v in ('clean', 'FLIP', 'STAY'))} from scored group by base_id""")
def variant_pairing(spark, sf_dir):
    return scoring.paired(scored(spark, sf_dir))


@query(f"""with {BOARD_SQL} select t.model, t.method, t.overall - z.overall as delta_overall, t.acc_fs - z.acc_fs as delta_acc_fs, t.notes, z.notes as zero_notes
from board t join board z on t.model = z.model and z.type = 'model' and z.method = 'zero-shot' where t.type = 'model' and t.method <> 'zero-shot'""")
def trained_vs_base_delta(spark, sf_dir):
    return scoring.trained_deltas(board(spark, sf_dir))


_HITS = {**{t: (f"variant = 'clean' and task = '{t}'", "correct") for t in C.TASKS}, "overall": ("variant = 'clean'", "correct"), "miss_rate": ("variant = 'FLIP'", "correct"), "false_flip_rate": ("variant = 'STAY'", "correct"), "a_rate": ("variant = 'clean'", "answer = 'A'")}


def _submission_sql() -> str:
    hits = ", ".join(f"count(*) filter (where {of} and {hit}) as {c}" for c, (of, hit) in _HITS.items())
    totals = ", ".join(f"count(*) filter (where {of}) as {c}" for c, (of, _) in _HITS.items())
    share = lambda c: f"100.0::double * (t.{c} - coalesce(h.{c}, 0)) / t.{c}" if c in C.LOWER_IS_BETTER else f"100.0::double * coalesce(h.{c}, 0) / t.{c}"
    return f"""with {SCORED_SQL}, h as (select source, {hits} from scored group by source), t as (select {totals} from items), s as (select distinct source from documents where n_chars % 7 <> 0),
made as (select source as model, {', '.join(f"case when t.{c} > 0 then {share(c)} end as {c}" for c in _HITS)} from s left join h using (source), t) select *, 100 - (miss_rate + false_flip_rate) / 2 as acc_fs from made"""


@query(_submission_sql())
def many_submissions(spark, sf_dir):
    """An answer file for each source, with what it answers, written, read back and scored against the whole key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    given = answers(spark, sf_dir).join(docs, F.col("item_id") == F.col("doc_id")).select("source", F.to_json(F.struct(F.col("item_id").cast("string").alias("item_id"), "answer")).alias("value"))
    heads = given.select("source").distinct().select("source", F.to_json(F.struct(F.col("source").alias("model"), F.lit("1.0").alias("version"))).alias("value"))
    path = new_path(spark, "submissions")
    given.unionByName(heads).repartition("source").write.partitionBy("source").text(path)
    lines = read_submissions(spark, path)
    made = submissions.scores(lines, items(spark, sf_dir))
    return submissions.file_facts(lines).select("file", "header.model").join(made, "file").select("model", *SCORES)


# Views.

_GROUP = "case when type = 'baseline' then 4 when domain <> 'music' and method = 'zero-shot' then 0 when domain <> 'music' then 1 when method = 'zero-shot' then 2 else 3 end"


def _ranked_sql(where: str, order: str) -> str:
    titles = " ".join(f"when {i} then '{t}'" for i, t in enumerate(C.GROUPS))
    return f"""{BOARD_SQL}, grouped as (select *, {_GROUP} as group_ord from board where {where}),
ranked as (select *, case group_ord {titles} end as group_title, case when type <> 'baseline' then cast(row_number() over (partition by group_ord order by acc_fs is null, acc_fs desc, {order}) as int) end as rank from grouped)"""


@query(f"with {_ranked_sql('true', 'acc_fs is null, acc_fs desc, line')} select line, group_ord, group_title, rank, acc_fs from ranked")
def rank_in_group(spark, sf_dir):
    return view.board_view(board(spark, sf_dir)).select("line", "group_ord", "group_title", "rank", "acc_fs")


@query(f"""with {_ranked_sql("(type = 'baseline' or access = 'open') and (type = 'baseline' or verified = 'yes') and contains(lower(model || ' ' || organization || ' ' || method), 'org')", 'overall is null, overall, line')} select line, group_ord, rank from ranked""")
def rank_after_filter(spark, sf_dir):
    return view.board_view(board(spark, sf_dir), view.ViewParams(sort="overall", ascending=True, query="ORG", access="open", verified_only=True)).select("line", "group_ord", "rank")


@query(f"with {_ranked_sql('true', 'acc_fs is null, acc_fs desc, line')} select line, group_ord, rank, acc_fs from ranked where rank <= 2")
def top_two_in_group(spark, sf_dir):
    return view.top_ranked(board(spark, sf_dir), 2).select("line", "group_ord", "rank", "acc_fs")


@query(f"""with {BOARD_SQL}, changed as (select * replace (case when line % 3 = 0 then acc_fs / 2 else acc_fs end as acc_fs) from board where line % 5 <> 0), grouped as (select *, {_GROUP} as group_ord from changed)
select line, cast(group_ord as int) as group_ord, case when type <> 'baseline' then cast(row_number() over (partition by group_ord order by acc_fs is null, acc_fs desc, line) as int) end as rank, acc_fs from grouped""")
def maintained_view(spark, sf_dir):
    """A ranked table after edits and deletions were merged into it."""
    rows = fixed(board(spark, sf_dir))
    kept = MaintainedView(spark, new_path(spark, "view"))
    kept.apply(come=rows)
    gone = rows.filter("line % 5 = 0 or line % 3 = 0")
    kept.apply(gone, gone.filter("line % 5 <> 0").withColumn("acc_fs", F.col("acc_fs") / 2))
    return kept.rows().select("line", "group_ord", "rank", "acc_fs")


@query(f"with {BOARD_SQL} select line, melody, cast(row_number() over (order by melody is null, melody desc, line) as int) as place from board")
def sort_nan_last_desc(spark, sf_dir):
    rows = board(spark, sf_dir).withColumn("melody", F.coalesce("melody", F.lit(float("nan"))))
    return view.placed(rows, view.ViewParams(sort="melody")).select("line", F.when(~F.isnan("melody"), F.col("melody")).alias("melody"), "place")


@query("""select o_orderkey, o_orderpriority, case when o_orderkey % 9 > 0 then o_totalprice end as price, row_number() over (partition by o_orderpriority order by case when o_orderkey % 9 > 0 then o_totalprice end desc nulls last, o_orderkey) as rank from orders""")
def rank_orders(spark, sf_dir):
    """Five groups of many rows, each dealt out over tasks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")).alias("price"))
    return numbered(o, ["o_orderpriority"], [*X.missing_last(F.col("price"), False), F.col("o_orderkey").asc()])


@query("select l_orderkey, l_linenumber, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) as place from lineitem")
def place_lineitems(spark, sf_dir):
    """One order over all rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return numbered(rows, [], [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()], "place").drop("l_extendedprice")


@query("select p_partkey from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')")
def search_concat(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.contains(X.haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type")), F.lit("brand#1"))).select("p_partkey")


SEARCHED = ("brand#1", "STEEL", "en", "o brand#2")


@query(f"""select q as query, p_partkey from part, (select unnest([{', '.join(f"'{q}'" for q in SEARCHED)}]) as q) where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), lower(q))""")
def indexed_search(spark, sf_dir):
    """Several searches by postings alone."""
    path = new_path(spark, "search")
    build_index(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], path)
    return search(spark, path, SEARCHED).select("query", F.col("key").alias("p_partkey"))


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'P' or o_orderpriority like '1%'")
def filter_exempt_baseline(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderstatus") == "P", "baseline").otherwise("model").alias("type"), F.when(F.startswith("o_orderpriority", F.lit("1")), "open").otherwise("closed").alias("access"))
    return rows.filter(view.shown(view.ViewParams(access="open"))).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("select count(distinct user_id) as models, strftime(max(ts), '%Y-%m-%d') as updated from events where event_type is not null")
def header_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type is not null")
    return view.header_stats(e.select(F.lit("model").alias("type"), F.col("user_id").alias("model"), F.date_format("ts", "yyyy-MM-dd").alias("date")))


@query("select coalesce(arg_min(cast(n_regionkey as double), n_nationkey), 50.0) as chance from nation where n_nationkey % 7 = 3")
def first_match_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 7 == 3, " by Chance").otherwise(""))
    return view.chance_level(n.select(F.lit("baseline").alias("type"), name.alias("model"), F.col("n_regionkey").cast("double").alias("overall"), F.col("n_nationkey").alias("line")))


@query("""with b as (select p_partkey as line, p_partkey % 500 = 0 as base, p_size, p_size % 7 as s from part)
select line from b m where not base and (p_size = 50 or exists (select 1 from b where base and b.p_size = m.p_size and b.s = m.s))""")
def degenerate_rows(spark, sf_dir):
    size = F.col("p_size").cast("double")
    scores = [(size if i % 2 else F.col("p_size") % 7).cast("double").alias(c) for i, c in enumerate(C.REQUIRED_PERCENT)]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 500 == 0, "baseline").otherwise("model").alias("type"), *scores, F.when(F.col("p_size") == 50, 100.0).otherwise(50.0).alias("a_rate"))
    return view.degenerate(rows).select("line")


@query("select n_nationkey, cast(row_number() over (order by lower(n_name), n_nationkey) as int) as place from nation")
def sort_by_name(spark, sf_dir):
    """Names in mixed case, in the order of a Unicode collation."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("line"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.initcap("n_name")).alias("model"))
    return view.placed(rows, view.ViewParams(sort="model", ascending=True)).select("n_nationkey", "place")


@query("""with e as (select user_id, case event_id % 3 when 0 then 'model' when 1 then 'overall' else 'miss_rate' end as key, row_number() over (partition by user_id order by ts, event_id) as n from events),
runs as (select user_id, key, count(*) as clicks, max(n) as last from (select *, n - row_number() over (partition by user_id, key order by n) as run from e) group by user_id, key, run)
select user_id, key as sort, (clicks % 2 = 1) = (key <> 'overall') as ascending from runs qualify row_number() over (partition by user_id order by last desc) = 1""")
def direction_policy(spark, sf_dir):
    """Sort column and direction of each viewer after a row of clicks."""
    key = F.when(F.col("event_id") % 3 == 0, "model").when(F.col("event_id") % 3 == 1, "overall").otherwise("miss_rate")
    return view.clicked_states(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", key.alias("key")), "user_id", ["ts", "event_id"])


def _one_decimal_sql(c: str) -> str:
    return f"case when {c} is null then '—' else printf('%.1f', {c}) end"


@query(f"""with {_ranked_sql('true', 'acc_fs is null, acc_fs desc, line')} select line, coalesce(cast(rank as varchar), '') as rank,
case when model_url <> '' then '<a href="' || replace(model_url, '&', '&amp;') || '">' || model || '</a>' else model end as name,
case when type = 'baseline' then 'Reference line' else organization || case when params_b <> '' then ', ' || params_b || 'B' else '' end end as meta,
case when type = 'baseline' then '' else access || case when verified <> 'yes' then ',self-reported' else '' end end as tags, case when type = 'baseline' then '' else notes end as note, case when type = 'baseline' then notes else '' end as tooltip,
coalesce(overall, 0) as overall_width, {_one_decimal_sql("round(overall)")} as overall from ranked""")
def row_to_document_text(spark, sf_dir):
    rows = view.ranked(board(spark, sf_dir)).withColumn("_width", F.coalesce("overall", F.lit(0.0)))
    made = render.cells(rows.withColumn("overall", F.round("overall")))
    width = rows.select("line", F.col("_width").alias("overall_width"))
    return made.drop("overall_width").join(width, "line").select("line", "rank", "name", "meta", F.array_join("tags", ",").alias("tags"), "note", "tooltip", "overall_width", "overall")


# Rules.


def _number_sql(c: str) -> str:
    parsed = f"case when regexp_full_match({c}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') then try_cast(trim({c}) as double) end"
    return f"case when {parsed} between 0 and 100 then {parsed} end as n_{c}"


_BROKEN = {
    "R01": "type not in ('model', 'baseline')", "R02": "verified not in ('yes', 'no')", "R03": "trim(model) = ''", "R04": "n_melody is null", "R05": "n_rhythm is null", "R06": "n_timbre is null",
    "R07": "n_harmony is null", "R08": "n_overall is null", "R09": "n_acc_fs is null", "R10": "n_miss_rate is null", "R11": "n_false_flip_rate is null", "R12": "a_rate <> '' and n_a_rate is null",
    "R13": "abs((n_melody + n_rhythm + n_timbre + n_harmony) / 4 - n_overall) > 0.1", "R14": "abs(100 - (n_miss_rate + n_false_flip_rate) / 2 - n_acc_fs) > 0.1",
    "R15": "type = 'model' and access not in ('open', 'closed')", "R16": "type = 'model' and domain not in ('general', 'music')", "R17": "type = 'model' and readout not in ('logprob', 'generated')",
    "R18": "type = 'model' and trim(method) = ''", "R19": "type = 'model' and params_b <> '' and not regexp_full_match(params_b, '[0-9]+(\\.[0-9]+)?')", "R20": "type = 'model' and source_url = '' and verified = 'no'",
    "R21": "not (regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(date as date) is not null)", "R22": "benchmark_version <> '1.0'", "R23": "turn > 1",
}


@query(f"""with {RAW_SQL}, parsed as (select *, {', '.join(_number_sql(c) for c in C.PERCENT)}, row_number() over (partition by model, method, benchmark_version order by line) as turn from raw)
""" + " union all ".join(f"select line, cast({i} as int) as ord, '{name}' as rule from parsed where {test}" for i, (name, test) in enumerate(_BROKEN.items())))
def board_violations(spark, sf_dir):
    """The contract's own list of rules, R01 to R23, on records that break each."""
    return validate.violations(raw_board(spark, sf_dir)).select("line", "ord", "rule")


@query("select p_partkey, p_name as kept, p_size % 5 = 0 as is_blank from part")
def strip_blank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.stripped(F.concat(F.lit(" \t\u00a0"), "p_name", F.lit("\n "))).alias("kept"), X.blank(F.when(F.col("p_size") % 5 == 0, "\t \u2003").otherwise(F.col("p_name"))).alias("is_blank"))


def _marks(rows: DataFrame, keys: list[str], *checked: validate.Rule) -> DataFrame:
    return validate.broken_rules(rows, list(checked), keys).select(*keys, "rule")


@query("select o_orderkey, 'status' as rule from orders where coalesce(o_orderstatus, '') not in ('O', 'F') union all select o_orderkey, 'priority' from orders where coalesce(o_orderpriority, '') not in ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def enum_violations(spark, sf_dir):
    status = validate.Rule("status", ~X.among(F.col("o_orderstatus"), ("O", "F")), F.lit(""))
    priority = validate.Rule("priority", ~X.among(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH", "3-MEDIUM")), F.lit(""))
    return _marks(table(spark, sf_dir, "orders"), ["o_orderkey"], status, priority)


@query("select c_custkey, 'balance' as rule from customer where not coalesce(c_acctbal / 100 between 0 and 100, false)")
def range_violations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return _marks(c, ["c_custkey"], validate.Rule("balance", X.percent((F.col("c_acctbal") / 100).cast("string")).isNull(), F.lit("")))


@query("select l_orderkey, l_linenumber, 'mean' as rule from lineitem where abs((l_quantity + l_discount + l_tax + l_linenumber) / 4 - l_quantity / 4) > 0.75")
def mean_tolerance(spark, sf_dir):
    mean = X.mean(*[F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")])
    return _marks(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], validate.Rule("mean", X.differs(mean, F.col("l_quantity") / 4, 0.75), F.lit("")))


@query("select l_orderkey, l_linenumber, 'identity' as rule from lineitem where abs(100 - (l_quantity + l_linenumber) / 2 - 85) > 10")
def identity_tolerance(spark, sf_dir):
    derived = X.combined(F.col("l_quantity"), F.col("l_linenumber"))
    return _marks(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], validate.Rule("identity", X.differs(derived, F.lit(85), 10), F.lit("")))


@query("select s_suppkey, 'required' as rule from supplier where s_acctbal < 0 and coalesce(case when s_nationkey % 2 = 0 then s_name else '' end, '') = ''")
def conditional_required(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("url", F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).otherwise(""))
    return _marks(s, ["s_suppkey"], validate.Rule("required", (F.col("s_acctbal") < 0) & (X.text(F.col("url")) == ""), F.lit("")))


@query("select p_partkey, regexp_full_match(substr(p_brand, 7) || '.' || p_size, '[0-9]+(\\.[0-9]+)?') as with_point, regexp_full_match(p_brand, '[0-9]+(\\.[0-9]+)?') as brand, regexp_full_match(cast(p_size as varchar), '[0-9]+(\\.[0-9]+)?') as size from part")
def regex_fullmatch(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.decimal_text(F.concat(F.substring("p_brand", 7, 99), F.lit("."), F.col("p_size").cast("string"))).alias("with_point"), X.decimal_text(F.col("p_brand")).alias("brand"), X.decimal_text(F.col("p_size").cast("string")).alias("size"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then cast(o_orderdate as date) end as day from orders")
def date_parse(spark, sf_dir):
    i = F.col("o_orderkey") % 3
    written = F.when(i == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(i == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lit("32")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.iso_date(written).alias("day"))


@query("select doc_id from (select doc_id, row_number() over (partition by coalesce(text, ''), coalesce(lang, '') order by doc_id) as n from documents) where n > 1")
def duplicate_key(spark, sf_dir):
    return validate.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ("text", "lang"), "doc_id").filter("_again").select("doc_id")


@query("""select l_orderkey, l_linenumber, r.ord, r.rule from (select l_orderkey, l_linenumber, unnest(list_filter([
case when l_returnflag <> 'N' then {'ord': 0, 'rule': 'flag'} end, case when l_quantity > 45 then {'ord': 1, 'rule': 'quantity'} end, case when l_discount > 0.08 then {'ord': 2, 'rule': 'discount'} end], lambda x: x is not null)) as r from lineitem)""")
def violations_long(spark, sf_dir):
    checked = [validate.Rule(n, c, F.lit("")) for n, c in (("flag", F.col("l_returnflag") != "N"), ("quantity", F.col("l_quantity") > 45), ("discount", F.col("l_discount") > 0.08))]
    return validate.broken_rules(table(spark, sf_dir, "lineitem"), checked, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "ord", "rule")


# Redaction.


@query("""select c_custkey, case when contains(lower(c_mktsegment), 'auto') then 'Anonymous (this paper)' else c_mktsegment end as organization, case when contains(lower(c_name), '7') then '' else c_name end as notes,
case when c_acctbal > 0 or contains(lower(c_name), '7') or contains(lower(c_name), 'auto') then 'maintainers' else c_name end as submitted_by from customer""")
def redact_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    made = c.select("c_custkey", F.col("c_mktsegment").alias("organization"), F.lit("").alias("model_url"), F.lit("").alias("source_url"), F.col("c_name").alias("notes"), F.col("c_name").alias("submitted_by"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("verified"))
    return R.redact_board(made, ["AUTO", "7"]).select("c_custkey", "organization", "notes", "submitted_by")


#: Rewrites of the test pages.
PAGE_STEPS = [R.Rewrite(r"(<title>)[^<]*(</title>)", "$1Anonymous page$2"), R.Rewrite(r"(?s)<footer>.*?</footer>", "<footer></footer>"), R.Rewrite(r"(?s)<script>.*?</script>"), R.Rewrite("<head>", '<head><meta name="robots" content="noindex">', literal=True, first=True)]


@query("""select page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(<title>)[^<]*(</title>)', '\\1Anonymous page\\2', 'g'), '<footer>.*?</footer>', '<footer></footer>', 'gs'), '<script>.*?</script>', '', 'gs'), '<head>', '<head><meta name="robots" content="noindex">')) as digest from pages""")
def rewrite_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("page.html").alias("path"), F.col("html").alias("text"))
    return R.rewrite(pages, PAGE_STEPS).select("page_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""select c_custkey, case when c_mktsegment ilike '%auto%' then '' else 'https://' || c_mktsegment || '.example' end as source_url, case when c_custkey % 3 = 0 then '' else 'https://m/' || c_custkey end as model_url from customer""")
def blank_links(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    model = F.concat(F.when(F.col("c_custkey") % 3 == 0, "https://AUTO/").otherwise("https://m/"), F.col("c_custkey").cast("string"))
    made = c.select("c_custkey", F.lit("").alias("organization"), model.alias("model_url"), F.concat(F.lit("https://"), "c_mktsegment", F.lit(".example")).alias("source_url"), F.lit("").alias("notes"), F.lit("").alias("submitted_by"), F.lit("no").alias("verified"))
    return R.redact_board(made, ["auto"]).select("c_custkey", "source_url", "model_url")


#: A site's page for each test page, as SQL that Spark and DuckDB read alike.
_PATH = "case page_id % 3 when 0 then concat('p', page_id, '/submit.html') when 1 then concat(page_id, '.html') else concat(page_id, '.js') end"
_BODY = """concat('<head><head>', '<a class="brand" href="x">', chr(10), ' <b>B', page_id, '</b> <span>Lab ', page_id, '</span></a><section class="block" id="cite">a', chr(10), page_id, '</section> <section class="block" id="cite"></section>',
'<a class="btn" href="submit.html">Submit a result</a>', chr(10), '  <a href="submit.html" class="y">Submit</a>', '<main id="main" class="wrap">', url, chr(10), '</main><a href="submit.html">Other</a>')"""


@query(f"""with site as (select {_PATH} as path, {_BODY} as text from pages),
s1 as (select path, regexp_replace(text, '(<a class="brand"[^>]*>\\s*<b>[^<]*</b>\\s*<span>)[^<]*(</span>)', '\\1No$body\\2', 'g') as made, text from site),
s2 as (select path, replace(regexp_replace(made, '<section class="block" id="cite">.*?</section>', '<p>later</p>', 'gs'), '<a class="btn" href="submit.html">Submit a result</a>', '') as made, text from s1),
s3 as (select path, regexp_replace(regexp_replace(made, '\\s*<a href="submit.html"[^>]*>Submit</a>', '', 'g'), '<head>', '<head>' || chr(10) || '<meta name="robots" content="noindex, nofollow">') as made, text from s2),
s4 as (select path, case when path like '%/submit.html' then regexp_replace(made, '<main id="main" class="wrap">.*?</main>', '<main id="main" class="wrap">' || chr(10) || '  closed' || chr(10) || '</main>', 'gs') else made end as made, text from s3)
select path, md5(case when path like '%.html' then made else text end) as digest from s4 union all select 'robots.txt', md5('User-agent: *' || chr(10) || 'Disallow: /' || chr(10))""")
def anonymous_pages(spark, sf_dir):
    """Every rewrite of the anonymous build, on pages that hold what each looks for, and the file for robots."""
    docs = table(spark, sf_dir, "pages").selectExpr(f"{_PATH} as path", f"{_BODY} as text")
    return R.anonymous_build(docs, R.page_rewrites("No$body", "<p>later</p>", "closed")).select("path", F.md5(F.col("text").cast("binary")).alias("digest"))


LEAK_TERMS = ["apache", "License", "mit license"]
_LINES_SQL = f"""lines as (select doc_id, cast(unnest(range(1, len(string_split(text, chr(10))) + 1)) as int) as line, lower(unnest(string_split(text, chr(10)))) as content from documents where text is not null),
terms as (select unnest([{', '.join(f"'{t}'" for t in LEAK_TERMS)}]) as term),
leaks as (select doc_id, line, term, cast((length(content) - length(replace(content, lower(term), ''))) / length(term) as int) as n from lines, terms where contains(content, lower(term)))"""


@query(f"with {_LINES_SQL} select * from leaks")
def leak_scan_lines(spark, sf_dir):
    return R.leaks(table(spark, sf_dir, "documents"), LEAK_TERMS, "doc_id")


@query(f"with {_LINES_SQL} select term, count(*) as n_lines, count(distinct doc_id) as docs, cast(sum(n) as bigint) as hits from leaks group by term")
def leak_gate_summary(spark, sf_dir):
    return R.leaks(table(spark, sf_dir, "documents"), LEAK_TERMS, "doc_id").groupBy("term").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("docs"), F.sum("n").alias("hits"))


@query("""with terms as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) as term from benchmark),
lines as (select doc_id, cast(unnest(range(1, len(string_split(text, chr(10))) + 1)) as int) as line, lower(unnest(string_split(text, chr(10)))) as content from documents where text is not null)
select doc_id, line, term, cast((length(content) - length(replace(content, lower(term), ''))) / length(term) as int) as n from lines, terms where contains(content, lower(term))""")
def leak_scan_table(spark, sf_dir):
    """Terms from a table: the benchmark's long words."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("term"))
    return R.leaks(table(spark, sf_dir, "documents"), terms, "doc_id")


GATED = ["apache", "MIT License", "no such term"]


@query("select term, count(*) filter (where contains(lower(text), lower(term))) = 0 as passes from documents, (select unnest(['apache', 'MIT License', 'no such term']) as term) group by term")
def gate_verdict(spark, sf_dir):
    """Whether a build of the documents would pass the gate with each term alone."""
    docs = table(spark, sf_dir, "documents")
    found = R.leaks(docs, GATED, "doc_id").groupBy("term").agg(F.count("*").alias("n"))
    terms = docs.limit(1).select(F.explode(F.array(*[F.lit(t) for t in GATED])).alias("term"))
    return terms.join(found, "term", "left").select("term", F.col("n").isNull().alias("passes"))


@query("select distinct 'p' || (page_id % 50) || '.html' as path from pages where page_id % 4 <> 0 and contains(html, 'nav')")
def todo_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), (F.col("page_id") % 50).cast("string"), F.when(F.col("page_id") % 4 == 0, ".js").otherwise(".html")).alias("path"), F.replace(F.replace("html", F.lit("TODO"), F.lit("")), F.lit("nav"), F.lit("TODO")).alias("text"))
    return R.todo_files(p)


@query("""select page_id, case when page_id % 10 = 3 then md5(html || ' changed') else md5(html) end as digest from pages where page_id % 10 <> 7""")
def site_versions(spark, sf_dir):
    """Pages published twice: of the second version one in ten is changed and one in ten is gone; only the changed ones are written."""
    site = Site(spark, new_path(spark, "site"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("text"), "page_id")
    site.publish(pages.select("path", "text"))
    changed = F.when(F.col("page_id") % 10 == 3, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    site.publish(pages.filter("page_id % 10 <> 7").select("path", changed.alias("text")))
    return site.documents().select(F.substring("path", 3, 20).cast("long").alias("page_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""with {RAW_SQL} select row_number() over (order by raw.line) + 1 as line, nullif(model, '') as model, md5('a,"' || model || '"' || chr(10) || chr(13) || chr(10) || ' x') as digest from raw""")
def csv_read_back(spark, sf_dir):
    """A table with quotes and line ends in its cells, written in order by many tasks and read back from splits of any place."""
    rows = raw_board(spark, sf_dir).withColumn("notes", F.concat(F.lit('a,"'), "model", F.lit('"\n\r\n x')))
    path = new_path(spark, "table")
    write_board(rows, path)
    return read_board(spark, path).select("line", "model", F.md5(F.col("notes").cast("binary")).alias("digest"))


# Notes.


@query("""with n as (select vec_id, list_transform(embedding, lambda x, i: case when i = 5 then 1.0::double else x * 0.8::double end) as v from embeddings)
select vec_id, round(list_sum(v), 5) as total, len(v) as size, v[5] as fifth, list_contains([0, 4], vec_id % 8) as changed from n""")
def note_transform(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    notes = F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("onset"), i.alias("pitch"), F.lit(1.0).alias("dur")))
    moved = N.replaced(N.scaled(notes, "pitch", 0.8), 4, F.struct(F.lit(1.0).alias("onset"), F.lit(4).alias("pitch"), F.lit(1.0).alias("dur")))
    rows = e.select("vec_id", moved.alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["onset"]), 5).alias("total"), F.size("v").cast("long").alias("size"), F.element_at("v", 5)["onset"].alias("fifth"), F.array_contains(F.array(F.lit(0), F.lit(4)), (F.col("vec_id") % 8).cast("int")).alias("changed"))


@query("select r_regionkey, b as bar, 44 + b * (520 - 44 - 12) / 16.0::double as x from region, (select cast(unnest(range(4, 13, 4)) as int) as b)")
def bar_sequence(spark, sf_dir):
    bars = F.explode(F.sequence(F.lit(N.BAR), F.lit(N.STEPS - N.BAR), F.lit(N.BAR)))
    return table(spark, sf_dir, "region").select("r_regionkey", bars.alias("bar")).withColumn("x", N.x_of(F.col("bar")))


def _clips(spark, sf_dir):
    return N.clips_of(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"))


_PITCHES = "pitches as (select vec_id, list_transform(embedding[1:12], lambda x: cast(((floor(x::double * 100) % 13) + 13) % 13 as int)) as p from embeddings)"


@query(f"""with {_PITCHES}, lanes as (select unnest([0, 1]) as lane), notes as (select vec_id, lane, 'melody' as part, i, 2.0::double * i as t, p[i + 1] as pitch, 2.0::double as d from pitches, lanes, (select unnest(range(8)) as i)
union all select vec_id, lane, 'chords', i // 2, 8.0::double * (i // 2), p[9 + i], 8.0::double from pitches, lanes, (select unnest(range(4)) as i)), scaled as (select *, case when lane = 1 then {N.TEMPO}::double else 1 end as s from notes)
select vec_id, cast(lane as int) as lane, part, cast(i as int) as i, pitch, round(44 + t * s * 29 + 2, 6) as x, round(4 + lane * 168 + (12 - pitch) * (150 / 13.0::double) + 0.5, 6) as y, round(d * s * 29 - 4, 6) as width, lane = 1 as changed from scaled""")
def note_rectangles(spark, sf_dir):
    """Both clips of each vector, the second one faster, as drawn."""
    made = N.rectangles(N.pair(_clips(spark, sf_dir), "rhythm", ("vec_id",)), ("vec_id",))
    return made.select("vec_id", "lane", "part", "i", "pitch", *[F.round(c, 6).alias(c) for c in ("x", "y", "width")], "changed")


@query("select vec_id, attribute, change from embeddings, (values " + ", ".join(f"('{a}', '{v}')" for a, values in N.GRID.items() for v in values) + ") t(attribute, change)")
def item_grid(spark, sf_dir):
    return N.items_of(table(spark, sf_dir, "embeddings"), "vec_id")


@query(f"""with {_PITCHES} select vec_id, attribute, timbre, melody_changes, chord_changes, question, case attribute when 'melody' then list_sum(p[1:8]) - p[5] + 12 else list_sum(p[1:8]) end::bigint as melody_pitches from pitches,
(values ('melody', false, 1, 0, 'Same or different melody?'), ('rhythm', false, 8, 2, 'Which clip is faster?'), ('timbre', true, 8, 2, 'Same or different timbre?'), ('harmony', false, 0, 1, 'Same or different harmony?')) t(attribute, timbre, melody_changes, chord_changes, question)""")
def attribute_questions(spark, sf_dir):
    """What differs in the second clip of each vector and attribute, and what is asked."""
    first, made = _clips(spark, sf_dir), None
    for attribute in N.GRID:
        pitches = F.aggregate("melody", F.lit(0).cast("long"), lambda a, n: a + n["pitch"])
        b = N.variant(first, attribute, ("vec_id",)).select("vec_id", F.lit(attribute).alias("attribute"), "timbre", F.size("changed_melody").alias("melody_changes"), F.size("changed_chords").alias("chord_changes"), N.question(F.lit(attribute)).alias("question"), pitches.alias("melody_pitches"))
        made = b if made is None else made.unionByName(b)
    return made
