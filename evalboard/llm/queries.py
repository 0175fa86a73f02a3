"""Queries over the whole documents table, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import KMeans, clustered
from .collocations import Collocations, collocations
from .langid import held_out, identify, train
from .licenses import PHRASES, TEMPLATES, bytes_words, scan_licenses
from .linededup import LinePlan, dedup_lines
from .media import parse_sequences, text_media
from .minhash import MinHashPlan, near_duplicates
from .mixing import MixPlan, mix
from .packing import pack_documents
from .postings import contamination
from .quality import QualityRules, repetition_quality
from .sharding import shard_by_slots
from .tokenfile import token_files


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), MinHashPlan(words=3, percent=85, bands=44))


#: One word in ten may differ; lines of under ten words are compared by bytes.
LINES = LinePlan(edits=2, min_bytes=24, equal_short=True, words_per_edit=10)


def op2_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", F.size(F.split(whole, "\n", -1)).cast("long").alias("n_lines"), F.octet_length(whole).alias("n_bytes"), "text")
    cleaned = dedup_lines(docs, LINES)
    body = whole.cast("binary")
    return cleaned.select("doc_id", "n_lines", F.octet_length(body).cast("long").alias("kept_bytes"), F.crc32(body).alias("kept_crc32"), (F.col("n_bytes") - F.octet_length(body)).cast("long").alias("dropped_bytes"))


def op3_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)


def op4_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shard_by_slots(documents(spark, sf_dir), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


#: Domains are groups of sources; these sources are a domain's own, all others are "web".
DOMAINS = {"books": ("src1", "src2", "src3"), "code": ("src4", "src5"), "reference": ("src6", "src7", "src8", "src9")}


def domain() -> str:
    """The domain of a document, by its source, in SQL."""
    return "case " + " ".join(f"when source in ({', '.join(repr(s) for s in sources)}) then '{name}'" for name, sources in DOMAINS.items()) + " else 'web' end"


def tree_plan(budget_percent: int = 60) -> MixPlan:
    weights = {"domain": {"web": 4, "books": 3, "code": 1, "reference": 2}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}}
    return MixPlan((("domain", domain()), ("language", "lang"), ("origin", "source")), weights, budget_percent=budget_percent)


def op5_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), tree_plan()).select("doc_id", "domain", "language", "origin", "tokens", "epoch")


def op6_patched_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=1)


def op7_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op8_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))


def pages_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser of op8 on every raw page: how many text and media items it has, and its text."""
    pages = parse_sequences(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    kind = lambda k: F.filter("items", lambda x: x["kind"] == k)
    body = F.array_join(F.transform(kind("text"), lambda x: x["text"]), "\n")
    return pages.select("page_id", F.size(kind("text")).cast("long").alias("n_texts"), F.size(kind("media")).cast("long").alias("n_media"), F.md5(body.cast("binary")).alias("text_md5"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.withColumn("n_notices", F.size("notices").cast("long")).drop("notices")


def op10_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition_quality(documents(spark, sf_dir))
    shares = [F.col("dup_ngram_shares")[i].alias(f"dup_{n}_gram_share") for i, n in enumerate(sorted(QualityRules().ngram_share))]
    return found.select(*[c for c in found.columns if c not in ("dup_ngram_shares", "reason")], *shares, "reason")


def op11_kd_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), KMeans(dims=64, k=8, rounds=10))[0]


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, slack=1).documents


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), Collocations(longest=5, least=100, contained=100, first=2000))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bbit_minhash, op2_segment_line_dedup, op3_hierarchical_packing, op4_virtual_slot_shards, op5_hierarchical_mix, op6_patched_token_blocks, op7_viterbi_language, op8_interleaved_media, op9_license_scan, op10_repetition_quality, op11_kd_tree_clusters, op12_positional_index, op13_phrase_collocations, pages_interleaved)}


def _shares(level: str, children: str, parents: str, parent: tuple[str, ...], name: str) -> str:
    """Common table expressions that divide the budgets of parents among children by weight and cap."""
    by = f"partition by {', '.join(parent)}" if parent else ""
    on = " and ".join(f"c.{p} = p.{p}" for p in parent) or "true"
    keys = ", ".join((*parent, name))
    return f"""
    {level}_0 as (select c.*, p.budget from {children} c join {parents} p on {on}),
    {level}_1 as (select *, cast(budget - coalesce(sum(cap) over ({by} order by cap::double / weight, {name} rows between unbounded preceding and 1 preceding), 0) as double)
        / (sum(weight) over ({by}) - coalesce(sum(weight) over ({by} order by cap::double / weight, {name} rows between unbounded preceding and 1 preceding), 0)) as level from {level}_0),
    {level} as (select {keys}, least(cap, cast(floor(max(level) over ({by}) * weight) as bigint)) as budget from {level}_1)"""


def _cases(column: str, table: dict[str, int], default: int) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {v}" for k, v in table.items()) + f" else {default} end" if table else str(default)


def mix_sql(budget_percent: int = 60, documents: str = "documents") -> str:
    """CTEs up to `taken` (the columns of documents, the tree's names, tokens and epoch), as tree_plan() mixes."""
    plan = tree_plan(budget_percent)
    weights = {n: _cases(n, plan.weights.get(n, {}), plan.default_weight) for n, _ in plan.levels}
    levels = ("domain", "language", "origin")
    nodes = "".join(f"nodes_{n} as (select {', '.join(levels[: i + 1])}, cast(sum(tokens) * {plan.epochs} as bigint) as cap, {weights[n]} as weight from usable group by {', '.join(levels[: i + 1])}),\n    " for i, n in enumerate(levels))
    names = ", ".join(f"coalesce({e}, '?') as {n}" for n, e in plan.levels)
    return f"""with named as (select *, {names},
        cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as tokens from {documents}),
    supply as (select domain, language, origin, cast(sum(tokens) as bigint) as tokens from named group by all),
    usable as (select * from supply where {" and ".join(f"{w} > 0" for w in weights.values())}),
    total as (select cast(floor(coalesce(sum(tokens), 0) * {plan.budget_percent} / 100) as bigint) as budget from supply),
    {nodes}{_shares("d", "nodes_domain", "total", (), "domain")},
    {_shares("l", "nodes_language", "d", ("domain",), "language")},
    {_shares("o", "nodes_origin", "l", ("domain", "language"), "origin")},
    leaves as (select o.*, s.tokens as supply, case when s.tokens > 0 then o.budget // s.tokens else 0 end as whole from o join supply s using (domain, language, origin)),
    turns as (select n.*, l.budget, l.supply, l.whole, cast(e.epoch as int) as epoch from named n join leaves l using (domain, language, origin), (select unnest(range(0, {plan.epochs + 1})) as epoch) e where e.epoch <= l.whole),
    placed as (select *, coalesce(sum(tokens) over (partition by domain, language, origin, epoch order by md5('{plan.seed}|' || epoch || '|' || coalesce(cast(doc_id as varchar), '?')) rows between unbounded preceding and 1 preceding), 0) as before from turns),
    taken as (select * from placed where epoch < whole or before < budget - epoch * supply)"""


def near_duplicates_sql(words: int = 3, percent: int = 85) -> str:
    """All pairs that share a shingle, their exact similarity, and components by following links."""
    upper, lower = ascii_uppercase, ascii_lowercase
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""with recursive texts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    shingles as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle})) end) as g from texts),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    pairs as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all),
    links as (select x, y from pairs p join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * p.n >= {percent} * (a.n + b.n - p.n)),
    both_ways as (select x, y from links union all select y, x from links),
    reached as (select x, y from both_ways union select r.x, b.y from reached r join both_ways b on r.y = b.x),
    least_of as (select x as doc_id, min(y) as m from reached group by x)
    select t.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) as component_id, least(t.doc_id, coalesce(m, t.doc_id)) = t.doc_id as kept
    from texts t left join sizes using (doc_id) left join least_of using (doc_id)"""


def quality_sql() -> str:
    """Every window of words as text, numbered among its equals within a document; documents are told apart by their row."""
    rules = QualityRules()
    space, places = "[^\\x20\\x09-\\x0D]", "coalesce(text, '')"
    shares, joins, failed = [], [], ""
    for n, limit in sorted(rules.ngram_share.items()):
        joins.append(f"""later_{n} as (select rid, sum(length(word)) as chars from words where (rid, pos) in (select rid, unnest(range(pos, pos + {n})) from windows where size = {n} and turn > 1) group by rid)""")
        shares.append(f"coalesce(later_{n}.chars, 0) / per as dup_{n}_gram_share")
        failed += f" when dup_{n}_gram_share > {limit} then 'duplicate_{n}_grams'"
    sizes = sorted({*rules.ngram_share, rules.base_window})
    return f"""with docs as (select row_number() over () as rid, doc_id, {places} as text, regexp_extract_all({places}, '{space}+') as w from documents),
    words as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from docs),
    windows as (select *, row_number() over (partition by rid, size, key order by pos) as turn, count(*) over (partition by rid, size, key) as n from
        (select rid, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as key from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as pos from docs, (select unnest({sizes}) as size)))),
    lines as (select rid, line, row_number() over (partition by rid, line order by pos) as turn from (select rid, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs) where regexp_matches(line, '{space}')),
    line_sums as (select rid, count(*) as n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) as chars from lines where turn > 1 group by rid),
    many as (select rid, count(*) as n from (select distinct rid, unnest(range(pos, pos + {rules.base_window})) from windows where size = {rules.base_window} and n > 1) group by rid),
    sums as (select rid, doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols from docs),
    {', '.join(joins)},
    measured as (select sums.*, greatest(word_chars, 1)::double as per, cast(coalesce(line_sums.n, 0) as bigint) as n_dup_lines, cast(coalesce(many.n, 0) as bigint) as n_repeat_words, coalesce(line_sums.chars, 0) / per as dup_line_share, {', '.join(shares)}
        from sums left join line_sums using (rid) left join many using (rid) {' '.join(f'left join later_{n} using (rid)' for n in sorted(rules.ngram_share))}),
    judged as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.base_percent} * n_words as base_failed, case when n_words < {rules.min_words} then 'few_words' when 100 * n_repeat_words > {rules.base_percent} * n_words then 'repeated_windows'
        when dup_line_share > {rules.line_share} then 'duplicate_lines'{failed} when n_symbols > {rules.symbols_per_word} * n_words then 'symbols' end as reason from measured)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason is null as kept, dup_line_share, {', '.join(f'dup_{n}_gram_share' for n in sorted(rules.ngram_share))}, reason from judged"""


def licenses_sql(threshold: float = 0.8) -> str:
    """Every window of word pairs that begins with a pair of a template, held against it."""
    listed = []
    for t, x in enumerate(TEMPLATES):
        words = [w.decode() for w in bytes_words(x.text)]
        size = len(set(zip(words, words[1:], strict=False)))
        listed.append(f"({t}, '{x.label}', [{', '.join(f"'{w}'" for w in words)}], {size}, {max(1, math.ceil(threshold * size - 1e-9))}, {math.ceil((len(words) - 1) / threshold - 1e-9)})")
    phrases = ", ".join(f"('{label}', [{', '.join(f"'{w}'" for w in p.split())}])" for label, p in PHRASES)
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with docs as (select row_number() over () as rid, doc_id, {words} as w from documents),
    templates as (select * from (values {', '.join(listed)}) v(t, label, tw, size, need, width)), phrases as (select * from (values {phrases}) v(label, pw)),
    own as (select distinct t, tw[i] || ' ' || tw[i + 1] as k from (select t, tw, unnest(range(1, len(tw))) as i from templates)),
    hits as (select rid, t, i, k from (select rid, i, w[i] || ' ' || w[i + 1] as k from (select rid, w, unnest(range(1, len(w))) as i from docs)) join own using (k)),
    windows as (select a.rid, a.t, a.i, count(distinct b.k) as n, max(b.i) as last from hits a join templates x on x.t = a.t join hits b on b.rid = a.rid and b.t = a.t and b.i >= a.i and b.i < a.i + x.width group by a.rid, a.t, a.i, x.need having count(distinct b.k) >= x.need),
    parted as (select *, sum(begins) over (partition by rid, t order by i) as part from (select *, case when i > coalesce(max(last) over (partition by rid, t order by i rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as begins from windows)),
    best as (select p.*, x.label, x.size from parted p join templates x using (t) qualify row_number() over (partition by rid, t, part order by n desc, last - i, i) = 1),
    notices as (select m.* from best m where not exists (select 1 from best b where b.rid = m.rid and 2 * (least(m.last, b.last) - greatest(m.i, b.i) + 1) > least(m.last - m.i, b.last - b.i) + 1
        and (b.n * m.size > m.n * b.size or b.n * m.size = m.n * b.size and (b.n > m.n or b.n = m.n and (b.t < m.t or b.t = m.t and b.i < m.i))))),
    places as (select rid, label, i from (select rid, w, label, pw, unnest(range(1, len(w) - len(pw) + 2)) as i from docs, phrases) where list_slice(w, i, i + len(pw) - 1) = pw),
    base as (select rid, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by rid),
    more as (select rid, string_agg(distinct label, ',' order by label) as labels from (select rid, label from places union all select rid, label from notices) group by rid),
    met as (select rid, count(*) as n_notices, max(n::double / size) as score from notices group by rid)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
        case when n_base > 0 then 1.0::double else coalesce(score, 0.0::double) end as score, cast(coalesce(n_notices, 0) as bigint) as n_notices
    from docs left join base using (rid) left join more using (rid) left join met using (rid)"""


def clusters_sql(dims: int = 64, k: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid, round after round."""
    distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i])))"
    steps = ""
    for r in range(rounds + 1):
        steps += f""",
    a{r} as materialized (select rid, arg_min(c, struct_pack(d := d, c := c)) as c, min(d) as d from (select rid, c.c, {distance} as d from v, c{r} c) group by rid)"""
        if r < rounds:
            steps += f""",
    c{r + 1} as materialized (select c.c, coalesce(m.p, c.p) as p from c{r} c left join (select c, list(cast((s - (((s % n) + n) % n)) // n as bigint) order by i) as p
        from (select c, i, sum(v.p[i]) as s, count(*) as n from a{r} join v using (rid), (select unnest(range(1, {dims + 1})) as i) group by c, i) group by c) m on m.c = c.c)"""
    return f"""with v as materialized (select row_number() over () as rid, vec_id, embedding, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as p from embeddings
        where len(embedding) = {dims} and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {dims}),
    c0 as materialized (select cast(row_number() over (order by digest, embedding) - 1 as int) as c, p from (select sha256('3:' || vec_id) as digest, embedding, p from v order by digest, embedding limit {k})){steps},
    sums as (select c, cast(sum(d) as bigint) as cluster_inertia from a{rounds} group by c)
    select vec_id, a.c as cluster, cast(d as bigint) as distance, cluster_inertia, cast((select sum(d) from a{rounds}) as bigint) as inertia, sha256(array_to_string(c.p, ',')) as centroid_sha256
    from a{rounds} a join v using (rid) join c{rounds} c on c.c = a.c join sums s on s.c = a.c"""


def contamination_sql(width: int = 10, slack: int = 1) -> str:
    """Every run of a document's words that is as long as some window, held against all windows; proximity from every place of each window's rarest word."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with docs as (select row_number() over () as rid, doc_id, {words} as w from documents),
    items as (select coalesce(cast(item_id as varchar), '') as item_id, {words} as w from benchmark),
    windows as (select distinct item_id, least(len(w), {width}) as size, array_to_string(list_slice(w, s, s + {width - 1}), ' ') as k from (select *, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) as s from items where len(w) > 0)),
    runs as (select rid, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') as k from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as s from docs, (select distinct size from windows))),
    found as (select distinct rid, s, size, item_id from runs join windows using (size, k)),
    hits as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(s, s + size)) from (select distinct rid, s, size from found)) group by rid),
    cut as (select row_number() over () as wid, size, string_split(k, ' ') as w from (select distinct size, k from windows)), placed as (select wid, size, unnest(range(size)) as o, unnest(w) as term from cut),
    tokens as (select rid, unnest(range(len(w))) as pos, unnest(w) as term from docs), often as (select term, count(*) as n from tokens group by term),
    ranked as (select p.*, n, row_number() over (partition by wid order by n, o) as turn, count(n) over (partition by wid) as there from placed p left join often using (term)),
    anchored as (select distinct rid, wid, size, pos - o as start from ranked join tokens using (term) where turn = 1 and there = size),
    close as (select a.rid, a.wid from anchored a left join ranked r on r.wid = a.wid and r.turn > 1 left join tokens t on t.rid = a.rid and t.term = r.term and t.pos between a.start + r.o - {slack} and a.start + r.o + {slack}
        group by a.rid, a.wid, a.start, a.size having count(distinct case when t.pos is not null then r.o end) = a.size - 1),
    near as (select rid, count(distinct item_id) as n_near from (select distinct rid, wid from close) join cut using (wid) join windows v on v.size = cut.size and v.k = array_to_string(cut.w, ' ') group by rid),
    of as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from found) group by rid)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, cast(coalesce(n_near, 0) as bigint) as n_near
    from docs left join hits using (rid) left join of using (rid) left join near using (rid)"""


def collocations_sql(longest: int = 5, least: int = 100, contained: int = 100, first: int = 2000) -> str:
    """All phrases of all pieces, counted."""
    part = "array_to_string(list_slice(w, {}, {}), ' ')".format
    return f"""with pieces as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
    total as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
    places as (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from pieces, (select unnest(range(1, {longest + 1})) as size)),
    f as (select lang, size, {part("i", "i + size - 1")} as phrase, list_slice(any_value(w), any_value(i), any_value(i) + size - 1) as w, count(*) as a from places group by lang, size, phrase having count(*) >= {least}),
    cuts as (select lang, phrase, size, a, k, {part("1", "k")} as left_part, {part("k + 1", "size")} as right_part from (select *, unnest(range(1, size)) as k from f where size > 1)),
    valued as (select c.lang, c.phrase, c.a, c.k, l.a as l, r.a as r, n, cast((1000::hugeint * c.a * n) // (l.a::hugeint * r.a) as bigint) as score from cuts c join f l on l.lang = c.lang and l.phrase = c.left_part join f r on r.lang = c.lang and r.phrase = c.right_part join total t on t.lang = c.lang),
    best as (select * from valued qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    parts as (select lang, size, a, i, unnest(range(i + 1, size + 1)) as j, w from (select *, unnest(range(1, size)) as i from f where size > 2)),
    within as (select lang, {part("i", "j")} as phrase, max(a) as outer_a from parts where j - i + 1 < size group by all),
    kept as (select b.* from best b left join within o on o.lang = b.lang and o.phrase = b.phrase where outer_a is null or 100 * outer_a < {contained} * a)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept qualify rank <= {first}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_bbit_minhash": near_duplicates_sql(), "op5_hierarchical_mix": mix_sql() + " select doc_id, domain, language, origin, tokens, epoch from taken", "op9_license_scan": licenses_sql(), "op10_repetition_quality": quality_sql(), "op11_kd_tree_clusters": clusters_sql(), "op12_positional_index": contamination_sql(), "op13_phrase_collocations": collocations_sql()}
