"""Queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import chat, decontamination, licences, line_dedup, main_text, near_duplicates, periodic_runs, pieces, quality_model, quality_rules, ranked_search, sharding, token_counts


def piece_file() -> str:
    """The public 32,000-piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.WordPieces.from_sentencepiece(piece_file()))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


N_SHARDS = 24


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", sharding.byte_size("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.shard_by_bytes(rows, N_SHARDS, "doc_id", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), pieces.PieceModel.load(piece_file()))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.read_examples(conversations.unionByName(probe))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), pieces.PieceModel.load(piece_file()))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = line_dedup.line_cuts(_table(spark, sf_dir, "documents"))
    return cuts.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_tails(_table(spark, sf_dir, "documents")))
    # the longest run; of equals the first to start, then the one of the least period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("less"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    rows = found.withColumn("longest", longest)
    start, length, period = -F.col("longest.back"), F.col("longest.length"), -F.col("longest.less")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * longest.length) div (-longest.less)").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_minhash, op3_decontamination, op4_sharding, op5_quality_rules, op6_chat, op7_quality_model, op8_pieces, op9_licences, op10_main_text, op11_line_dedup, op12_periodic_runs, op13_ranked_search)}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op3_decontamination": rf"""
with item as (select item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
item_window as (
  select distinct cast(item_id as varchar) as item, n, array_to_string(w[cast(i as bigint):cast(i + n - 1 as bigint)], ' ') as win
  from (select *, unnest(range(1, len(w) - n + 2)) as i from (select *, least(10, len(w)) as n from item where len(w) > 0))),
doc as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
sizes as (select distinct n from item_window),
doc_window as (
  select r, n, i, array_to_string(w[cast(i as bigint):cast(i + n - 1 as bigint)], ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, sizes where len(w) >= n)),
hit as (select distinct d.r, d.n, d.i, x.item from doc_window d join item_window x on d.n = x.n and d.win = x.win),
hit_word as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
hit_item as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit_word using (r) left join hit_item using (r)""",
    "op6_chat": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
rendered as (
  select *, '<|im_start|>' || replace(replace(role, '\', '\\'), '<|', '<\|') || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) as shown from c),
prefixed as (select *, string_agg(shown, '') over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as example from rendered)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  count(case when role = 'assistant' then 1 end) as n_examples,
  cast(sum(length(shown)) as bigint) as formatted_chars,
  cast(coalesce(sum(case when role = 'assistant' then length(example) end), 0) as bigint) as example_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then sha256(example) end, '' order by turn, role, text), '')) as examples_sha256
from prefixed group by conv_id""",
}
_CANONICAL = r"trim(regexp_replace({}, ' +', ' ', 'g'))"


def _canonical_sql(text: str) -> str:
    """licences.canonical in DuckDB's dialect."""
    lines = rf"regexp_replace(lower({text}), '(?m)^[^\pL\pN\n]*(?:copyright\b|\(c\)|©)[^\n]*$|^[^\pL\pN\n]*all rights reserved[^\pL\pN\n]*$', ' ', 'g')"
    words = rf"' ' || regexp_replace({lines}, '[^\pL\pN]+', '  ', 'g') || ' '"
    for old, new in licences.SPELLINGS.items():
        words = f"replace({words}, ' {old} ', ' {new} ')"
    return _CANONICAL.format(words)


def _known_sql(texts: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{name}', '{form.replace(chr(39), chr(39) * 2)}')" for name, forms in texts.items() for form in forms)
    return f"(select known, min(license) as license from (select license, sha256({_canonical_sql('t')}) as known from (values {rows}) v(license, t)) group by known)"


ORACLE_SQL["op9_licences"] = rf"""
with whole as {_known_sql(licences.TEXTS)}, notice as {_known_sql(licences.NOTICES)},
doc as (select row_number() over () as r, doc_id, text, {_canonical_sql("text")} as form from documents),
line as (select r, unnest(string_split(text, chr(10))) as l from doc),
found as (select r, license from (select r, sha256({_canonical_sql("l")}) as d from line where regexp_matches(lower(l), 'licen|public|spdx|cc0')) x join notice on x.d = notice.known),
total as (select r, count(*) as n_notices, string_agg(distinct license, ',' order by license) as notices from found group by r)
select doc_id, case when form <> '' then sha256(form) end as text_digest, whole.license, cast(coalesce(n_notices, 0) as bigint) as n_notices, coalesce(notices, '') as notices
from doc left join total using (r) left join whole on whole.known = case when form <> '' then sha256(form) end"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL["op11_line_dedup"] = rf"""
with doc as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
line as (
  select r, i, l[cast(i as bigint)] as line, trim(translate(l[cast(i as bigint)], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_BLANK}) as key
  from (select *, unnest(range(1, len(l) + 1)) as i from doc)),
common as (select key from line where key <> '' group by key having count(distinct r) >= 10),
cut as (
  select r, count(*) as n_lines, count(common.key) as n_dropped, coalesce(string_agg(case when common.key is null then line end, chr(10) order by i), '') as kept
  from line left join common on line.key = common.key group by r)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from doc join cut using (r)"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL["op13_ranked_search"] = rf"""
with doc as (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
item as (select row_number() over () as q, item_id, {_TERMS} as w from benchmark),
size as (select r, doc_id, len(w) as n from doc where len(w) > 0),
total as (select count(*) as docs, sum(n)::bigint as terms from size),
tf as (select r, term, count(*) as tf from (select r, unnest(w) as term from doc) group by r, term),
weight as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), total),
scored as (
  select q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from (select q, item_id, unnest(w) as term from item) join weight using (term) join tf using (term) join size using (r), total group by all),
placed as (select *, row_number() over (partition by q order by score desc, doc_id nulls last, r) as place from scored where score > 0)
select item_id, place::int as rank, doc_id, score from placed where place <= 20"""
