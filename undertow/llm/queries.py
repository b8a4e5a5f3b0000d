"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import conversations, decontaminate, divergence, jaccard_join, licenses, minhash_dedup, mixing, pii, quality, suffix_dedup, token_rollup, toxicity, url_filter
from undertow.llm.common import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return suffix_dedup.remove_repeats(docs, length=400, keep="none", passage_words=50).drop("spans")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return minhash_dedup.near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.cosine", "m.coverage", F.col("m.answer").alias("answer_coverage"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions; one batch is replayed, and one is revised, folded and taken back."""
    docs = _table(spark, sf_dir, "documents")
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("pieces", inserts=token_rollup.count_tokens(docs, "byte_bpe_50k"))
    words = materialize(token_rollup.count_tokens(docs, "words"), "counts")
    for _ in range(2):
        rollup.commit("words", inserts=words)
    doubled = words.withColumn("n_tokens", F.col("n_tokens") * 2)
    rollup.commit("recount", revised=(words, doubled))
    rollup.fold()
    rollup.commit("undo", revised=(doubled, words))
    return rollup.totals()


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_token_rollup": op8_token_rollup,
    "op9_mixing": op9_mixing,
    "op10_url_filter": op10_url_filter,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    "op9_mixing": r"""
with docs as (
  select cast(doc_id as bigint) doc_id, source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) h
  from documents),
sums as (select source, cast(sum(size) as bigint) source_size from docs group by source),
named as (
  select *, 2 * source_size cap,
    [3, 1, 2][cast((row_number() over (order by source is null, source) - 1) % 3 as integer) + 1] weight
  from sums),
levels as (
  select *, cap / weight ratio,
    (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0))
      / (sum(weight) over () - coalesce(sum(weight) over before, 0)) level
  from named
  window before as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)),
share as (select arg_min(level, ratio) share from levels where ratio >= level),
targets as (
  select source, source_size, least(cast(cap as double), (select share from share) * weight) target,
    case when source_size > 0 then cast(floor(least(cast(cap as double), (select share from share) * weight) / source_size) as bigint) else 0 end whole
  from levels),
placed as (
  select doc_id, size, h, source_size, target, whole, target - whole * source_size rest,
    sum(size) over (partition by d.source order by h) upto,
    sum(size) over (partition by d.source order by h) - sum(size) over (partition by d.source, h) before
  from docs d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(size * (whole + case when rest > 0 and (upto <= rest or (before <= rest and upto - rest < rest - before)) then 1 else 0 end) as bigint) taken
from placed""",
    "op10_url_filter": r"""
with parts as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
split as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from parts),
ruled as (
  select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end rule
  from split)
select page_id, host, path, rule, case
  when rule in ('www.example.com/en/', 'com/') then 'allow'
  when rule is not null then 'block'
  when starts_with(path, '/') and (contains(host, 'cheap-pills.') or contains(host, 'adult-') or contains(host, 'casino')
    or ends_with(host, '.xxx') or contains(path, '/porn/') or ends_with(path, '.exe')) then 'block'
  else 'allow' end verdict
from ruled""",
    "op12_conversation_repair": r"""
with recursive crc_table as (
  select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, k: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) crcs),
codes as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, crcs,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)) bytes
  from conversations, crc_table),
kinds as (
  select conv_id, turn, role, text,
    xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(crcs[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) % 20 damage
  from codes),
damaged as (
  select conv_id, turn, case when damage = 4 then 'user' else role end role,
    case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text,
    unnest(case when damage = 3 then [1, 2] else [1] end) copy
  from kinds where damage != 0),
placed as (
  select *, left(role, 1) initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) final,
    row_number() over w t, lag(left(role, 1)) over w || left(role, 1) pair
  from damaged window w as (partition by conv_id order by turn nulls first, role, text)),
turns as (
  select *, case when final = '' then 'blank' when row_number() over (partition by conv_id, role, text order by t) > 1 then 'duplicate' when final not in ('.', '!', '?') then 'truncated' else '' end fault
  from placed),
arcs(s1, s2, role) as (values ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
inserts as (
  select distinct s1 s, s1 behind, '' letters, 0 price, cast([] as varchar[]) added from arcs union all
  select s1, s2, 'I', 3, [role || ':'] from arcs union all
  select x.s1, y.s2, 'II', 6, [x.role || ':', y.role || ':'] from arcs x join arcs y on y.s1 = x.s2),
moves as (
  select s, behind, letters || 'D' letters, price + 4 price, added, 'D' edit, cast(null as varchar) role from inserts union all
  select s, s2, letters || 'R', price + 3, added, 'R', role from inserts join arcs on s1 = behind union all
  select s, s2, letters || 'K', price, added, 'K', s2 from inserts join (select s1, s2 from arcs union all values ('', 's')) k on s1 = behind),
best as (
  select distinct conv_id, cast(0 as bigint) t, '' s, cast(0 as bigint) cost, '' audit, cast([] as varchar[]) kept from turns
  union all
  select conv_id, t, s, way.cost, way.audit, way.kept from (
    select b.conv_id, b.t + 1 t, m.behind s, min({
      'cost': b.cost + m.price + case when fault = 'truncated' and edit != 'D' then 3 else 0 end, 'audit': b.audit || m.letters,
      'kept': list_concat(b.kept, m.added, case edit when 'D' then cast([] as varchar[]) when 'K' then [r.role || ':' || r.text] else [m.role || ':' || r.text] end)}) way
    from best b join turns r on r.conv_id is not distinct from b.conv_id and r.t = b.t + 1
    join moves m on m.s = b.s and (edit = 'D' or (fault not in ('blank', 'duplicate') and (edit = 'R' or m.role = r.initial)))
    group by b.conv_id, b.t + 1, m.behind)),
sums as (
  select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 'blank') blank,
    count(*) filter (where fault = 'duplicate') duplicate, count(*) filter (where fault = 'truncated') truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) illegal
  from turns group by conv_id),
ends as (
  select b.conv_id, min({'cost': b.cost + i.price, 'audit': b.audit || i.letters, 'kept': list_concat(b.kept, i.added)}) way
  from best b join sums z on z.conv_id is not distinct from b.conv_id and z.n = b.t join inserts i on i.s = b.s and i.behind in ('', 'a') group by b.conv_id)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, coalesce(way.cost, 0) cost, coalesce(way.audit, '') audit, sha256(coalesce(array_to_string(way.kept, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) c left join sums z on z.conv_id is not distinct from c.conv_id left join ends e on e.conv_id is not distinct from c.conv_id""",
    "op13_source_divergence": r"""
with docs as (
  select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') terms
  from documents),
words as (select id, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from docs),
kept as (select lang, term, count(*) n from words group by lang, term having count(distinct id) >= 3),
langs as (select lang, count(*) v, sum(n) size from kept group by lang),
counts as (select w.lang, source, term, count(*) n from words w join kept k using (lang, term) group by w.lang, source, term),
groups as (
  select g.lang, g.source, coalesce(l.v, 0) v, coalesce(c.size, 0) size
  from (select distinct lang, source from docs) g left join langs l on l.lang = g.lang
  left join (select lang, source, sum(n) size from counts group by lang, source) c on c.lang = g.lang and c.source = g.source),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n,
    cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.size + g.v) as hugeint) p,
    cast(1 + (1000000000::hugeint * (k.n + 1)) // (l.size + l.v) as hugeint) q
  from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
every as (
  select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(p.value, 0) as bigint) value
  from groups a join groups b on a.lang = b.lang and a.source != b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from shares where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) rank from every)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200""",
}
