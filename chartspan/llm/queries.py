"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.llm import embedding_dedup, line_dedup, mixing, periodic_runs, personal_data, prefix_trie, quality_classifier, quality_rules, secret_scan, sentencepieces, simhash, token_counts, url_filters
from chartspan.llm.common import shared_dir, text_or_empty

TOKENIZER = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first, so that each call does the whole work."""
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document that the last number of its path names, so that document's quality label is the page's."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_key"), (1 - F.col("quality")).alias("bad"))
    return url_filters.judge(_table(spark, sf_dir, "pages"), labels)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host, its language the path below."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_classifier.judge(docs, quality_classifier.train(docs, labels), labels)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(_table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as flat as they can be with no source over twice as often in as another; every document is in at least once."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), repeats=2.0)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_slot", "mix_tokens")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for the file path."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"), secret_scan.train(secret_scan.labelled_findings(spark)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.summary(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """What the query's contract makes of a document's words: in a tenth of the documents a period from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_table(spark, sf_dir, "documents"), rewrite=_with_period)
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    exponent = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"), family=prefix_trie.FAMILY)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))


# What SQL can state of operators whose whole result it can't: the operators' own columns, over whole tables.


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1: every document with its bytes."""
    return op1_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("over_limit") == (F.col("n_tokens") > 4096)).alias("limit_holds"))


def urls_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2: hosts, paths and rules, and the verdict where a rule gives it."""
    return op2_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def personal_data_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4: counts of the rules' spans."""
    return op4_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7: the base rules' counts and their verdict."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_DIGITS = "list_transform(string_split(regexp_replace(m, '[^0-9]', '', 'g'), ''), lambda d: d::int)"

SQL = {
    "text_bytes": "select doc_id, strlen(coalesce(text, '')) as n_bytes, true as limit_holds from documents",
    "urls_by_rules": r"""
with cut as (select page_id, case when url like '%://%' then url[instr(url, '://') + 3:] end as rest from pages),
part as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
rules(ruled, rule, site, below) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(ruled, length(rule)) as ruled from part join rules on (host = site or ends_with(host, '.' || site)) and starts_with(path, below) group by page_id)
select page_id, host, path, rule, ruled from part left join best using (page_id)""",
    "personal_data_by_rules": rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
found as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as email, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ip,
  regexp_extract_all(text, '[0-9]([ -]?[0-9])+') as card, regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]') as phone from t)
select doc_id, len(email) as n_email, len(list_filter(ip, lambda m: list_max(list_transform(string_split(m, '.'), lambda p: case when length(ltrim(p, '0')) > 3 then 999 else coalesce(try_cast(p as int), 0) end)) <= 255)) as n_ip,
  len(list_filter(card, lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) between 14 and 19 and
    list_sum(list_transform(list_reverse({_DIGITS}), lambda d, i: case when i % 2 = 1 then d when d > 4 then 2 * d - 9 else 2 * d end)) % 10 = 0)) as n_card,
  len(list_filter(phone, lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) between 10 and 15)) as n_phone from found""",
    "quality_base_counts": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as words from documents),
line as (select doc_id, unnest(string_split(text, chr(10))) as line from t),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from line where regexp_matches(line, '[^ 	-]') group by doc_id),
win as (select doc_id, unnest(range(1, len(words) - 3)) as i, words from t where len(words) >= 5),
named as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as w from win),
twice as (select doc_id, w from named group by doc_id, w having count(*) > 1),
held as (select distinct doc_id, unnest(range(i, i + 5)) as pos from named join twice using (doc_id, w)),
rep as (select doc_id, count(*) as n_repeat_words from held group by doc_id)
select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(words) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(words) as base_failed
from t left join dup using (doc_id) left join rep using (doc_id)""",
    "op12_prefix_trie": """
with own as (select conv_id as c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as x, length(coalesce(text, '')) as n, turn from conversations where conv_id is not null),
conv as (select c, x, n, row_number() over (partition by c order by turn nulls first, x) - 1 as pos from own),
sizes as (select c, count(*) as k,
  xor(4294967295, list_reduce(list_concat([4294967295::ubigint], list_transform(range(length(c::varchar)), lambda i: ascii(substr(c::varchar, i::int + 1, 1))::ubigint)),
    lambda h, y: list_reduce(list_concat([xor(h, y)], [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::ubigint * (v & 1)))))::bigint % 6 as h
  from conv group by c),
plan as (select s.c, s.c - s.c % 100 as base, s.h, least(s.h, coalesce(b.k, 0)) as shared from sizes s left join sizes b on b.c = s.c - s.c % 100),
rebuilt as (
  select p.c, b.pos + 1 as d, b.x, b.n from plan p join conv b on b.c = p.base and b.pos < p.h
  union all select p.c, p.shared + o.pos - p.h + 1, o.x, o.n from plan p join conv o on o.c = p.c and o.pos >= p.h),
named as (select c, d, n, md5(string_agg(x, '') over (partition by c order by d)) as f from rebuilt union all select c, 0, 0, '' from plan),
node as (select d, f, min(c) as conv, count(*) as n_convs, max(n) as chars from named group by d, f),
part as (select m.c, m.d, v.conv from named m join node v using (d, f)),
full_node as (select v.*, u.conv as up from node v left join part u on u.c = v.conv and u.d = v.d - 1),
kids as (select up as conv, d - 1 as d, count(*) as n_children from full_node where d > 0 group by 1, 2),
weighed as (select v.conv, v.d, (k.conv is null)::bigint as leaf, (v.n_convs - 1) * v.chars as saved from node v left join kids k using (conv, d)),
sub as (select a.conv, a.d, sum(w.leaf) as n_leaves, sum(w.saved) as saved from weighed w join part a on a.c = w.conv and a.d <= w.d group by 1, 2),
last as (select c, max(d) as d from named group by c),
ends as (select p.conv, p.d, string_agg(l.c::varchar, ',' order by l.c) as ids from last l join part p using (c, d) group by 1, 2)
select v.conv as conv_id, v.d::bigint as depth, v.up as parent_conv_id, v.n_convs::bigint as n_convs, coalesce(k.n_children, 0)::bigint as n_children, s.n_leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from full_node v left join kids k using (conv, d) join sub s using (conv, d) left join ends e using (conv, d)""",
    "op13_line_dedup": """
with held as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
cut as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from held),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from cut),
firsts as (select k, min(doc_id) as owner from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2)
select doc_id, count(*) as n_lines, count(*) filter (where owner <> doc_id) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where owner is null or owner = doc_id), '')) as kept_sha256
from keyed left join firsts using (k) group by doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return found | {f.__name__: f for f in (text_bytes, urls_by_rules, personal_data_by_rules, quality_base_counts)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
