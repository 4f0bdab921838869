"""The registered queries of the operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import (
    best_fit,
    crf_secrets,
    filter_audit,
    html_extract,
    katz,
    ngram_join,
    pieces,
    prefix_trie,
    projection_passes,
    quality_classifier,
    quality_rules,
    repeats,
    toxicity,
)
from textmill.llm.labelled import remainder


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_folds(scores: DataFrame, modulus: int, held: int) -> DataFrame:
    return scores.select(
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.rule_verdicts(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality_classifier.train(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    return _with_folds(quality_classifier.score_quality(docs, weights), 3, 1)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs, keep_text=False)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return _with_folds(toxicity.score_toxicity(docs, model), 5, 0)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), pieces.Pieces.read(model))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = crf_secrets.find_secrets(docs, crf_secrets.train(docs))

    def of(kind: str):
        return F.filter("spans", lambda x: x["kind"] == kind)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in crf_secrets.KINDS],
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_quality_classifier,
        op3_suffix_array_dedup,
        op4_lm_scoring,
        op5_toxicity,
        op6_embedding_dedup,
        op7_sentencepiece,
        op8_html_extraction,
        op9_ngram_join,
        op10_best_fit_packing,
        op11_secret_scan,
        op12_prefix_trie,
        op13_filter_audit,
    )
}

_SPACE = "[\\x20\\x09-\\x0D]"
_HOST_RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}

OP1_CTES = f"""
raw as (select *, coalesce(text, '') as body from {{docs}}),
words as (
  select *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from raw),
grams as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from words where len(w) >= 4),
named as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from grams),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from named) where n > 1),
repeats as (
  select doc_id, count(distinct i + o) as n_repeat_words from twice, (select unnest([0, 1, 2]) as o) group by doc_id),
measures as (
  select doc_id, source, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from words left join repeats using (doc_id)),
hosts as (
  select source, count(*) as n, {", ".join(f"sum(({t})::int)::double as f_{r}" for r, t in _HOST_RULES.items())}
  from measures group by source),
totals as (
  select count(*) as hosts, sum(n)::double as n_all, sum(n::double * n) as squares,
    {", ".join(f"sum(f_{r}) / sum(n) as m_{r}" for r in _HOST_RULES)} from hosts),
spread as (
  select {", ".join(f"sum(n * power(f_{r} / n - m_{r}, 2)) as s_{r}" for r in _HOST_RULES)} from hosts, totals),
between_hosts as (
  select totals.*, {", ".join(f"case when n_all - squares / n_all > 0 then (s_{r} - (hosts - 1) * m_{r} * (1 - m_{r})) / (n_all - squares / n_all) else 0 end as b_{r}" for r in _HOST_RULES)}
  from totals, spread),
priors as (
  select *, {", ".join(f"least(10000.0, greatest(1.0, case when b_{r} > 0 then m_{r} * (1 - m_{r}) / b_{r} - 1 else 10000.0 end)) as k_{r}" for r in _HOST_RULES)}
  from between_hosts),
verdicts as (
  select source, greatest({", ".join(f"(f_{r} + m_{r} * k_{r}) / (n + k_{r})" for r in _HOST_RULES)}) > 0.5 as rejected
  from hosts, priors),
judged as (
  select m.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, rejected
  from measures m join verdicts v on m.source is not distinct from v.source)
"""

ORACLES = {
    "op1_quality_rules": "with "
    + OP1_CTES.format(docs="documents")
    + """select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not rejected as kept from judged""",
    "op9_ngram_join": """
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from places),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as o
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select x, y from shared join sizes nx on nx.doc_id = x join sizes ny on ny.doc_id = y
  where 100 * o >= 80 * (nx.n + ny.n - o)),
both_ways as (from links union all select y, x from links),
reached(x, r) as (
  select doc_id, doc_id from documents
  union
  select b.x, reached.r from reached join both_ways b on b.y = reached.x),
lowest as (select x as doc_id, min(r) as component_id from reached group by x)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from lowest left join sizes using (doc_id)""",
    "op3_suffix_array_dedup": """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (
  select doc_id, unnest(range(0, length(h) // 2 - 199)) as i, h from bytes where length(h) >= 400),
hashed as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as s from starts),
often as (select s from hashed group by s having count(*) > 1),
found as (select doc_id, i from hashed semi join often using (s)),
stepped as (select *, i - lag(i) over (partition by doc_id order by i) as step from found),
runs as (
  select doc_id, i, sum(case when step is null or step > 200 then 1 else 0 end)
    over (partition by doc_id order by i rows unbounded preceding) as run
  from stepped),
spans as (select doc_id, run, min(i) as a, max(i) + 200 as b from runs group by doc_id, run),
cuts as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as b, a from spans
  union all
  select doc_id, coalesce(max(s.b), 0), length(h) // 2 from bytes left join spans s using (doc_id) group by doc_id, h),
kept as (
  select doc_id, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' order by b, a) as k
  from cuts join bytes using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(r.n, 0) as bigint) as n_removed,
  cast(coalesce(r.c, 0) as bigint) as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from bytes left join (select doc_id, sum(b - a) as n, count(*) as c from spans group by doc_id) r using (doc_id)
  left join kept using (doc_id)""",
    "op6_embedding_dedup": """
with recursive usable as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from usable a join usable b on a.vec_id < b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
both_ways as (from links union all select y, x from links),
reached(x, r) as (
  select vec_id, vec_id from embeddings
  union
  select b.x, reached.r from reached join both_ways b on b.y = reached.x),
lowest as (select x as vec_id, min(r) as component_id from reached group by x),
counts as (select x as vec_id, count(*) as n from both_ways group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from lowest left join counts using (vec_id)""",
    "op12_prefix_trie": """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
numbered as (
  select *, md5(md5(role) || md5(text)) as t, row_number() over (
    partition by conv_id order by turn nulls first, md5(md5(role) || md5(text))) - 1 as i from turns),
convs as (
  select conv_id, count(*) as m, conv_id - conv_id % 100 as base,
    xor(list_reduce(
      list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8],
        lambda r, k: xor(r >> 1, case when r & 1 = 1 then 3988292384 else 0 end))), 4294967295) % 6 as h
  from numbered group by conv_id),
taking as (
  select c.*, least(c.h, coalesce(b.m, 0)) as taken from convs c left join convs b on b.conv_id = c.base),
rebuilt as (
  select c.conv_id, taken + i - h + 1 as d, t, length(text) as n from numbered join taking c using (conv_id) where i >= h
  union all
  select c.conv_id, i + 1, t, length(text) from taking c join numbered b on b.conv_id = c.base where i < taken),
paths as (
  select conv_id, d, n, md5(string_agg(t, '' order by d) over (partition by conv_id order by d)) as k from rebuilt
  union all select conv_id, 0, 0, '' from convs),
owned as (
  select *, min(conv_id) over (partition by d, k) as owner, count(*) over (partition by d, k) as members,
    max(d) over (partition by conv_id) as total from paths),
nodes as (
  select d, k, owner as conv_id, any_value(members) as n_convs, any_value(n) as n,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = total), '') as ends
  from owned group by d, k, owner),
edges as (
  select v.d, v.conv_id, p.owner as parent_conv_id
  from nodes v join owned p on p.conv_id = v.conv_id and p.d = v.d - 1),
fans as (select d - 1 as d, parent_conv_id as conv_id, count(*) as n_children from edges group by all),
valued as (
  select v.*, coalesce(n_children, 0) as n_children from nodes v left join fans f on f.d = v.d and f.conv_id = v.conv_id),
below as (
  select a.d, a.owner as conv_id, sum(case when v.n_children = 0 then 1 else 0 end) as n_leaves, sum((v.n_convs - 1) * v.n) as saved
  from valued v join owned a on a.conv_id = v.conv_id and a.d <= v.d group by all)
select v.conv_id, v.d as depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves,
  saved::bigint as saved_tokens, sha256(ends) as ends_sha256
from valued v join below b on b.d = v.d and b.conv_id = v.conv_id
  left join edges e on e.d = v.d and e.conv_id = v.conv_id""",
    "op13_filter_audit": """
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from texts),
firsts as (select t, min(doc_id) as least from texts group by t),
known as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id),
failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(w) < 200 then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when coalesce(least < words.doc_id, false) then 16 else 0 end as bits
  from words join firsts using (t) left join known on known.doc_id = words.doc_id),
counts as (
  select part, bits, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, bits),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as o
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (
  select o, s, 1 << (ascii(o[s]) - 65) as own, list_sum([1 << (ascii(x) - 65) for x in string_split(o[1:s], '')])::bigint as upto
  from orders, (select unnest([1, 2, 3, 4, 5]) as s)),
counted as (
  select part, o as filter_order, s as step, o[s] as filter,
    sum(case when bits & upto = 0 then n else 0 end)::bigint as kept,
    sum(case when bits & (upto - own) = 0 and bits & own <> 0 then n else 0 end)::bigint as removed,
    sum(case when bits & (upto - own) <> 0 and bits & own <> 0 then n else 0 end)::bigint as redundant,
    sum(case when bits = own then n else 0 end)::bigint as unique_fails,
    sum(case when bits & (upto - own) = 0 and bits & own <> 0 then good else 0 end)::bigint as good_lost,
    sum(case when bits & (upto - own) = 0 and bits & own <> 0 then toxic else 0 end)::bigint as toxic_lost
  from counts, steps group by all)
select *, (sum(removed) over (partition by part, filter))::bigint as shapley from counted""",
}
