"""The registered queries of the subpackage, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    bpe, decontaminate, embed_dedup, exact_dedup, infill, language, packing, passages, secret_ledger, simhash, source_audit, token_counts, toxicity,
)
from riskframe.llm.common import table
from riskframe.operators.ordered import shared_dir


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_pack(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(table(spark, folder, "documents"), ranks, pattern), ranks, pattern)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the token files that their partitions would be written to."""
    separator = 50256
    blocks = token_counts.token_blocks(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), separator)
    return token_counts.count_tokens(blocks, separator).select("doc_id", "n_tokens", "file", "ordinal")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, folder, "documents"))


OP5_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents
), g as (
  select *, first_value(doc_id) over (partition by norm order by n desc, doc_id) keep_id, count(*) over (partition by norm) group_size from t
)
select doc_id, keep_id, group_size, keep_id = doc_id kept, sha256(norm) text_sha256 from g
"""


def op6_lattice_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, folder, "embeddings"))


OP6_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as (
  select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from v
), links as (
  select a.vec_id a, b.vec_id b from u a join u b using (label)
  where a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) >= 0.98
), reach(vec_id, node) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join links l on l.a = r.node
), comp as (select vec_id, min(node) component_id from reach group by 1)
select vec_id, (select count(*) from links where a = vec_id) n_links, component_id, vec_id = component_id kept from comp
"""


def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 200) s from (select doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) i from d)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) n from w) where n > 1),
edge as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 100, -1) as fresh from later),
run as (select doc_id, i, sum(case when fresh then 1 else 0 end) over (partition by doc_id order by i) k from edge),
gone as (select doc_id, k, min(i) a, max(i) + 100 b from run group by doc_id, k),
part as (select doc_id, k, a, b, coalesce(lag(b) over (partition by doc_id order by k), 0) since from gone),
total as (select doc_id, sum(b - a) n_removed, count(*) n_spans, max(b) rest, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by k) kept
  from part join d using (doc_id) group by doc_id)
select d.doc_id, length(h) // 2 n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0) n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(rest, 0) + 1))) kept_sha256
from d left join total using (doc_id)
"""


def new_ledger(spark: SparkSession) -> str:
    """Place of a ledger that starts empty, in the shared folder."""
    return f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_ledger.scan(table(spark, folder, "documents"), new_ledger(spark))
    base = [r.kind for r in secret_ledger.RULES]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def _span_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"""
  select doc_id, '{kind}' kind, {order} nth, s.start, s.start + s.whole as stop from (
    select doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: struct_pack(
      start := coalesce(list_sum(list_transform(gaps[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[:i - 1], lambda x: length(x))), 0),
      whole := length(w[i]), val := length(v[i])))) s
    from (select doc_id, string_split_regex(t, '{pattern}') gaps, regexp_extract_all(t, '{pattern}', 0) w, regexp_extract_all(t, '{pattern}', {group}) v
          from d where regexp_matches(t, '{pattern}'))
  ) where s.val >= {least}"""


OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
found as (""" + " union all ".join([
    _span_sql("assign", 0, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    _span_sql("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    _span_sql("hex", 2, "[0-9a-f]{24,}", 0, 24),
]) + r"""
), by_doc as (
  select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
    string_agg(kind || ':' || start::long || ':' || stop::long, ',' order by start, nth) spans
  from found group by doc_id
)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans
from d left join by_doc using (doc_id)
"""

def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.divergences(table(spark, folder, "documents"))


OP11_SQL = r"""
with d as (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents
), g as (select distinct lang, source from d),
c as (select r, lang, source, term, count(*) n from (select r, lang, source, unnest(w) term from d) group by all),
kept as (select lang, term, sum(n)::hugeint total from c group by all having count(*) >= 3),
size as (select lang, count(*)::hugeint v, sum(total)::hugeint lang_n from kept group by all),
n as (select lang, source, term, sum(n)::hugeint n from c semi join kept using (lang, term) group by all),
gn as (select lang, source, coalesce(sum(n), 0)::hugeint group_n from g left join n using (lang, source) group by all),
p as (
  select lang, source, term, coalesce(n, 0) n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (group_n + v) p, 1 + 1000000000::hugeint * (total + 1) // (lang_n + v) ql
  from gn join kept using (lang) join size using (lang) left join n using (lang, source, term)
), pairs as (
  select a.lang, a.source, 'pair' part, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) s from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs q on q.lang = a.lang and q.source = a.source and q.item = b.source
  union all select lang, source, 'term', term, ((p - ql) * (p - ql) // ql)::bigint from p where n > 0 and p > ql
)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every) where part = 'pair' or rank <= 200
"""


def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct coalesce(item_id::varchar, '') item, least(len(w), 10) l, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) s from b where len(w) > 0)),
spot as (select doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') t from (
  select doc_id, w, l, unnest(range(1, len(w) - l + 2)) s from d, (select distinct l from win) where len(w) >= l)),
occ as (select doc_id, s, l, item from spot join win using (l, t)),
hit as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(s, s + l)) k from (select distinct doc_id, s, l from occ)) group by doc_id),
held as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from occ) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join held using (doc_id)
"""


def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.transform(table(spark, folder, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
with t as (select doc_id, coalesce(text, '') t, length(coalesce(text, ''))::bigint n, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
h as (select *, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from t),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form
  from h
)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    else '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end) output_sha256,
  sha256(t) restored_sha256
from c
"""


QUERIES = {
    "op1_language": op1_language,
    "op2_pack": op2_pack,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_lattice_dedup": op6_lattice_dedup,
    "op7_passages": op7_passages,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_decontaminate": op12_decontaminate,
    "op13_infill": op13_infill,
}
CHECKS = {
    "op5_exact_dedup": OP5_SQL,
    "op6_lattice_dedup": OP6_SQL,
    "op7_passages": OP7_SQL,
    "op8_secret_scan": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_decontaminate": OP12_SQL,
    "op13_infill": OP13_SQL,
}
