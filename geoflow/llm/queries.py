"""The operators as queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm import (decontaminate, lexical_search, licenses, ngram_join, phrases, quality_net, quality_rules, secrets, sentencepiece,
                         substring_dedup, threshold_search, toxicity, warc)
from geoflow.llm.common import table
from geoflow.session import fresh_path


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(warc.page_records(pages), path)
    kind = pages.schema["page_id"].dataType

    def page(name: str):
        return F.regexp_extract(name, "^urn:page:(.+)$", 1)

    # Each kind by its own pushed predicate; payloads are decoded and checked where there are any.
    responses = warc.read_archives(spark, path, payload="false", verify="true").where("record_type = 'response'")
    revisits = warc.read_archives(spark, path, payload="false").where("record_type = 'revisit'")
    return responses.unionByName(revisits).select(
        F.when(page("record_id") != "", page("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).cast(kind).alias("refers_to"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents where text is not null),
shingle as materialized (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: list_slice(w, i, i + 3))) s
  from words where len(w) > 0),
size as materialized (select doc_id, count(*) n from shingle group by all),
pair as (select a.doc_id a, b.doc_id b, count(*) common from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as materialized (
  select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
edge as materialized (select a, b from link union select b, a from link),
reach(node, other) as (select a, b from edge union select r.node, e.b from reach r join edge e on e.a = r.other)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) component_id
from documents d left join size using (doc_id) left join (select node doc_id, min(other) low from reach group by all) using (doc_id)
"""

OP3_SQL = r"""
with word as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
item as materialized (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where text is not null),
win as materialized (
  select distinct item_id, n, list_slice(w, i, i + n - 1) g
  from (select item_id, w, least(len(w), 13) n, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from item where len(w) > 0)),
size as (select distinct n from win),
spot as materialized (
  select doc_id, n, pos, item_id from (
    select doc_id, n, i pos, list_slice(w, i, i + n - 1) g from (
      select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from word, size where len(w) >= n)) join win using (n, g)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(pos, pos + n)) p from spot) group by all),
own as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) items
        from (select distinct doc_id, item_id from spot) group by all)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from word left join hit using (doc_id) left join own using (doc_id)
"""

OP9_SQL = r"""
with doc as materialized (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
win as materialized (select r, i, hash(substr(h, 2 * i::int + 1, 400)) a, hash('x' || substr(h, 2 * i::int + 1, 400)) b
  from (select r, h, unnest(range(0, len(h) // 2 - 199)) i from doc where len(h) >= 400)),
often as (select a, b from win group by all having count(*) > 1),
hit as materialized (select r, i from win join often using (a, b)),
edge as (select r, i, coalesce(i > lag(i) over (partition by r order by i) + 200, true) starts from hit),
span as materialized (select r, min(i) low, max(i) + 200 high from (select r, i, sum(starts::int) over (partition by r order by i) k from edge) group by r, k),
gap as (
  select r, low, high, coalesce(lag(high) over (partition by r order by low), 0) since from span),
kept as (
  select r, string_agg(substr(h, 2 * since::int + 1, 2 * (low - since)::int), '' order by low) front, max(high) tail, sum(high - low)::bigint n_removed, count(*) n_spans
  from gap join doc using (r) group by r)
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
       sha256(from_hex(case when front is null then h else front || substr(h, 2 * tail::int + 1) end)) kept_sha256
from doc left join kept using (r)
"""

OP10_SQL = r"""
with word as materialized (
  select doc_id, coalesce(text, '') t, lower(regexp_extract(coalesce(lang, ''), '^([A-Za-z]{2,3})([-_].*)?$', 1)) lang,
         text is not null and regexp_matches(coalesce(lang, ''), '^([A-Za-z]{2,3})([-_].*)?$') known,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') low
  from documents),
line as (select doc_id, count(*) - count(distinct l) n from (select doc_id, unnest(string_split(t, chr(10))) l from word)
         where regexp_matches(l, '[^\x20\x09-\x0D]') group by all),
win as materialized (select doc_id, i, list_slice(w, i, i + 2) g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from word)),
often as (select doc_id, g from win group by all having count(*) > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 3)) p from win join often using (doc_id, g)) group by all),
class as materialized (
  select doc_id, lang, known, k, n from (
    select doc_id, lang, known, unnest([0, 1, 2, 3, 4, 5, 6]) k, unnest([
      len(regexp_replace(t, '[^a-z]', '', 'g')), len(regexp_replace(t, '[^A-Z]', '', 'g')), len(regexp_replace(t, '[^0-9]', '', 'g')),
      len(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')), len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')),
      len(regexp_replace(t, '[a-zA-Z0-9\x20\x09-\x0D#*$%&|<>\x{80}-\x{10FFFF}]', '', 'g')), len(regexp_replace(t, '[\x00-\x7F]', '', 'g'))]) n from word)),
class_ref as (select lang, k, sum(n) / sum(sum(n)) over (partition by lang) q from class where known group by lang, k),
token as materialized (select doc_id, lang, known, x, count(*) n from (select doc_id, lang, known, unnest(low) x from word) group by all),
total as materialized (select lang, sum(n) n from token where known group by lang having sum(n) >= 2000),
common as materialized (
  select lang, x, sum(n) n from token where known group by lang, x
  qualify row_number() over (partition by lang order by sum(n) desc, x) <= 64),
word_ref as (
  select lang, x, c.n / t.n q from common c join total t using (lang)
  union all select lang, '', 1 - sum(c.n) / any_value(t.n) from common c join total t using (lang) group by lang),
ref as materialized (  -- an unknown language is measured against all
  select doc_id, total.lang ref from word join total on total.lang = word.lang or word.lang = ''),
class_far as (
  select doc_id, min(d) d from (
    select doc_id, ref, sqrt(greatest(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2, 0)) d
    from (select doc_id, k, n / sum(n) over (partition by doc_id) p from class) x join ref using (doc_id) join class_ref r on r.lang = ref and r.k = x.k
    group by doc_id, ref) group by doc_id),
own as (
  select doc_id, ref, case when c.x is null then '' else t.x end x, sum(t.n) n
  from token t join ref using (doc_id) left join common c on c.lang = ref and c.x = t.x group by all),
each as (select doc_id, ref, x, q from (select distinct doc_id, ref from own) join word_ref on word_ref.lang = ref),
word_far as (
  select doc_id, min(d) d from (
    select doc_id, ref, sqrt(greatest(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2, 0)) d
    from (select doc_id, ref, q, coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by doc_id, ref) p from each left join own using (doc_id, ref, x))
    group by doc_id, ref) group by doc_id),
base as (
  select doc_id, len(w)::bigint n_words, coalesce(len(array_to_string(w, '')), 0)::bigint word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(line.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words
  from word left join line using (doc_id) left join rep using (doc_id)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from base)
select f.*, not base_failed and not (n_words >= 50 and coalesce(c.d, 0) > 0.3) and not (n_words >= 100 and coalesce(w.d, 0) > 0.42) kept
from failed f left join class_far c using (doc_id) left join word_far w using (doc_id)
"""

OP7_SQL = r"""
with page as (
  select page_id, coalesce(html, '') body, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) hex from pages),
shown as (
  select *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * g::int, 5))::int >> (15 - 5 * k::int)) & 31), 1)), '')), '') payload_digest,
    min(page_id) over (partition by body) least from page)
select page_id, payload_bytes, payload_digest, case when page_id = least then 'response' else 'revisit' end record_type,
       case when page_id = least then null else least end refers_to
from shown
"""

OP11_SQL = r"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
score as (
  select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int rank, vec_id, score
from score qualify rank <= 5
"""

OP12_SQL = r"""
with piece as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p
  from documents where text is not null),
word as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from piece),
total as materialized (select lang, sum(len(w))::bigint n from word group by lang),
gram as materialized (
  select lang, k, phrase, count(*) f from (
    select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') phrase from (
      select lang, w, k, unnest(range(1, len(w) - k + 2)) i from (select lang, w, unnest([1, 2, 3, 4, 5]) k from word) where len(w) >= k))
  group by all having count(*) >= 100),
cand as materialized (select lang, k, phrase, f a, string_split(phrase, ' ') w from gram where k > 1),
inside as (
  select lang, sub, max(a) f from (
    select lang, a, array_to_string(list_slice(w, i, i + m - 1), ' ') sub from (
      select lang, a, w, m, unnest(range(1, k - m + 2)) i from (select *, unnest(range(2, k)) m from cand)))
  group by all),
cuts as (
  select lang, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') first, array_to_string(list_slice(w, c + 1, k), ' ') rest
  from (select *, unnest(range(1, k)) c from cand)),
scored as (
  select cuts.lang, cuts.phrase, a, x.f l, y.f r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint score
  from cuts join gram x on x.lang = cuts.lang and x.phrase = first join gram y on y.lang = cuts.lang and y.phrase = rest join total on total.lang = cuts.lang
  qualify row_number() over (partition by cuts.lang, cuts.phrase order by score, c) = 1)
select s.lang, row_number() over (partition by s.lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score
from scored s left join inside i on i.lang = s.lang and i.sub = s.phrase
where not coalesce(100 * i.f >= 100 * a, false)
qualify rank <= 2000
"""

OP13_SQL = r"""
with doc as materialized (
  select * from (
    select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents where text is not null) where len(w) > 0),
item as materialized (
  select i, item_id, t, count(*) repeats from (
    select row_number() over () i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) t from benchmark where text is not null)
  group by all),
total as materialized (select count(*)::bigint n_docs, sum(len(w))::bigint n_terms from doc),
size as (select r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms m from doc, total),
tf as materialized (select r, t, count(*) tf from (select r, unnest(w) t from doc) where t in (select t from item) group by all),
weight as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint w from tf, total group by t, n_docs),
score as (
  select i, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from item join weight using (t) join tf using (t) join size using (r) group by i, item_id, r, doc_id)
select item_id, (row_number() over (partition by i order by score desc, doc_id, r))::int rank, doc_id, score
from score where score > 0 qualify rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontamination": op3_decontamination,
    "op4_quality_net": op4_quality_net,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_secrets": op8_secrets,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_threshold_search": op11_threshold_search,
    "op12_phrases": op12_phrases,
    "op13_lexical_search": op13_lexical_search,
}
SQL: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op3_decontamination": OP3_SQL, "op7_warc": OP7_SQL, "op9_suffix_dedup": OP9_SQL,
                       "op10_quality_rules": OP10_SQL, "op11_threshold_search": OP11_SQL, "op12_phrases": OP12_SQL,
                       "op13_lexical_search": OP13_SQL}
