"""The registered text queries, each an operator over its whole table, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tinderframe.llm import codes, decontaminate, licences, mixing, ngrams, pieces, prefixtree, simhash, spans, tokencount, topk, toxicity, urls
from tinderframe.llm.common import share
from tinderframe.session import cut_lineage

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_URL_SQL = r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule
  from p)
select page_id, host, path, rule,
       case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
from r"""


@query("op1_url_filter", _URL_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


TOXIC_AT = 0.7


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(share(F.col("doc_id"), 3) != 1)
    model = toxicity.train(docs, labels)
    out = docs.select(
        "doc_id",
        F.coalesce(share(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        toxicity.score(F.col("text"), model).alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


TOKEN_LIMIT = 2048


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counts = tokencount.token_counts(F.col("text"), public_tokenizers.path("word_bpe_49k.json"))
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counts.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


#: Runs of two sentences and more; fewer words than this are trivial lines.
SPAN_FLOOR = 8


@query("op5_span_dedup")
def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.dedup_spans(table(spark, sf_dir, "documents"), min_words=SPAN_FLOOR)
    return out.select("doc_id", F.col("__sentences").alias("n_sentences"), F.size("__removed").alias("n_removed"), F.col("__removed").alias("removed"), "text")


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_LEAK_SQL = r"""
with lower_d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
lower_b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, array_to_string(w[s:s + 9], ' ') as g, least(len(w), 10) as n
        from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as s from lower_b where len(w) > 0)),
sizes as (select distinct n from win),
grams as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g
          from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from lower_d, sizes where len(w) >= n)),
occ as (select distinct g.doc_id, g.s, g.n, g.g from grams g semi join win on win.g = g.g and win.n = g.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as list
        from (select distinct occ.doc_id, win.item_id::varchar as i from occ join win on win.g = occ.g and win.n = occ.n) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lower_d d left join hit on hit.doc_id = d.doc_id left join its on its.doc_id = d.doc_id"""


@query("op6_decontaminate", _LEAK_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("__id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = share(F.col("doc_id"), 5)
    docs = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "text")
    model = ngrams.train(docs.filter("not held_out"))
    out = ngrams.score_texts(docs, model)
    tokens = F.lit(model.tokens).cast("long").alias("train_tokens")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", tokens, "base_score", "score", ngrams.perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))


_TOPK_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
n as (select r, vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from v),
s as (select q.r, c.r as other, any_value(q.vec_id) as query_id, any_value(c.vec_id) as vec_id, sum(q.x * c.x)::bigint as score
      from n q join n c on q.i = c.i and q.r <> c.r where q.vec_id % 20 = 0 group by q.r, c.r)
select query_id, rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id)::int as rank from s) where rank <= 20"""


@query("op7_topk", _TOPK_SQL)
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(64) * x.cast("double")))
    vectors = rows.select("vec_id", F.when(topk.finite(F.col("embedding")), whole).alias("v"))
    return topk.top_k(vectors, 20, F.col("vec_id") % 20 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op9_licence_scan")
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Three kinds of source: steady, fading out, and coming in towards the end.
CURRICULUM = [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 2.0), (1.0, 0.0)], [(0.0, 0.0), (0.5, 1.0), (1.0, 2.0)]]
_MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as o, md5(coalesce(text, '')) as o2
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
k as (select *, [3.0::double, 1.0::double, 2.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from s),
l as (
  select *, (sum(source_size) over () * 1.5::double
             - 2.0::double * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as level
  from k),
f as (select *, level * weight >= source_size * 2.0::double as is_full from l),
t as (
  select source, source_size, case when is_full then source_size * 2.0::double
         else (select arg_min(level, source_size / weight) from f where not is_full) * weight end as target
  from f),
p as (
  select d.*, coalesce(sum(size) over (partition by source order by o, o2 rows between unbounded preceding and 1 preceding), 0)::bigint as off
  from d),
j as (select p.*, t.source_size, t.target, round(t.target)::bigint as wanted from p join t on p.source is not distinct from t.source),
n as (select *, case when source_size > 0 then wanted // source_size else 0 end as passes from j)
select doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, wanted - passes * source_size - off)))::bigint as taken
from n"""


@query("op10_mix_sources", _MIX_SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    placed = mixing.positions(mixed, CURRICULUM)
    first = F.get("positions", F.lit(0))
    return placed.sort(first.asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


@query("op11_pieces")
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Conversations of one group start with up to three turns of the group's first one.
GROUP, MOST_SHARED = 20, 3
_TREE_SQL = r"""
with t as (
  select conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t,
         row_number() over (partition by conv_id order by turn nulls first,
           md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
c as (select conv_id, list(t order by pos) as t from t group by conv_id),
h as (
  select c.conv_id, c.t, b.t as bt, xor(list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(string_split(c.conv_id::varchar, ''), lambda x: list_transform(range(8), lambda i: (ord(x) >> i) & 1)))),
    lambda a, bit: case when xor(a, bit) & 1 = 1 then xor(xor(a, bit) >> 1, 3988292384::bigint) else xor(a, bit) >> 1 end), 4294967295::bigint) % 4 as h
  from c left join c b on b.conv_id = c.conv_id - c.conv_id % 20),
r as (select conv_id, list_concat(coalesce(bt[1 : h], []), t[h + 1 :]) as s from h),
m as (select conv_id, d, s[1 : d] as p, d = len(s) as is_end from (select *, unnest(range(0, len(s) + 1)) as d from r)),
n as (
  select p, d, min(conv_id) as conv_id, count(*) as n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '')) as ends,
         (count(*) - 1) * case when d > 0 then len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) else 0 end as own
  from m group by p, d),
k as (select p[1 : d - 1] as p, count(*) as kids from n where d > 0 group by 1),
f as (select n.*, coalesce(kids, 0) as kids from n left join k on k.p = n.p),
u as (select p[1 : a] as p, count(*) filter (kids = 0) as leaves, sum(own) as saved from (select *, unnest(range(0, d + 1)) as a from f) group by 1)
select f.conv_id, f.d as depth, q.conv_id as parent_conv_id, f.n as n_convs, f.kids as n_children, u.leaves as n_leaves,
       u.saved::bigint as saved_tokens, f.ends as ends_sha256
from f join u on u.p = f.p left join n q on q.d = f.d - 1 and q.p = f.p[1 : f.d - 1]"""


@query("op12_prefix_tree", _TREE_SQL)
def op12_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtree.turn_records(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    turns = cut_lineage(turns, "turns")
    conv = F.col("conv_id")
    paths = prefixtree.follow_template(turns, conv - conv % GROUP, share(conv, MOST_SHARED + 1), MOST_SHARED)
    out = prefixtree.prefix_tree(cut_lineage(paths, "rebuilt"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CODES_SQL = """
with v as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select vec_id, label, i as part, v[i * (len(v) // 16) + 1 : (i + 1) * (len(v) // 16)] as x from v, (select unnest(range(16)) as i)),
b0 as (select part, e - 1 as e, x from (select *, row_number() over (partition by part order by vec_id) as e from p) where e <= 64),
"""
for _i in range(3):
    _CODES_SQL += f"""d{_i} as (
  select p.part, p.vec_id, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from p join b{_i} b on b.part = p.part),
a{_i} as (select part, vec_id, min({{'d': d, 'e': e}}) as best from d{_i} group by part, vec_id),
"""
    if _i < 2:
        _CODES_SQL += f"""m{_i} as (
  select part, e, list(z order by k) as x from (
    select a.part, a.best.e as e, k, floor(sum(p.x[k])::double / count(*))::bigint as z
    from a{_i} a join p on p.part = a.part and p.vec_id = a.vec_id, (select unnest(range(1, 1 + (select max(len(x)) from p))) as k)
    group by all) group by part, e),
b{_i + 1} as (select b.part, b.e, coalesce(m.x, b.x) as x from b{_i} b left join m{_i} m on m.part = b.part and m.e = b.e),
"""
_CODES_SQL += """r as (
  select vec_id, string_agg(lpad(format('{:x}', best.e), 2, '0'), '' order by part) as code, sum(best.d)::bigint as error from a2 group by vec_id),
s as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) as h from b2)
select r.vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, s.h as codebooks_sha256
from r join v on v.vec_id = r.vec_id, s"""
#: Labels up to which their sums are sent to every task.
BROADCAST_LABELS = 100_000


@query("op13_codes", _CODES_SQL)
def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    vectors = rows.select("vec_id", "label", F.when(codes.finite(F.col("embedding")), whole).alias("v"))
    out, books = codes.encode(vectors, "v", "vec_id", parts=16, entries=64, rounds=2)
    out = cut_lineage(out, "codes")
    per_label = out.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(per_label) if out.agg(F.approx_count_distinct("label")).first()[0] <= BROADCAST_LABELS else per_label
    code = F.array_join(F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    joined = out.join(sums, out["label"].eqNullSafe(sums["l"]))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(books.text().encode()).hexdigest()).alias("codebooks_sha256"))
