"""The registered opN queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkgrove.llm.bpe import encode_decode
from sparkgrove.llm.exact_dedup import exact_dedup
from sparkgrove.llm.language import language_id
from sparkgrove.llm.mixing import mix
from sparkgrove.llm.near_dedup import near_groups
from sparkgrove.llm.neighbours import search
from sparkgrove.llm.pseudonyms import pseudonymise
from sparkgrove.llm.sharding import shard
from sparkgrove.llm.substring_dedup import remove_repeats
from sparkgrove.llm.wavelet import token_output


def tokenizer_path() -> str:
    """The public vocabulary file of the contract; every operator takes its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key; without one, a key that hides nothing and suits test data only."""
    return spark.conf.get("spark.sparkgrove.pseudonymKey", "public test key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": lambda s, d: remove_repeats(documents(s, d)),
    "op2_neighbours": lambda s, d: search(s.read.parquet(f"{d}/embeddings.parquet")),
    "op3_bpe": lambda s, d: encode_decode(documents(s, d), tokenizer_path()),
    "op4_sharding": lambda s, d: shard(documents(s, d)),
    "op5_language_id": lambda s, d: language_id(documents(s, d)),
    "op6_exact_dedup": lambda s, d: exact_dedup(documents(s, d)),
    "op7_pii": lambda s, d: pseudonymise(documents(s, d), pseudonym_key(s)),
    "op8_mixing": lambda s, d: mix(documents(s, d)).select("doc_id", "size", "source_size", "target", "taken"),
    "op9_token_output": lambda s, d: token_output(documents(s, d), tokenizer_path()),
    "op10_near_dedup": lambda s, d: near_groups(documents(s, d), width=3, percent=85),
}

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""with t as materialized (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
pieces as (select doc_id, unnest(regexp_extract_all(h, '.{1,256}')) x, unnest(range(128, 128 + len(h) // 2, 128)) - 127 first from t),
wide as (select doc_id, first, x || coalesce(lead(x) over (partition by doc_id order by first)[:98], '') x from pieces),
p as materialized (select doc_id, first + j i, s from (select doc_id, first, j, x[2 * j + 1:2 * j + 100] s from (select *, unnest(range(least(128, len(x) // 2 - 49))) j from wide))),
least_of as materialized (select s, min(doc_id) m from p group by s having min(doc_id) < max(doc_id)),
starts as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) step from p join least_of using (s) where m < doc_id),
numbered as (select *, count_if(step is null or step > 50) over (partition by doc_id order by i rows unbounded preceding) run from starts),
runs as (select doc_id, run, min(i) a, max(i) + 49 z from numbered group by doc_id, run),
gaps as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) before from runs),
cut as (select g.doc_id, sum(z - a + 1)::bigint n_removed, count(*) n_spans, max(z) last, string_agg(h[2 * before + 1:2 * (a - 1)], '' order by a) head from gaps g join t on t.doc_id = g.doc_id group by g.doc_id)
select t.doc_id, len(h)::bigint // 2 n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1:])) kept_sha256
from t left join cut on cut.doc_id = t.doc_id""",
    "op4_sharding": r"""with recursive d as materialized (select row_number() over () r, doc_id, coalesce(doc_id::varchar, 'null') || ':' k, encode(coalesce(text, '')) b from documents),
bytes as (select r, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::bigint) l from d),
sums as (select r, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, l), lambda c, x: xor(c >> 8,
  xor(xor(xor((xor(c, x) & 1) * 1996959894, (xor(c, x) >> 1 & 1) * 3993919788), xor((xor(c, x) >> 2 & 1) * 124634137, (xor(c, x) >> 3 & 1) * 249268274)),
      xor(xor((xor(c, x) >> 4 & 1) * 498536548, (xor(c, x) >> 5 & 1) * 997073096), xor((xor(c, x) >> 6 & 1) * 1994146192, (xor(c, x) >> 7 & 1) * 3988292384)))))) text_crc32 from bytes),
nodes(grown, level, place, child, weight) as (
  select false, 'region', 'region/' || i, i, 8 from range(2) t(i) union all
  select true, 'region', 'region/' || i, i, case i when 2 then 1 else 8 end from range(3) t(i) union all
  select g, 'rack', 'rack' || i || '/' || j, j, 4 from range(2) t(i), range(2) u(j), (values (false), (true)) v(g) union all
  select g, 'shard', 'shard' || s // 8 || '.' || s // 4 % 2 || '/' || s, s, 1 from range(16) t(s), (values (false), (true)) v(g)),
draws as (select r, grown, level, place, child, -ln((('0x' || md5(k || place)[1:12])::bigint::double + 0.5::double) / 281474976710656::double) / weight::double score from d, nodes),
region as (select r, grown, arg_min(child, score) region from draws where level = 'region' group by r, grown),
rack as (select r, grown, region, arg_min(child, score) rack from draws join region using (r, grown) where level = 'rack' and place like 'rack' || region || '/%' group by all),
leaf as (select r, grown, arg_min(child, score) leaf from draws join rack using (r, grown) where level = 'shard' and place like 'shard' || region || '.' || rack || '/%' group by all),
placed as (select d.r, doc_id, octet_length(b) + 1 size, text_crc32, l.leaf shard, coalesce(g.leaf, 16) grown_shard,
    floor((('0x' || md5(k || 'part')[1:12])::bigint::double + 0.5::double) / 281474976710656::double * 64) part
  from d join sums using (r) join leaf l on l.r = d.r and not l.grown left join leaf g on g.r = d.r and g.grown)
select doc_id, size, text_crc32, 'key' law, shard::int shard, row_number() over (partition by shard order by part, doc_id, text_crc32, size) - 1 slot, grown_shard::int grown_shard from placed""",
    "op6_exact_dedup": r"""with t as (select doc_id, length(coalesce(text, '')) len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by norm) group_size, row_number() over w = 1 kept, sha256(norm) text_sha256
from t window w as (partition by norm order by len desc, doc_id rows between unbounded preceding and unbounded following)""",
    "op10_near_dedup": r"""with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as materialized (select distinct doc_id, unnest(case when len(ws) between 1 and 2 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) g from w),
n as materialized (select doc_id, count(*) n from s group by doc_id),
p as materialized (select a.doc_id u, b.doc_id v, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as materialized (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
links as materialized (select u, v from e union select v, u from e),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
least_of as (select u, min(v) m from reach group by u)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) kept
from documents d left join n on n.doc_id = d.doc_id left join least_of on u = d.doc_id""",
    "op8_mixing": r"""with base as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
  (('0x' || md5(doc_id::varchar || ':17')[1:12])::bigint::double + 0.5::double) / 281474976710656::double u from documents),
per as (select source, sum(size)::bigint source_size, 3 * sum(size)::bigint cap, (row_number() over (order by source nulls last) - 1) % 3 + 1 w from base group by source),
rests as (select *, sum(source_size) over () - coalesce(sum(cap) over b, 0) rest, sum(w) over () - coalesce(sum(w) over b, 0) rest_w from per
  window b as (order by cap::double / w::double, source nulls last rows between unbounded preceding and 1 preceding)),
goal as (select source, source_size, case when capped then cap::double else w::double * max(case when not capped then rest::double / rest_w::double end) over () end target
  from (select *, cap * rest_w <= w * rest capped from rests)),
rated as (select b.*, source_size, target, case when source_size > 0 then least(3::double, target * 1::double / source_size::double) else 0::double end rate from base b join goal g on b.source is not distinct from g.source),
ranked as (select *, floor(rate) whole, rate - floor(rate) f from rated),
keyed as (select *, case when f > 0 then u * (1::double - f) / (u * (1::double - f) + (1::double - u) * f) when rate < 3 then 1::double end rank from ranked),
runs as (select *, target - sum(size * whole) over (partition by source) need, sum(size) over (partition by source, rank is null order by rank, doc_id, size rows unbounded preceding)::double upto from keyed)
select doc_id, size, source_size, target, (size * (whole + case when rank is not null and need - (upto - size) > 0 and upto - need <= need - (upto - size) then 1 else 0 end))::bigint taken from runs""",
}
