"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import added_tokens, pack

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_all

    scored = score_all(_table(spark, sf_dir, "documents"), lambda name: F.crc32(name) % 7 == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import topk

    return topk(_table(spark, sf_dir, "embeddings"), k=10, query_every=100, scale=1024)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"), k=4, similarity=(85, 100)).select("doc_id", "n_shingles", "component_id")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = _table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    found, _ = identify(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so the bytes of each document's text are taken as 8-bit PCM."""
    from .media import align_lists

    docs = _table(spark, sf_dir, "documents")
    return align_lists(docs.select(F.col("doc_id").alias("rec_id"), F.encode("text", "UTF-8").alias("payload")), query_every=50)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0).select("doc_id", "size", "source_size", "target", "taken")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("rid")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress

    coded, _ = compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, verified

    found = verified(manifest(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_lm": op3_lm,
    "op4_topk": op4_topk,
    "op5_jaccard": op5_jaccard,
    "op6_langid": op6_langid,
    "op7_license": op7_license,
    "op8_media": op8_media,
    "op9_html": op9_html,
    "op10_mixing": op10_mixing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_codes": op12_codes,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
     d as (select page_id, octet_length(encode(h))::bigint b, sha256(h) s from p),
     f as (select s, min(page_id) m from d where b >= 100 group by s)
select d.page_id, d.b as payload_bytes, d.s as payload_digest,
       case when f.m < d.page_id then 'revisit' else 'response' end as record_type,
       case when f.m < d.page_id then f.m end as refers_to
from d left join f using (s)""",
    "op4_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
           from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op5_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                                        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as i, b.doc_id as j from x a join x b on a.g = b.g and a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(i, c) as (select doc_id, doc_id from s union select p.j, r.c from r join p on r.i = p.i)
select s.doc_id, any_value(len(s.s))::bigint as n_shingles, min(r.c) as component_id from s join r on r.i = s.doc_id group by s.doc_id""",
}

ORACLE_SQL["op11_exact_dedup"] = r"""
with d as (select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as s from documents),
g as (select *, first_value(doc_id) over (partition by s order by points desc, doc_id) as k, count(*) over (partition by s) as n from d)
select doc_id, k as keep_id, n as group_size, doc_id = k as kept, s as text_sha256 from g"""



def _codes_sql(rounds: int = 2) -> str:
    """The rounds one after another, every part against every entry of its codebook."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (select vec_id, p, any_value(x) as x, arg_min(e, (d, e)) as e, min(d) as d
       from (select v.vec_id, v.p, v.x, c.e, list_sum(list_transform(list_zip(v.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v join c{i} c using (p)) group by vec_id, p)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select p, e, list(floor(s::double / n)::bigint order by j) as y from (select p, e, j, sum(x[j]) as s, count(*) as n from a{i}, range(1, 65) r(j) where j <= len(x) group by p, e, j) group by p, e),
c{i + 1} as materialized (select c.p, c.e, coalesce(m.y, c.y) as y from c{i} c left join m{i} m using (p, e))""")
    return f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select vec_id, p, w[p * (len(w) // 16) + 1 : (p + 1) * (len(w) // 16)] as x from k, range(16) r(p)),
f as (select vec_id, row_number() over (order by vec_id) - 1 as e from k order by vec_id limit 64),
c0 as materialized (select p, e, x as y from v join f using (vec_id)),{",".join(steps)},
h as (select sha256(string_agg(y[j]::varchar, ',' order by p, e, j)) as h from c{rounds}, range(1, 65) r(j) where j <= len(y)),
g as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by vec_id)
select g.vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from g join k using (vec_id), h"""


ORACLE_SQL["op12_codes"] = _codes_sql()
_FIELD = "case when {0} is null then '-' else octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar end"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + ", {}))"
ORACLE_SQL["op13_merkle"] = f"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
            lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t),
d as (select doc_id, '=' || lang as lang, {_LEAF.format(_FIELD.format("text"))} as leaf,
             {_LEAF.format(_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} as changed,
             xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
                             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::bigint) % 3 = 0 as tampered from documents, crc),
p as (select *, coalesce(lang, '-') as tree, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n from d),
t(lvl, tree, i, n, h) as (select 0, tree, i, n, leaf from p union all
    select lvl + 1, tree, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' order by i)) from t where n > 1 group by lvl, tree, i // 8),
top as (select tree, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from t where n = 1),
u(lvl, i, n, h) as (select 0, i, n, h from top union all
    select lvl + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' order by i)) from u where n > 1 group by lvl, i // 8),
x as (select lvl, tree, i, h, lvl as o from t where n > 1 union all select lvl, null, i, h, 1000 + lvl from u where n > 1),
w as (select p.doc_id, p.tree, o, pow(8, x.lvl)::bigint as width, case when x.tree is null then top.i else p.i end as i
      from p join top using (tree) join (select distinct lvl, tree, o from x) x on x.tree = p.tree or x.tree is null),
s as (select w.doc_id, w.o, coalesce(string_agg(x.h, '' order by x.i) filter (x.i < w.i // width), '') as l,
             coalesce(string_agg(x.h, '' order by x.i) filter (x.i > w.i // width), '') as r
      from w join x on x.o = w.o and (x.tree = w.tree or x.tree is null) and x.i // 8 = w.i // width // 8 group by w.doc_id, w.o),
g as (select doc_id, list(l || '|' || r order by o) as steps, string_agg(l || r, '' order by o) as proof from s group by doc_id),
f as (select p.doc_id, leaf, top.h as subroot, u.h as root, sha256(coalesce(proof, '')) as proof_sha256,
             list_reduce(list_prepend(case when tampered then changed else leaf end, coalesce(steps, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) as folded_root
      from p join top using (tree) join u on u.n = 1 left join g on g.doc_id = p.doc_id)
select *, folded_root = root as verified from f"""


def oracle_sql() -> dict[str, str]:
    from .license import scan_sql

    return ORACLE_SQL | {"op7_license": scan_sql()}
