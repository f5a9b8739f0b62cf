"""Thin queries over the corpus operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, jaccard, langid, lmscore, media, mixing, pieces, rptrees, suffixes, urls
from .common import saved, table

#: A public vocabulary; it stays where it is installed.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rptrees.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = htmltext.train(htmltext.labelled_pages())
    return htmltext.extract(table(spark, sf_dir, "pages"), field)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = saved(media.stored(table(spark, sf_dir, "documents")), "media")
    return media.described(images).withColumn("feature", F.lower(F.hex("hash"))).drop("hash")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, path: str = PIECES) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), path, with_ids=False, with_nbest=True)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).result()


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("rate")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "score")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _mixing_sql() -> str:
    """The mix with its rates in closed form: the water level is the greatest that any number of capped sources leaves."""
    step = """
    c{k} as (select *, round(sum(size * (rate - copies)) over (partition by source, bucket), 6) as lack from c{j}),
    d{k} as (select *, size > 0 and case when lack > 0 then copies < 3 else copies > 0 end as can from c{k}),
    e{k} as (select *, sum(case when can then size else 0 end) over (partition by source, bucket order by size, ord, doc_id rows unbounded preceding) as run, sum(size) over (partition by source, bucket) as words from d{k}),
    f{k} as (select doc_id, source, size, source_size, target, rate, bucket, ord, copies + case when can and (run <= abs(lack) or (lack < -0.1 * words * rate and run = size)) then cast(sign(lack) as bigint) else 0 end as copies from e{k}),
    """
    steps = "".join(step.format(k=k, j=k) .replace(f"from c{k}),", f"from {'b' if k == 0 else f'f{k - 1}'}),", 1) for k in range(mixing.CORRECTIONS))
    return rf"""
    with sizes as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as ord from documents),
    sums as (select source, cast(sum(size) as bigint) as source_size, count(*) as n from sizes group by source),
    weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1.0::double as weight, 3.0::double * source_size as cap from sums),
    levels as (select (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as level from weighed),
    targets as (select source, source_size, n, least(cap, (select max(level) from levels) * weight) as target from weighed),
    rates as (select *, case when target > 0 then least(round(target / source_size, 12), 3.0) else 0.0 end as rate from targets),
    a as (select s.*, r.source_size, r.target, r.rate, cast(('0x' || substring(ord, 1, 8)) as bigint) % cast(ceil(n / {mixing.BUCKET_ROWS}) as bigint) as bucket from sizes s join rates r on s.source is not distinct from r.source),
    p as (select *, row_number() over (partition by source, bucket order by size, ord, doc_id) as place, bucket * 0.6180339887498949::double + 0.5 as q from a),
    b as (select doc_id, source, size, source_size, target, rate, bucket, ord, cast(floor(round(rate * place + (q - floor(q)), 9)) - floor(round(rate * (place - 1) + (q - floor(q)), 9)) as bigint) as copies from p),
    {steps}
    done as (select * from f{mixing.CORRECTIONS - 1})
    select doc_id, size, source_size, target, copies, copies * size as taken from done"""


_JACCARD_SQL = r"""
    with recursive words as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
    lists as (select doc_id, case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as l from words),
    sets as (select distinct doc_id, unnest(l) as s from lists),
    sizes as (select doc_id, count(*) as n from sets group by doc_id),
    shared as (select a.doc_id as x, b.doc_id as y, count(*) as common from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * common >= 85 * (p.n + q.n - common)),
    edges as (select x, y from links union all select y, x from links),
    reach as (select doc_id as d, doc_id as c from documents union select e.y, r.c from reach r join edges e on e.x = r.d)
    select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, c as component_id from (select d, min(c) as c from reach group by d) r join documents on d = doc_id left join sizes using (doc_id)"""

_EMBEDDING_SQL = """
    with recursive sound as (select vec_id, embedding::double[] as v, label from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as x, b.vec_id as y from sound a join sound b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
    edges as (select x, y from links union all select y, x from links),
    degrees as (select x, count(*) as k from edges group by x),
    reach as (select vec_id as d, vec_id as c from embeddings union select e.y, r.c from reach r join edges e on e.x = r.d)
    select vec_id, cast(coalesce(k, 0) as bigint) as n_links, c as component_id, vec_id = c as kept from (select d, min(c) as c from reach group by d) r join embeddings on d = vec_id left join degrees on x = vec_id"""


def _removal_sql() -> str:
    """Windows of both lengths by their starts, as hex digits, cut from parts of 2,000 bytes; positions that repeat make runs."""

    def runs(w: int) -> str:
        return f"""
    p{w} as (select doc_id, part + i as pos, hash(substring(h, 2 * i + 1, {2 * w})) as k from (select doc_id, part, n, substring(hx, 2 * part + 1, {2 * (2000 + w)}) as h from texts, unnest(range(0, n, 2000)) as u(part)) q, unnest(range(0, least(2000, n - part - {w - 1}))) as v(i)),
    r{w} as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by k) as c from p{w}) where c > 1),
    f{w} as (select doc_id, pos, case when pos <= lag(pos) over (partition by doc_id order by pos) + {w} then 0 else 1 end as fresh from r{w}),
    i{w} as (select doc_id, min(pos) as a, max(pos) + {w} as b from (select *, sum(fresh) over (partition by doc_id order by pos) as g from f{w}) group by doc_id, g),"""

    return rf"""
    with texts as (select row_number() over () as doc_id, doc_id as id, hex(encode(coalesce(text, ''))) as hx, cast(len(hex(encode(coalesce(text, '')))) // 2 as bigint) as n from documents),
    {runs(suffixes.LENGTH)}
    {runs(suffixes.SHORT)}
    removed as (select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans from i{suffixes.LENGTH} group by doc_id),
    cuts as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from i{suffixes.LENGTH}),
    kept as (select t.doc_id, sha256(unhex(string_agg(substring(hx, 2 * since + 1, 2 * (a - since)), '' order by a) || substring(any_value(hx), 2 * max(b) + 1))) as sha from cuts join texts t using (doc_id) group by t.doc_id),
    spaced as (select doc_id, b - a as m, regexp_replace(regexp_replace(substring(hx, 2 * a + 1, 2 * (b - a)), '(..)', '\1 ', 'g'), '(20|09|0A|0B|0C|0D) ', '_', 'g') as bytes from i{suffixes.SHORT} join texts using (doc_id)),
    passages as (select doc_id, count(*) as n_passages, cast(sum(m) as bigint) as passage_bytes from spaced where len(regexp_extract_all(bytes, '[^_]+')) > {suffixes.WORDS} group by doc_id)
    select t.id as doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(sha, sha256(unhex(hx))) as kept_sha256, coalesce(n_passages, 0) as n_passages, coalesce(passage_bytes, 0) as passage_bytes
    from texts t left join removed using (doc_id) left join kept using (doc_id) left join passages using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": _EMBEDDING_SQL, "op5_suffix_array_dedup": _removal_sql(), "op7_ngram_jaccard": _JACCARD_SQL, "op8_source_mixing": _mixing_sql()}
