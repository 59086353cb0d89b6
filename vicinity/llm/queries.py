"""The operators' queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, exact_dedup, filter_audit, html_text, language, media, packing, pii, quality, simhash, spotsigs, toxicity
from .common import table


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.against_edits(table(spark, sf_dir, "documents"))


def stored_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(table(spark, sf_dir, "documents")))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def byte_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), *_vocabulary("byte_bpe_50k.tiktoken"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")[0])


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_crf": languages,
        "op2_html": main_texts,
        "op3_simhash": near_duplicates,
        "op4_media": stored_media,
        "op5_toxicity": toxicity_scores,
        "op6_quality_fm": quality_scores,
        "op7_byte_bpe": byte_bpe_digests,
        "op8_spotsigs": spot_signatures,
        "op9_packing": packed,
        "op10_pii": personal_data,
        "op11_centroids": clusters,
        "op12_filter_audit": filter_orders,
        "op13_exact_dedup": exact_duplicates,
    }


#: A vector's components as integers, first centroids by hash, three rounds of assignment and floored means, and a last assignment.
_DISTANCES = """select v.vec_id, v.row, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: ((p[1] - p[2]) * (p[1] - p[2]))::hugeint)) as d from v, {centroids} c"""
_NEAREST = "select vec_id, row, x, arg_min(cluster, (d, cluster)) as cluster, min(d) as d from ({distances}) group by vec_id, row, x"
_MEANS = """select c.cluster, coalesce(m.x, c.x) as x from {centroids} c left join (
    select cluster, list((s - ((s % n) + n) % n) // n order by i) as x from (
        select cluster, i, sum(x[i])::hugeint as s, count(*) as n from {nearest}, range(1, 65) t(i) group by cluster, i) group by cluster) m using (cluster)"""


def _clusters_sql() -> str:
    steps = [
        "k as (select vec_id, list_transform(embedding, lambda e: e::double) as e, row_number() over () as row from embeddings where len(embedding) = 64)",
        "v as materialized (select vec_id, row, list_transform(e, lambda a: floor(64 * a)::hugeint) as x from k where len(list_filter(e, lambda a: a is not null and isfinite(a))) = 64)",
        "c0 as materialized (select (row_number() over (order by h, x) - 1)::int as cluster, x from (select sha256('1:' || vec_id::varchar) as h, x from v order by h, x limit 16))",
    ]
    for n in range(4):
        steps.append(f"a{n} as materialized ({_NEAREST.format(distances=_DISTANCES.format(centroids=f'c{n}'))})")
        if n < 3:
            steps.append(f"c{n + 1} as materialized ({_MEANS.format(centroids=f'c{n}', nearest=f'a{n}')})")
    return f"""with {", ".join(steps)} select vec_id, a3.cluster::int as cluster, d::bigint as distance,
        (sum(d) over (partition by a3.cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
        sha256(array_to_string(list_transform(c3.x, lambda a: a::varchar), ',')) as centroid_sha256 from a3 join c3 using (cluster)"""


#: Every step of every order by its own count over the documents' masks, without any transform.
_FILTERS_SQL = """
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
        min(doc_id) over (partition by coalesce(text, '')) as first from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as materialized (select part, (len(words) < 200)::int as a, (100 * len(list_distinct(words)) < 50 * len(words))::int as b,
        (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int as c, regexp_matches(text, '[#$%&*|]')::int as d,
        (t.doc_id > first)::int as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic from t left join l using (doc_id)),
w as materialized (select part, [a, b, c, d, e] as fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 3, 4, 5]) as i),
p as (select f1.x || f2.x || f3.x || f4.x || f5.x as filter_order, [f1.i, f2.i, f3.i, f4.i, f5.i] as idx from f f1, f f2, f f3, f f4, f f5
        where len(list_distinct([f1.i, f2.i, f3.i, f4.i, f5.i])) = 5),
s as (select w.part, filter_order, step::int as step, idx[step] as filter, n, good, toxic, fails[idx[step]] = 1 as failing, list_sum(fails) = 1 as alone,
        coalesce(list_sum(list_transform(idx[1:step - 1], lambda j: fails[j])), 0) > 0 as gone from w, p, range(1, 6) r(step)),
o as (select part, filter_order, step, filter, coalesce(sum(n) filter (not failing and not gone), 0)::bigint as kept, coalesce(sum(n) filter (failing and not gone), 0)::bigint as removed,
        coalesce(sum(n) filter (failing and gone), 0)::bigint as redundant, coalesce(sum(n) filter (failing and alone), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (failing and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (failing and not gone), 0)::bigint as toxic_lost from s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from o"""

_DUPLICATES_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256 from t window same as (partition by text)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroids": _clusters_sql(), "op12_filter_audit": _FILTERS_SQL, "op13_exact_dedup": _DUPLICATES_SQL}
