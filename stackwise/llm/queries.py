"""The registered queries of this package, opN_<name>, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprint, lm, mixing, neardup, packing, pii, quality, ranking, sharding, topk, url_filter, word_bpe
from .common import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source", "n_chars", "slot", "shard")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = materialise(url_filter.outcomes_of(pages, table(spark, sf_dir, "labels")), "outcomes")
    return url_filter.judge_pages(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", "labelled")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), block=mixing.BLOCK)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_lm": op5_lm,
    "op6_fingerprint": op6_fingerprint,
    "op7_sharding": op7_sharding,
    "op8_url_filter": op8_url_filter,
    "op9_neardup": op9_neardup,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_word_bpe": op12_word_bpe,
    "op13_ranking": op13_ranking,
}


_TOPK_SQL = f"""
    WITH taken AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
               FROM taken q JOIN taken c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % {topk.QUERY_MODULUS} = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {topk.K}"""


def _sharding_sql() -> str:
    """The table's entries are parameters, so the statement lists them."""
    owners = ",".join(map(str, sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)])))
    return f"""
    WITH slots AS (SELECT doc_id, source, n_chars, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS BIGINT) AS slot FROM documents),
         owners AS (SELECT unnest([{owners}]) AS shard, generate_subscripts([{owners}], 1) - 1 AS slot)
    SELECT s.doc_id, s.source, s.n_chars, s.slot, CAST(o.shard AS INTEGER) AS shard FROM slots s JOIN owners o ON o.slot = s.slot"""


def _url_sql() -> str:
    f = url_filter
    rules = ", ".join(f"('{v}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{t}')" for v, t in f.RULES)

    def strength(children: str) -> str:
        return f"""(SELECT CASE WHEN v - m * (1 - m) / p <= m * (1 - m) / (1 + {f.STRONGEST}) THEN {f.STRONGEST}
            ELSE greatest({f.WEAKEST}, least({f.STRONGEST}, m * (1 - m) / (v - m * (1 - m) / p) - 1)) END
          FROM (SELECT sum(g) / sum(n) AS m, sum(g * g / n) / sum(n) - (sum(g) / sum(n)) ^ 2 AS v, sum(n) / count(*) AS p FROM {children}))"""

    def below(m: str, v: str, *strengths: str) -> str:
        for k in strengths:
            v = f"({v} + ({m} * (1 - {m}) - {v}) / ({k} + 1))"
        return v

    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    parts AS (SELECT page_id, host, path, regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', '') AS named FROM split),
    placed AS (SELECT *, l[1] AS suffix, CASE WHEN len(l) > 1 THEN l[2] || '.' || l[1] ELSE l[1] END AS domain FROM (SELECT *, list_reverse(string_split(named, '.')) AS l FROM parts)),
    rules(says, name, prefix, rule) AS (VALUES {rules}),
    fits AS (SELECT DISTINCT host, path, rule, says FROM parts, rules WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)),
    best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM fits GROUP BY ALL),
    good AS (SELECT doc_id, CAST(min(CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 0) <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS good FROM labels GROUP BY doc_id),
    hosts AS (SELECT named, any_value(domain) AS domain, any_value(suffix) AS suffix, CAST(count(*) AS DOUBLE) AS n, sum(good) AS g FROM placed
              JOIN good ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT) GROUP BY named),
    domains AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(g) AS g FROM hosts GROUP BY domain),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM domains GROUP BY suffix),
    k AS (SELECT (SELECT sum(g) / sum(n) FROM suffixes) AS m, (SELECT sum(n) FROM suffixes) AS nn, {strength('suffixes')} AS ks, {strength('domains')} AS kd, {strength('hosts')} AS kh),
    ms AS (SELECT suffix, n AS ns, (g + m * ks) / (n + ks) AS ms FROM suffixes, k),
    md AS (SELECT domain, n AS nd, (g + ms * kd) / (n + kd) AS md FROM domains JOIN ms USING (suffix), k),
    mh AS (SELECT named, n, (g + md * kh) / (n + kh) AS mh FROM hosts JOIN md USING (domain), k),
    judged AS (SELECT p.page_id, p.host, p.path, n, coalesce(mh, md, ms, m) AS mean,
        coalesce(mh * (1 - mh) / (n + kh + 1), {below('md', 'md * (1 - md) / (nd + kd + 1)', 'kh')}, {below('ms', 'ms * (1 - ms) / (ns + ks + 1)', 'kd', 'kh')}, {below('m', 'm * (1 - m) / (nn + 1)', 'ks', 'kd', 'kh')}) AS variance
        FROM placed p LEFT JOIN mh ON mh.named = p.named LEFT JOIN md ON md.domain = p.domain LEFT JOIN ms ON ms.suffix = p.suffix, k)
    SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.says, CASE WHEN mean + {f.Z} * sqrt(variance) < {f.CUT} THEN 'block' ELSE 'allow' END) AS verdict, CAST(coalesce(n, 0) AS BIGINT) AS labelled
    FROM judged p LEFT JOIN best b ON b.host = p.host AND b.path = p.path"""


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_RANKING_SQL = f"""
    WITH lists AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
    held AS (SELECT * FROM lists WHERE len(terms) > 0),
    total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS terms FROM held),
    tfs AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor({ranking.WEIGHT_SCALE} * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term),
    ms AS (SELECT r, doc_id, 100 - {ranking.LENGTH_SHARE} + (({ranking.LENGTH_SHARE} * len(held.terms) * docs) // total.terms) AS m FROM held, total),
    items AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS_SQL} AS terms FROM benchmark))),
    scored AS (SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, r, CAST(sum(w * (({ranking.TF_SCALE} * tf) // ({ranking.TF_UNIT} * tf + {ranking.LENGTH_UNIT} * m))) AS BIGINT) AS score
               FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN ms USING (r) GROUP BY i, r),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {ranking.K}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": _TOPK_SQL, "op7_sharding": _sharding_sql(), "op8_url_filter": _url_sql(), "op13_ranking": _RANKING_SQL}
