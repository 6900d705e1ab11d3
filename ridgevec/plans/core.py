"""Registered queries of the vector engine and their SQL.

The corpus is the embeddings table with derived metadata; every query runs over
whole tables. Scores are compared on six decimals, ordered on nine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgevec.functions import generators, scores
from ridgevec.functions.predicates import compile_where
from ridgevec.operators import evaluation, ivf, maintenance, store
from ridgevec.operators import search as srch
from ridgevec.operators.changefeed import base_snapshots
from ridgevec.operators.orphans import clean_id
from ridgevec.session import remove_at_exit, shared_dir, table, written
from ridgevec.sources.snapshots import SnapshotStore
from ridgevec.sources.vectors import stored_vectors

SCHEMA = {"year": "number", "premium": "boolean", "lang": ["en", "fr", "de"]}
QUERY, K, NLIST, NPROBE = 7, 10, 64, 4
EVERY = 50  # queries of the many-query searches: ids divisible by it

# -- corpus -----------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str, scaled: bool = False, missing: bool = False) -> DataFrame:
    v = F.col("vec_id")
    vec = F.transform("embedding", lambda x: (x * (1 + v % 5)).cast("float")) if scaled else F.col("embedding")
    gone = (v % 7 == 0) if missing else F.lit(False)
    field = lambda c: F.when(~gone, c)
    meta = F.concat(F.lit('{"bucket":'), (v % 4).cast("string"), F.lit(',"tag":"t'), (v % 3).cast("string"), F.lit('","code":"'), (v % 5).cast("string"), F.lit('","flag":'), F.when(v % 2 == 0, "true").otherwise("false"), F.lit("}"))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("id_"), v.cast("string")).alias("id"),
        v.alias("internal_id"),
        vec.alias("vec"),
        "label",
        field((2000 + v % 25).cast("float")).alias("year"),
        field(v % 2 == 0).alias("premium"),
        field(F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (v % 3 + 1).cast("int"))).alias("lang"),
        field(meta).alias("meta"),
    )


def corpus_sql(scaled: bool = False, missing: bool = False) -> str:
    vec = "list_transform(embedding, lambda x: (x * (1 + vec_id % 5))::FLOAT)" if scaled else "embedding"
    f = (lambda x: f"CASE WHEN vec_id % 7 <> 0 THEN {x} END") if missing else (lambda x: x)
    meta = """'{"bucket":' || (vec_id % 4) || ',"tag":"t' || (vec_id % 3) || '","code":"' || (vec_id % 5) || '","flag":' || (CASE WHEN vec_id % 2 = 0 THEN 'true' ELSE 'false' END) || '}'"""
    return f"""corpus AS (SELECT 'id_' || vec_id AS id, vec_id AS internal_id, {vec} AS vec, label, {f("(2000 + vec_id % 25)::FLOAT")} AS year,
  {f("(vec_id % 2 = 0)")} AS premium, {f("['en', 'fr', 'de'][(vec_id % 3 + 1)::INT]")} AS lang, {f(meta)} AS meta FROM embeddings)"""


def query_of(spark: SparkSession, sf_dir: str, vec_id: int = QUERY) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


# -- SQL pieces ---------------------------------------------------------------


def dot_sql(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def unit_sql(v: str) -> str:
    ss = dot_sql(v, v)
    inv = f"(1.0::DOUBLE / sqrt(CASE WHEN {ss} > 0 THEN {ss} ELSE 1e-12::DOUBLE END))"
    return f"list_transform({v}, lambda x: (x::DOUBLE * {inv})::FLOAT)"


def score_sql(v: str, q: str, metric: str) -> str:
    if metric == "dot":
        s = dot_sql(v, q)
    elif metric == "l2":
        s = f"(2.0::DOUBLE * {dot_sql(v, q)} - {dot_sql(v, v)} - {dot_sql(q, q)})"
    else:
        s = dot_sql(unit_sql(v), unit_sql(q))
    return f"round({s}, 9)"


def topk_sql(metric: str = "cosine", scaled: bool = False, where: str = "true", threshold: str = "", extra: str = "", k: int = K, missing: bool = False) -> str:
    over = f"WHERE score >= {threshold}" if threshold else ""
    return f"""WITH {corpus_sql(scaled, missing)}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY}),
s AS (SELECT corpus.*, {score_sql("vec", "q", metric)} AS score FROM corpus, q WHERE {where})
SELECT id, internal_id, round(score, 6) AS score{extra} FROM s {over} ORDER BY s.score DESC, internal_id LIMIT {k}"""


def _out(hits: DataFrame, *keep: str) -> DataFrame:
    """Rounds the score after the limit; the order stays."""
    return hits.select("id", "internal_id", F.round("score", 6).alias("score"), *keep)


# -- exact search ---------------------------------------------------------------

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _topk(name: str, sql: str, **kw) -> None:
    scaled, missing = kw.pop("scaled", False), kw.pop("missing", False)
    keep = kw.pop("keep", ())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        args = {"k": K, "schema": SCHEMA} | kw
        return _out(srch.search(corpus(spark, sf_dir, scaled, missing), query_of(spark, sf_dir), keep=keep, **args), *keep)

    QUERIES[name], SQL[name] = run, sql


for _m in scores.METRICS:
    _topk(f"exact_topk_{_m}", topk_sql(_m, scaled=True), metric=_m, scaled=True)
_topk("exact_topk_threshold", topk_sql("dot", threshold="0.2::DOUBLE", k=256), metric="dot", threshold=0.2, k=1000)
_topk("exact_topk_where_bool", topk_sql(where="premium"), where={"premium": True})
_topk("exact_topk_where_range", topk_sql(where="year >= 2005 AND year < 2015"), where={"year": {"gte": 2005, "lt": 2015}})
_topk("exact_topk_where_in", topk_sql(where="lang IN ('en', 'de')"), where={"lang": {"in": ["en", "de", "xx"]}})
_topk("exact_topk_where_combined", topk_sql(where="premium AND year BETWEEN 2010 AND 2015 AND lang IN ('en', 'fr')"), where={"premium": True, "year": {"gte": 2010, "lte": 2015}, "lang": {"in": ["en", "fr"]}})
_topk("exact_topk_where_cold", topk_sql(where="json_extract(meta, '$.bucket')::INT = 2", extra=", meta"), where={"bucket": 2}, keep=("meta",))
_topk("topk_with_metadata", topk_sql(extra=", year, premium, lang, label"), keep=("year", "premium", "lang", "label"))

# -- predicates -------------------------------------------------------------------

_CONDITIONS = {
    "where_eq_number": ({"year": 2007}, "year = 2007"),
    "where_eq_bool": ({"premium": False}, "premium = false"),
    "where_bool_in": ({"premium": {"in": [False]}}, "premium = false"),
    "where_eq_enum": ({"lang": "fr"}, "lang = 'fr'"),
    "where_number_range_wins": ({"year": {"gte": 2020, "in": [2001]}}, "year >= 2020"),
    "where_number_in": ({"year": {"in": [2001, 2003, "x"]}}, "year IN (2001, 2003)"),
    "where_cold_eq": ({"code": "3"}, "json_extract_string(meta, '$.code') = '3'"),
    "where_cold_strict": ({"code": 3}, "false"),
    "where_cold_in": ({"tag": {"in": ["t0", "t2", 5]}}, "json_extract_string(meta, '$.tag') IN ('t0', 't2')"),
    "where_cold_in_wins": ({"bucket": {"in": [1], "gte": 3}}, "json_extract(meta, '$.bucket')::INT = 1"),
    "where_cold_range": ({"bucket": {"gt": 0, "lte": 2}}, "json_extract(meta, '$.bucket')::INT IN (1, 2)"),
    "where_cold_bool": ({"flag": True}, "json_extract_string(meta, '$.flag') = 'true'"),
    "where_missing": ({"absent": 1}, "false"),
    "where_type_mismatch": ({"lang": {"gt": 1}}, "false"),
    "where_empty": ({}, "true"),
}


def _condition(name: str, where: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus(spark, sf_dir, missing=True).where(compile_where(where, SCHEMA)).select("internal_id")

    QUERIES[name], SQL[name] = run, f"WITH {corpus_sql(missing=True)} SELECT internal_id FROM corpus WHERE {sql}"


for _n, (_w, _s) in _CONDITIONS.items():
    _condition(_n, _w, _s)

# -- vector functions -----------------------------------------------------------


def _elements(df: DataFrame) -> DataFrame:
    x = df.select("internal_id", F.posexplode("vec").alias("pos", "x"))
    return x.select("internal_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = scores.unit(F.col("vec"))
    return _elements(corpus(spark, sf_dir, scaled=True).withColumn("vec", u))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, scaled=True).select("internal_id", F.round(F.sqrt(scores.squared_norm(F.col("vec"))), 6).alias("norm"))


def vector_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores.add(F.col("vec"), F.col("vec"))
    return _elements(corpus(spark, sf_dir).withColumn("vec", s))


def f32_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that round to 32 bits at every step, against one query."""
    q = F.array(*[F.lit(x).cast("float") for x in query_of(spark, sf_dir)])
    v = F.col("vec")
    figures = {"dot": scores.dot32(v, q), "l2sq": scores.l2sq32(v, q), "norm": scores.norm32(v), "cosine": scores.cosine32(v, q)}
    return corpus(spark, sf_dir, scaled=True).select("internal_id", *[F.round(c.cast("double"), 6).alias(n) for n, c in figures.items()])


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srch.get(corpus(spark, sf_dir), "id_42").select("id", "internal_id", "label", "meta")


def candidate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return srch.candidates(c, c.where("label = 3").select("internal_id")).select("id", "internal_id", F.size("vec").alias("dim"))


_UNNEST = "(generate_subscripts(vec, 1) - 1)::INT AS pos, round(unnest({})::DOUBLE, 6) AS x"
_F32 = "list_reduce(list_prepend(0::FLOAT, list_transform(list_zip(vec, q), lambda p: ({}))), lambda s, x: s + x)"
QUERIES |= {"f32_metrics": f32_metrics, "normalize_vectors": normalize_vectors, "vector_norms": vector_norms, "vector_add": vector_add, "point_get": point_get, "candidate_scan": candidate_scan}
SQL |= {
    "f32_metrics": f"""WITH {corpus_sql(True)}, o AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY}),
m AS (SELECT internal_id, {_F32.format("p[1] * p[2]")} AS d, {_F32.format("(p[1] - p[2]) * (p[1] - p[2])")} AS l, {_F32.format("p[1] * p[1]")} AS a, {_F32.format("p[2] * p[2]")} AS b FROM corpus, o)
SELECT internal_id, round(d::DOUBLE, 6) AS dot, round(l::DOUBLE, 6) AS l2sq, round(sqrt(a::DOUBLE), 6) AS norm, round(d::DOUBLE / (sqrt(a::DOUBLE) * sqrt(b::DOUBLE)), 6) AS cosine FROM m""",
    "normalize_vectors": f"WITH {corpus_sql(True)} SELECT internal_id, {_UNNEST.format(unit_sql('vec'))} FROM corpus",
    "vector_norms": f"WITH {corpus_sql(True)} SELECT internal_id, round(sqrt({dot_sql('vec', 'vec')}), 6) AS norm FROM corpus",
    "vector_add": f"WITH {corpus_sql()} SELECT internal_id, {_UNNEST.format('list_transform(vec, lambda x: (x + x)::FLOAT)')} FROM corpus",
    "point_get": f"WITH {corpus_sql()} SELECT id, internal_id, label, meta FROM corpus WHERE id = 'id_42'",
    "candidate_scan": f"WITH {corpus_sql()} SELECT id, internal_id, len(vec)::INT AS dim FROM corpus WHERE label = 3",
}

# -- many queries -----------------------------------------------------------------


def _hits(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "internal_id", F.round("score", 6).alias("score"))


def batch_sql(metric: str = "cosine", where: str = "true", scaled: bool = False) -> str:
    return f"""WITH {corpus_sql(scaled)}, u AS (SELECT internal_id, vec FROM corpus WHERE {where}),
q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % {EVERY} = 0),
s AS (SELECT qid, internal_id, {score_sql("vec", "q", metric)} AS sc FROM q, u)
SELECT qid, rank::INT AS rank, internal_id, round(sc, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, internal_id) AS rank FROM s) WHERE rank <= {K}"""


def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(srch.batch_search(corpus(spark, sf_dir), queries_of(spark, sf_dir), K))


def batch_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(srch.batch_search(corpus(spark, sf_dir, True), queries_of(spark, sf_dir), K, "l2"))


def batch_topk_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(srch.batch_search(corpus(spark, sf_dir), queries_of(spark, sf_dir), K, where={"premium": True}, schema=SCHEMA))


def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    again = c.where("internal_id < 5").withColumn("internal_id", F.col("internal_id") + 100000)
    return _out(srch.search(c.unionByName(again), query_of(spark, sf_dir, 3), K))


def stored_unit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a store that keeps unit vectors, as one for cosine does."""
    c = corpus(spark, sf_dir, True).withColumn("vec", scores.unit(F.col("vec")))
    return _out(srch.search(c, query_of(spark, sf_dir), K, stored_unit=True))


QUERIES["exact_topk_stored_unit"], SQL["exact_topk_stored_unit"] = stored_unit_topk, topk_sql("cosine", scaled=True)
QUERIES |= {"batch_topk": batch_topk, "batch_topk_l2": batch_topk_l2, "batch_topk_where": batch_topk_where, "topk_ties": topk_ties}
SQL |= {
    "batch_topk": batch_sql(),
    "batch_topk_l2": batch_sql("l2", scaled=True),
    "batch_topk_where": batch_sql(where="premium"),
    "topk_ties": f"""WITH {corpus_sql()}, u AS (SELECT id, internal_id, vec FROM corpus UNION ALL SELECT id, internal_id + 100000, vec FROM corpus WHERE internal_id < 5),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3), s AS (SELECT id, internal_id, {score_sql("vec", "q", "cosine")} AS sc FROM u, q)
SELECT id, internal_id, round(sc, 6) AS score FROM s ORDER BY sc DESC, internal_id LIMIT {K}""",
}

# -- inverted lists ---------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> ivf.IvfIndex:
    """Fixed centroids: the first vectors by id."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < NLIST).select("vec_id", "embedding").collect()
    return ivf.given([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])])


_LISTS = f"""cent AS (SELECT vec_id::INT AS list_id, embedding AS c FROM embeddings WHERE vec_id < {NLIST}),
dist AS (SELECT internal_id, list_id, round({dot_sql("vec", "vec")} - 2.0::DOUBLE * {dot_sql("vec", "c")} + {dot_sql("c", "c")}, 9) AS d FROM corpus, cent),
asg AS (SELECT internal_id, list_id FROM (SELECT *, row_number() OVER (PARTITION BY internal_id ORDER BY d, list_id) AS rn FROM dist) WHERE rn = 1)"""


def _probe_sql(query: str, n: int) -> str:
    u = unit_sql("q")
    d = f"round({dot_sql('c', 'c')} - 2.0::DOUBLE * {dot_sql('c', u)} + {dot_sql(u, u)}, 9)"
    return f"pr AS (SELECT qid, list_id, row_number() OVER (PARTITION BY qid ORDER BY {d}, list_id) AS pos FROM ({query}), cent QUALIFY pos <= {n})"


_ONE = f"SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id = {QUERY}"
_MANY = f"SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % {EVERY} = 0"


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.assign(corpus(spark, sf_dir), _index(spark, sf_dir)).select("internal_id", "list_id")


def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return ivf.list_sizes(ivf.assign(corpus(spark, sf_dir), i), i)


def ivf_list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.list_stats(ivf_list_sizes(spark, sf_dir))


def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    lists = ivf.probes(i, scores.query_vector(query_of(spark, sf_dir)), NPROBE)
    return spark.createDataFrame([(n, p + 1) for p, n in enumerate(lists)], "list_id int, pos int")


def _ivf_search(nprobe: int = NPROBE, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = _index(spark, sf_dir)
        return _out(ivf.search(ivf.assign(corpus(spark, sf_dir), i), i, query_of(spark, sf_dir), K, nprobe, schema=SCHEMA, **kw))

    return run


def _ivf_sql(nprobe: int = NPROBE, where: str = "true", cap: int | None = None) -> str:
    limit = f"ORDER BY pos, internal_id LIMIT {cap}" if cap else ""
    return f"""WITH {corpus_sql()}, {_LISTS}, {_probe_sql(_ONE, nprobe)}, q AS ({_ONE}),
cand AS (SELECT corpus.*, pos FROM corpus JOIN asg USING (internal_id) JOIN pr USING (list_id) WHERE {where} {limit}),
s AS (SELECT id, internal_id, {score_sql("vec", "q", "cosine")} AS sc FROM cand, q)
SELECT id, internal_id, round(sc, 6) AS score FROM s ORDER BY sc DESC, internal_id LIMIT {K}"""


def ivf_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return _hits(ivf.batch(ivf.assign(corpus(spark, sf_dir), i), i, queries_of(spark, sf_dir), K, NPROBE))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[ivf.IvfIndex, DataFrame]:
    """The lists, written once, a folder each, and read back."""
    i, path = _index(spark, sf_dir), f"{shared_dir(spark)}/ridgevec-lists-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return i, ivf.write_lists(ivf.assign(corpus(spark, sf_dir), i), path)


def ivf_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, lists = _stored(spark, sf_dir)
    return _out(ivf.search(lists, i, query_of(spark, sf_dir), K, NPROBE))


def ivf_batch_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, lists = _stored(spark, sf_dir)
    return _hits(ivf.batch(lists, i, queries_of(spark, sf_dir), K, NPROBE))


_IVF_BATCH = f"""s AS (SELECT qid, internal_id, {score_sql("vec", "q", "cosine")} AS sc, pos FROM ({_MANY}) JOIN pr USING (qid) JOIN asg USING (list_id) JOIN corpus USING (internal_id))"""


def ivf_recall_by_nprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = written(srch.batch_search(corpus(spark, sf_dir), queries_of(spark, sf_dir), K), "exact")
    i, lists = _stored(spark, sf_dir)
    out = None
    for n in (1, 2, 4, 8, 16):
        r = evaluation.mean_recall(exact, ivf.batch(lists, i, queries_of(spark, sf_dir), K, n), K).select(F.lit(n).alias("nprobe"), "recall")
        out = r if out is None else out.unionByName(r)
    return out


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.lloyd_step(ivf.assign(corpus(spark, sf_dir), _index(spark, sf_dir)))


def ivf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = ivf.train(corpus(spark, sf_dir), NLIST, iters=10)
    return ivf.list_sizes(ivf.assign(corpus(spark, sf_dir), i), i)


def ivf_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of label 1 deleted and rows of label 2 given another vector; only
    those are assigned again."""
    i = _index(spark, sf_dir)
    c = corpus(spark, sf_dir).select("id", "internal_id", "label", "vec")
    moved = c.where("label = 2").withColumn("vec", F.transform("vec", lambda x: (-x).cast("float"))).withColumn("op", F.lit("upsert"))
    gone = c.where("label = 1").withColumn("op", F.lit("delete"))
    return ivf.apply_delta(ivf.assign(c, i), gone.unionByName(moved), i).select("internal_id", "list_id")


QUERIES |= {
    "ivf_assign": ivf_assign,
    "ivf_list_sizes": ivf_list_sizes,
    "ivf_list_stats": ivf_list_stats,
    "ivf_probe": ivf_probe,
    "ivf_search": _ivf_search(),
    "ivf_search_where": _ivf_search(where={"premium": True, "lang": {"in": ["en", "fr"]}}),
    "ivf_max_candidates": _ivf_search(max_candidates=40),
    "ivf_nprobe_all": _ivf_search(NLIST),
    "ivf_batch": ivf_batch,
    "ivf_search_stored": ivf_search_stored,
    "ivf_batch_stored": ivf_batch_stored,
    "ivf_recall_by_nprobe": ivf_recall_by_nprobe,
    "kmeans_step": kmeans_step,
    "ivf_train": ivf_train,
    "ivf_incremental": ivf_incremental,
}
SQL |= {
    "ivf_assign": f"WITH {corpus_sql()}, {_LISTS} SELECT * FROM asg",
    "ivf_list_sizes": f"WITH {corpus_sql()}, {_LISTS} SELECT cent.list_id, count(asg.internal_id) AS size FROM cent LEFT JOIN asg USING (list_id) GROUP BY 1",
    "ivf_list_stats": f"""WITH {corpus_sql()}, {_LISTS}, z AS (SELECT cent.list_id, count(asg.internal_id) AS size FROM cent LEFT JOIN asg USING (list_id) GROUP BY 1)
SELECT round(max(size) / avg(size), 6) AS list_imbalance, round(stddev_pop(size), 6) AS list_std FROM z""",
    "ivf_probe": f"WITH {corpus_sql()}, {_LISTS}, {_probe_sql(_ONE, NPROBE)} SELECT list_id, pos::INT AS pos FROM pr",
    "ivf_search": _ivf_sql(),
    "ivf_search_where": _ivf_sql(where="premium AND lang IN ('en', 'fr')"),
    "ivf_max_candidates": _ivf_sql(cap=40),
    "ivf_nprobe_all": topk_sql(),
    "ivf_batch": f"""WITH {corpus_sql()}, {_LISTS}, {_probe_sql(_MANY, NPROBE)}, {_IVF_BATCH}
SELECT qid, rank::INT AS rank, internal_id, round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, internal_id) AS rank FROM s) WHERE rank <= {K}""",
    "ivf_recall_by_nprobe": f"""WITH {corpus_sql()}, {_LISTS}, {_probe_sql(_MANY, NLIST)}, {_IVF_BATCH},
ex AS (SELECT qid, internal_id FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sc DESC, internal_id) <= {K}),
n AS (SELECT unnest([1, 2, 4, 8, 16]) AS nprobe),
ap AS (SELECT nprobe, qid, internal_id FROM n JOIN s ON pos <= nprobe QUALIFY row_number() OVER (PARTITION BY nprobe, qid ORDER BY sc DESC, internal_id) <= {K}),
r AS (SELECT n.nprobe, ex.qid, count(ap.internal_id) / {K}.0::DOUBLE AS recall FROM n CROSS JOIN ex LEFT JOIN ap ON ap.nprobe = n.nprobe AND ap.qid = ex.qid AND ap.internal_id = ex.internal_id GROUP BY 1, 2)
SELECT nprobe, round(avg(recall), 6) AS recall FROM r GROUP BY 1""",
    "kmeans_step": f"""WITH {corpus_sql()}, {_LISTS}, x AS (SELECT list_id, unnest(vec)::DOUBLE AS x, (generate_subscripts(vec, 1) - 1)::INT AS pos FROM corpus JOIN asg USING (internal_id))
SELECT list_id, pos, round(avg(x), 6) AS mean FROM x GROUP BY 1, 2""",
    "ivf_incremental": f"""WITH old AS (SELECT 1), base AS (SELECT vec_id AS internal_id, label, CASE WHEN label = 2 THEN list_transform(embedding, lambda x: (-x)::FLOAT) ELSE embedding END AS vec FROM embeddings WHERE label <> 1),
corpus AS (SELECT internal_id, vec FROM base), {_LISTS} SELECT * FROM asg""",
}

SQL |= {"ivf_search_stored": SQL["ivf_search"], "ivf_batch_stored": SQL["ivf_batch"]}

# -- journal, snapshots, maintenance -------------------------------------------------


def event_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 500).alias("vec_id"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("meta"))
    return e.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id")


_JOURNAL = """j AS (SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, user_id::VARCHAR AS id,
  event_id % 500 AS v, CASE WHEN event_id % 3 = 0 THEN props END AS meta FROM events)"""


def _fold_sql(source: str) -> str:
    return f"""g AS (SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(v, seq) AS v,
  max(seq) FILTER (op = 'upsert' AND meta IS NOT NULL) AS gs, arg_max(meta, seq) FILTER (op = 'upsert' AND meta IS NOT NULL) AS gm, max(seq) FILTER (op = 'delete') AS d FROM {source} GROUP BY id),
f AS (SELECT id, seq, op, v, CASE WHEN gs IS NOT NULL AND (d IS NULL OR gs > d) THEN gm ELSE '{{}}' END AS meta FROM g)"""


def _with_sum(df: DataFrame) -> DataFrame:
    return df.withColumn("vsum", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 6)).drop("vec")


_VSUM = "round(list_sum(embedding::DOUBLE[]), 6) AS vsum"


def journal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_sum(store.live(event_journal(spark, sf_dir)).select("id", "seq", "vec"))


def metadata_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(event_journal(spark, sf_dir)).select("id", "seq", "meta")


def snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot at half of the journal, the rest replayed: equals the fold
    of all of it but for the sequence numbers."""
    j = event_journal(spark, sf_dir)
    half = (j.agg(F.max("seq").alias("m")).first()["m"] or 0) // 2
    base = written(store.live(j, upto=half).select("id", "vec", "meta"), "snapshot")
    return _with_sum(store.replay(base, j, half).select("id", "vec", "meta"))


def snapshot_store_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a store on files: half of the journal appended and
    saved, the rest appended and replayed over the snapshot."""
    root = f"{shared_dir(spark)}/ridgevec-store-{uuid.uuid4().hex}"
    s = SnapshotStore(spark, root, 64, 16)
    j = event_journal(spark, sf_dir).withColumnRenamed("seq", "ord")
    half = (j.agg(F.max("ord").alias("m")).first()["m"] or 0) // 2
    s.append(j.where(F.col("ord") <= half))
    s.save()
    s.append(j.where(F.col("ord") > half))
    return _with_sum(s.load().select("id", "vec", "meta"))


def journal_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "journal")
    m = table(spark, sf_dir, "meta_states").where("db_name IS NOT NULL").groupBy("db_name").agg(F.max("last_seq").alias("upto"))
    left = j.join(m, "db_name").where("seq > upto")
    return left.groupBy("db_name").agg(F.count(F.lit(1)).alias("entries"), F.min("seq").alias("first_seq"))


def latest_complete_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_snapshots(table(spark, sf_dir, "snapshots")).select("db_name", F.col("sid").alias("snapshot_id"), "snapshot_seq")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    top = F.max("vec_id")
    t = table(spark, sf_dir, "embeddings").agg(top.alias("m"))
    return table(spark, sf_dir, "embeddings").join(F.broadcast(t)).select(v.alias("internal_id"), F.concat(F.lit("id_"), v.cast("string")).alias("id"), ((v % 10 == 3) | (v > F.col("m") - 23)).alias("deleted"))


_ROWS = "r AS (SELECT vec_id AS internal_id, (vec_id % 10 = 3 OR vec_id > (SELECT max(vec_id) FROM embeddings) - 23) AS deleted FROM embeddings)"
_STATS = """a AS (SELECT count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS dead, max(internal_id) + 1 AS nid, max(internal_id) FILTER (NOT deleted) AS last FROM r)"""


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_stats(_rows(spark, sf_dir), 64, 16)


def compact_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.compaction_report(_rows(spark, sf_dir), 16)


def compacted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.compact(_rows(spark, sf_dir)).select("internal_id", "deleted")


def maintenance_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = maintenance.Policy(snapshot_if_dead_ratio=0.08, snapshot_min_interval_ms=200 * 86_400_000, ivf_rebuild_if_dead_ratio=0.1, trim_tail_min_dead=2)
    latest = maintenance.latest_reports(table(spark, sf_dir, "maintenance_stats"))
    return maintenance.evaluate(latest, p, 1_767_225_600_000).select("db_name", "do_trim", "do_snapshot", "do_ivf_rebuild")


def maintenance_list_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    imbalance, std = maintenance.list_figures(F.col("list_sizes"))
    latest = maintenance.latest_reports(table(spark, sf_dir, "maintenance_stats"))
    return latest.select("db_name", F.round(imbalance, 6).alias("imbalance"), F.round(std, 6).alias("std"))


_LATEST = "l AS (SELECT * FROM (SELECT DISTINCT * FROM maintenance_stats) QUALIFY row_number() OVER (PARTITION BY db_name ORDER BY reported_at DESC) = 1)"

QUERIES |= {
    "journal_fold": journal_fold,
    "metadata_fold": metadata_fold,
    "snapshot_replay": snapshot_replay,
    "snapshot_store_replay": snapshot_store_replay,
    "journal_truncate": journal_truncate,
    "latest_complete_snapshot": latest_complete_snapshot,
    "store_stats": store_stats,
    "compact_trailing": compact_trailing,
    "compacted_rows": compacted_rows,
    "maintenance_policy": maintenance_policy,
    "maintenance_list_figures": maintenance_list_figures,
}
SQL |= {
    "journal_fold": f"WITH {_JOURNAL}, {_fold_sql('j')} SELECT id, seq, {_VSUM} FROM f JOIN embeddings ON v = vec_id WHERE op = 'upsert'",
    "metadata_fold": f"WITH {_JOURNAL}, {_fold_sql('j')} SELECT id, seq, meta FROM f WHERE op = 'upsert'",
    "snapshot_replay": f"WITH {_JOURNAL}, {_fold_sql('j')} SELECT id, meta, {_VSUM} FROM f JOIN embeddings ON v = vec_id WHERE op = 'upsert'",
    "snapshot_store_replay": f"WITH {_JOURNAL}, {_fold_sql('j')} SELECT id, meta, {_VSUM} FROM f JOIN embeddings ON v = vec_id WHERE op = 'upsert'",
    "journal_truncate": """WITH m AS (SELECT db_name, max(last_seq) AS upto FROM meta_states GROUP BY 1)
SELECT db_name, count(*) AS entries, min(seq) AS first_seq FROM journal JOIN m USING (db_name) WHERE seq > upto GROUP BY 1""",
    "latest_complete_snapshot": """WITH st AS (SELECT lower(trim(snapshot_id)) AS sid, arg_max(lower(trim(status)), recorded_at) AS status FROM snapshots GROUP BY 1)
SELECT db_name, sid AS snapshot_id, snapshot_seq FROM (SELECT db_name, lower(trim(snapshot_id)) AS sid, snapshot_seq,
  row_number() OVER (PARTITION BY db_name ORDER BY created_at DESC, snapshot_seq DESC, lower(trim(snapshot_id)) DESC) AS rn
  FROM snapshots WHERE lower(trim(snapshot_id)) IN (SELECT sid FROM st WHERE status = 'complete')) WHERE rn = 1""",
    "store_stats": f"""WITH {_ROWS}, {_STATS} SELECT 64 AS dim, 16 AS chunk_rows, ceil(nid / 16.0)::BIGINT AS chunks, ceil(nid / 16.0)::BIGINT * 16 AS capacity, live AS live_count,
  dead AS deleted_count, live AS id_count, nid AS next_id, nid - live AS free_slots, round(dead / (live + dead), 6) AS dead_ratio, nid - 1 - last AS tail_dead_count, round((nid - 1 - last) / nid, 6) AS tail_dead_ratio FROM a""",
    "compact_trailing": f"WITH {_ROWS}, {_STATS} SELECT nid AS old_next_id, last + 1 AS new_next_id, ceil(nid / 16.0)::BIGINT - ceil((last + 1) / 16.0)::BIGINT AS trimmed_chunks FROM a",
    "compacted_rows": f"WITH {_ROWS} SELECT internal_id, deleted FROM r WHERE internal_id <= (SELECT max(internal_id) FROM r WHERE NOT deleted)",
    "maintenance_policy": f"""WITH {_LATEST} SELECT db_name, coalesce(tail_dead_count >= 2, false) AS do_trim,
  coalesce(dead_ratio >= 0.08::DOUBLE, false) OR 1767225600000 - coalesce(last_snapshot_at, 0) >= 200 * 86400000::BIGINT AS do_snapshot, coalesce(dead_ratio >= 0.1::DOUBLE, false) AS do_ivf_rebuild FROM l""",
    "maintenance_list_figures": f"""WITH {_LATEST} SELECT db_name, round(CASE WHEN list_sum(list_sizes) > 0 THEN list_max(list_sizes) / list_avg(list_sizes) ELSE CASE WHEN list_sizes IS NOT NULL THEN 0 END END, 6) AS imbalance,
  round(list_stddev_pop(list_sizes), 6) AS std FROM l""",
}

# -- stored vectors of the reference domain -----------------------------------------------


def usable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored_vectors(table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "live_batches"))
    return v.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).select(F.col("id").cast("int").alias("internal_id"), "copies")


_USABLE = """pos AS (SELECT unnest(range(16)) AS p),
raw AS (
  SELECT (chunk_index * 16 + p)::INT AS internal_id, list_slice(vecs, p * 64 + 1, p * 64 + 64) AS v FROM vector_chunks, pos WHERE len(vecs) >= p * 64 + 64 AND tomb[p + 1] = 0
  UNION ALL
  SELECT ids[i], list_slice(vectors, i * 64 - 63, i * 64) FROM (SELECT ids, vectors, unnest(range(1, len(ids) + 1)) AS i FROM live_batches) WHERE len(vectors) >= i * 64 AND ids[i] IS NOT NULL),
usable AS (SELECT internal_id, v FROM raw WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0)"""


def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal to external ids of the base snapshots."""
    base = base_snapshots(table(spark, sf_dir, "snapshots"))
    m = table(spark, sf_dir, "id_maps").select(clean_id("snapshot_id").alias("sid"), "base_id", "int_to_ext")
    at = m.join(base, "sid").select("db_name", "base_id", F.posexplode("int_to_ext").alias("p", "id")).where("id IS NOT NULL")
    return at.select("db_name", (F.col("base_id") + F.col("p")).alias("internal_id"), "id").distinct()


def search_hits_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hits against the true cosine of their vectors."""
    hits = table(spark, sf_dir, "search_hits").select("qid", "query_id", "internal_id", "score").distinct()
    v = stored_vectors(table(spark, sf_dir, "vector_chunks"), table(spark, sf_dir, "live_batches"))
    wanted = hits.select(F.col("query_id").cast("bigint").alias("id")).union(hits.select(F.col("internal_id").cast("bigint"))).distinct()
    v = v.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    a = v.select(F.col("id").alias("query_id"), F.col("vec").alias("va"))
    b = v.select(F.col("id").alias("internal_id"), F.col("vec").alias("vb"))

    @F.pandas_udf("double")
    def cosine(x, y):
        import numpy as np
        import numpy as np
        import pandas as pd

        both = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        if both.any():
            p, q = (np.stack([np.frombuffer(v, "<f4") for v in c[both]]).astype("f8") for c in (x, y))
            along = lambda a, b: np.einsum("ij,ij->i", a, b)
            out[both] = along(p, q) / np.sqrt(along(p, p) * along(q, q))
        return pd.Series(out).where(both, None).astype("Float64")

    j = hits.join(a, "query_id", "left").join(b, "internal_id", "left")
    true = F.round(cosine("va", "vb"), 6)
    ok = F.coalesce(F.abs(F.col("score").cast("double") - true) <= 1e-4, F.lit(False))
    return j.select("qid", "query_id", "internal_id", true.alias("true_score"), ok.alias("score_holds"))


def percentile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = None
    for rule in ("floor_n_minus_1", "floor_percent", "floor_n"):
        r = evaluation.percentiles(e, "value", {"p50": 0.5, "p95": 0.95}, ["event_type"], rule).select(F.lit(rule).alias("rule"), "event_type", "p50", "p95")
        out = r if out is None else out.unionByName(r)
    return out


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = evaluation.percentiles(e, "value", {"p95": 0.95}).select(F.lit("search_p95_ms").alias("name"), F.col("p95").alias("value"))
    n = e.agg((F.count_if(F.col("event_type") == "view") / F.count(F.lit(1))).alias("value")).select(F.lit("ivf_recall_at_10").alias("name"), "value")
    return evaluation.gates(p.unionByName(n)).select("gate", F.round("value", 6).alias("value"), "limit", "status")


def lcg_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(generators.lcg_vectors(spark, 1234, 60, 8))


QUERIES |= {"usable_vectors": usable_vectors, "external_ids": external_ids, "search_hits_checked": search_hits_checked, "percentile_rules": percentile_rules, "gate_report": gate_report, "lcg_vectors": lcg_vectors}
_EV = "v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"
SQL |= {
    "usable_vectors": f"WITH {_USABLE} SELECT internal_id, count(*) AS copies FROM usable GROUP BY 1",
    "external_ids": f"""WITH base AS ({SQL["latest_complete_snapshot"]})
SELECT DISTINCT db_name, (base_id + i - 1)::INT AS internal_id, int_to_ext[i] AS id FROM (
  SELECT b.db_name, base_id, int_to_ext, unnest(range(1, len(int_to_ext) + 1)) AS i FROM id_maps JOIN base b ON lower(trim(id_maps.snapshot_id)) = b.snapshot_id) WHERE int_to_ext[i] IS NOT NULL""",
    "search_hits_checked": f"""WITH {_USABLE}, one AS (SELECT internal_id, any_value(v) AS v FROM usable GROUP BY 1),
h AS (SELECT DISTINCT qid, query_id, internal_id, score FROM search_hits),
t AS (SELECT h.*, round({dot_sql("a.v", "b.v")} / sqrt({dot_sql("a.v", "a.v")} * {dot_sql("b.v", "b.v")}), 6) AS true_score FROM h LEFT JOIN one a ON a.internal_id = query_id LEFT JOIN one b ON b.internal_id = h.internal_id)
SELECT qid, query_id, internal_id, true_score, coalesce(abs(score::DOUBLE - true_score) <= 1e-4::DOUBLE, false) AS score_holds FROM t""",
    "percentile_rules": f"""WITH {_EV}, p AS (SELECT unnest(['floor_n_minus_1', 'floor_percent', 'floor_n']) AS rule),
x AS (SELECT rule, event_type, value, rn, CASE WHEN rule = 'floor_n' THEN least(n, floor(0.5::DOUBLE * n) + 1) ELSE floor(0.5::DOUBLE * (n - 1)) + 1 END AS a,
  CASE WHEN rule = 'floor_n' THEN least(n, floor(0.95::DOUBLE * n) + 1) ELSE floor(0.95::DOUBLE * (n - 1)) + 1 END AS b FROM v, p)
SELECT rule, event_type, max(value) FILTER (rn = a) AS p50, max(value) FILTER (rn = b) AS p95 FROM x GROUP BY 1, 2""",
    "gate_report": """WITH g(gate, name, side, "limit") AS (VALUES ('search_p95_ms_max', 'search_p95_ms', 'max', 80.0::DOUBLE), ('ingest_p95_ms_max', 'ingest_p95_ms', 'max', 50.0::DOUBLE),
  ('ivf_recall_at_10_min', 'ivf_recall_at_10', 'min', 0.6::DOUBLE), ('ivf_speedup_min', 'ivf_speedup', 'min', 2.0::DOUBLE), ('warm_start_ms_max', 'warm_start_ms', 'max', 200.0::DOUBLE), ('frame_p95_ms_max', 'frame_p95_ms', 'max', 20.0::DOUBLE)),
o AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
f AS (SELECT 'search_p95_ms' AS name, max(value) FILTER (rn = floor(0.95::DOUBLE * (n - 1)) + 1) AS value FROM o
  UNION ALL SELECT 'ivf_recall_at_10', count(*) FILTER (event_type = 'view') / count(*)::DOUBLE FROM events)
SELECT gate, round(value, 6) AS value, "limit", CASE WHEN value IS NULL THEN 'skip' WHEN side = 'max' AND value > "limit" OR side = 'min' AND value < "limit" THEN 'fail' ELSE 'pass' END AS status FROM g LEFT JOIN f USING (name)""",
    "lcg_vectors": """WITH RECURSIVE r(i, s) AS (SELECT 1, (1234::BIGINT * 1664525 + 1013904223) % 4294967296 UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM r WHERE i < 480)
SELECT ((i - 1) // 8)::BIGINT AS internal_id, ((i - 1) % 8)::INT AS pos, round((((s / 4294967296.0::DOUBLE) * 2 - 1) * 0.5::DOUBLE)::FLOAT::DOUBLE, 6) AS x FROM r""",
}

# -- streams ----------------------------------------------------------------------

_EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgevec.streaming import feed

    return _entries_of(feed.read_journal(spark, sf_dir, _EVENT, pattern="events.parquet"))


def _entries_of(e: DataFrame) -> DataFrame:
    return e.select((F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 500).alias("vec_id"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("meta"))


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgevec.streaming import feed

    return feed.stream_fold(_event_stream(spark, sf_dir)).select("id", "seq")


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events arrive in four files; the stream stops after two and goes on
    from its checkpoint, a file a micro-batch."""
    from ridgevec.streaming import feed

    base = f"{shared_dir(spark)}/ridgevec-restart-{uuid.uuid4().hex}"
    remove_at_exit(spark, base)
    events, out = table(spark, sf_dir, "events"), None
    for half in range(2):
        for part in (2 * half, 2 * half + 1):
            events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(f"{base}/events")
        e = feed.read_journal(spark, f"{base}/events", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema), files_per_batch=1)
        out = feed.stream_fold(_entries_of(e), f"{base}/fold")
    return out.select("id", "seq")


def stream_ivf_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgevec.streaming import feed

    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return feed.stream_lists(_event_stream(spark, sf_dir).join(v, "vec_id"), _index(spark, sf_dir))


QUERIES |= {"stream_fold": stream_fold, "stream_restart": stream_restart, "stream_ivf_maintenance": stream_ivf_maintenance}
SQL |= {
    "stream_restart": f"WITH {_JOURNAL}, {_fold_sql('j')} SELECT id, seq FROM f WHERE op = 'upsert'",
    "stream_fold": f"WITH {_JOURNAL}, {_fold_sql('j')} SELECT id, seq FROM f WHERE op = 'upsert'",
    "stream_ivf_maintenance": f"WITH {corpus_sql()}, {_LISTS}, {_JOURNAL}, {_fold_sql('j')} SELECT f.id, list_id FROM f JOIN asg ON v = internal_id WHERE op = 'upsert'",
}
