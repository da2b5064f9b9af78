"""The named queries over the driver tables, and their SQL.

Bindings: chunks are documents (series = source, heading = lang, document_key = source/lang) or embeddings (series = label,
document_key = label-(vec_id % 5), vectors stretched by 1 + vec_id % 3). Questions are all benchmark items; vector
queries are the rows whose id is divisible by 100, against all rows. Runs come from labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.functions import text as T
from anvilgrid.functions import vectors as V
from anvilgrid.operators import citations as C
from anvilgrid.operators import retrieval as R
from anvilgrid.operators import runs as E
from anvilgrid.operators import vocabulary as W
from anvilgrid.session import Workspace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIMS, K = 64, 8


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    stretch = (F.col("vec_id") % 3 + 1).cast("double")
    return v.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("series"), F.concat_ws("-", F.col("label").cast("string"), (F.col("vec_id") % 5).cast("string")).alias("document_key"), F.transform(V.as_double(F.col("embedding")), lambda x: x * stretch).alias("v"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "v")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("series"), F.col("lang").alias("heading"), "text")


def runs(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")  # noqa: E741
    each = lambda n, c: l.select(F.lit(n).alias("run"), F.col("doc_id").alias("question_id"), c.alias("is_correct"))
    return each("A", F.col("quality") == 1).unionByName(each("B", F.col("toxic") == 1)).unionByName(each("C", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 2 == 0)))


def dataset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("category"), (14 + F.col("doc_id") % 6).alias("release"))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def no_nulls(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers without nulls (0 for none), as engines hand nullable ones over differently."""
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in names})


VEC = """v AS (SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS series, label || '-' || (vec_id % 5) AS document_key,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 3 + 1)) AS v FROM embeddings),
q AS (SELECT chunk_id AS query_id, v AS q FROM v WHERE chunk_id % 100 = 0)"""
NORM = "sqrt(list_dot_product({0}, {0}))"
TOP = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= {k}"
RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS BIGINT) AS rank"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
TERMS = f"""qt AS (SELECT DISTINCT item_id AS query_id, t AS term FROM (SELECT item_id, unnest({TOKENS.format("regexp_replace(text, '(?i)\\[\\s*3GPP\\s+Release\\s+\\d+\\s*\\]', ' ', 'g')")}) AS t FROM benchmark) WHERE length(t) >= 2 AND t NOT IN {STOP})"""


def bm25_sql(heading: bool = False, where: str = "") -> str:
    both = f" UNION ALL SELECT doc_id, unnest({TOKENS.format('lang')}) AS term, 2.0 AS w FROM documents" if heading else ""
    return f"""{TERMS},
tok AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS term, 1.0 AS w FROM documents{both}),
len AS (SELECT doc_id, len({TOKENS.format("text")}){f" + len({TOKENS.format('lang')})" if heading else ""} AS n FROM documents),
st AS (SELECT count(*) AS n, avg(n) AS a FROM len),
tf AS (SELECT doc_id, term, sum(w)::DOUBLE AS f FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((st.n - d + 0.5) / (d + 0.5)) > 0 THEN ln((st.n - d + 0.5) / (d + 0.5)) ELSE 1e-6 END AS i, a FROM df, st),
bm AS (SELECT query_id, doc_id AS chunk_id, sum(i * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * len.n / a))) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (doc_id) {where} GROUP BY ALL)"""


@query
def dense_topk(spark, d):
    return rounded(R.dense_topk(vector_queries(spark, d), vectors(spark, d), K), score=6)


ORACLES["dense_topk"] = f"WITH {VEC}, s AS (SELECT query_id, chunk_id, list_dot_product(q, v) AS score FROM q, v) SELECT query_id, chunk_id, round(score, 6) AS score, {RANK} FROM s {TOP.format(k=K)}"


@query
def dense_topk_cosine(spark, d):
    return rounded(R.dense_topk(vector_queries(spark, d), vectors(spark, d), K, cosine=True), score=6)


COS = f"list_dot_product(q, v) / ({NORM.format('q')} * greatest({NORM.format('v')}, 1e-12))"
ORACLES["dense_topk_cosine"] = f"WITH {VEC}, s AS (SELECT query_id, chunk_id, {COS} AS score FROM q, v) SELECT query_id, chunk_id, round(score, 6) AS score, {RANK} FROM s {TOP.format(k=K)}"


@query
def vector_norm_stats(spark, d):
    v = vectors(spark, d).withColumn("n", V.norm(F.col("v")))
    return v.groupBy("series").agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("v")).cast("long").alias("least_dims"), F.max(F.size("v")).cast("long").alias("most_dims"), F.round(F.min("n"), 6).alias("least_norm"), F.round(F.max("n"), 6).alias("most_norm"), F.count_if(~V.finite(F.col("v"))).alias("not_finite"))


ORACLES["vector_norm_stats"] = f"WITH {VEC} SELECT series, count(*) AS vectors, CAST(min(len(v)) AS BIGINT) AS least_dims, CAST(max(len(v)) AS BIGINT) AS most_dims, round(min({NORM.format('v')}), 6) AS least_norm, round(max({NORM.format('v')}), 6) AS most_norm, CAST(0 AS BIGINT) AS not_finite FROM v GROUP BY series"


@query
def anchor_build(spark, d):
    a = R.anchors(vectors(spark, d), "series", DIMS)
    return a.select("series", F.posexplode("anchor").alias("dim", "x")).select("series", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def anchor_sql(key: str) -> str:
    return f"""{key}_m AS (SELECT {key}, i, avg(v[i]) AS x FROM (SELECT {key}, v, unnest(generate_series(1, {DIMS})) AS i FROM v) GROUP BY ALL),
{key}_a AS (SELECT {key}, list(x / n ORDER BY i) AS a FROM (SELECT {key}, i, x, sqrt(sum(x * x) OVER (PARTITION BY {key})) AS n FROM {key}_m) GROUP BY {key})"""


ORACLES["anchor_build"] = f"WITH {VEC}, {anchor_sql('series')} SELECT series, CAST(i - 1 AS BIGINT) AS dim, round(a[i], 6) AS x FROM (SELECT series, a, unnest(generate_series(1, {DIMS})) AS i FROM series_a)"


@query
def hierarchical_topk(spark, d):
    s = R.hierarchical_topk(vector_queries(spark, d), vectors(spark, d), DIMS, K)
    return rounded(s, score=6, series_score=6, document_score=6, chunk_score=6)


HIER = f"""{VEC}, {anchor_sql("series")}, {anchor_sql("document_key")},
h AS (SELECT query_id, chunk_id, list_dot_product(q, sa.a) / {NORM.format("q")} AS series_score, list_dot_product(q, da.a) / {NORM.format("q")} AS document_score, {COS} AS chunk_score
  FROM q, v JOIN series_a sa USING (series) JOIN document_key_a da USING (document_key)),
s AS (SELECT *, 0.1 * series_score + 0.1 * document_score + 0.8 * chunk_score AS score FROM h)"""
ORACLES["hierarchical_topk"] = f"WITH {HIER} SELECT query_id, chunk_id, round(score, 6) AS score, round(series_score, 6) AS series_score, round(document_score, 6) AS document_score, round(chunk_score, 6) AS chunk_score, {RANK} FROM s {TOP.format(k=K)}"


def dense_side(spark, d):
    """Each question's vector is the embeddings row of its id."""
    q = vectors(spark, d).join(questions(spark, d), F.col("chunk_id") == F.col("query_id")).select("query_id", "v")
    return q, vectors(spark, d).join(chunks(spark, d).select("chunk_id"), "chunk_id", "left_semi")


@query
def hierarchical_hybrid(spark, d):
    q, v = dense_side(spark, d)
    dense = R.hierarchical_topk(q, v, DIMS, K * R.OVERFETCH)
    lexical = R.bm25_topk(questions(spark, d), chunks(spark, d), K * R.OVERFETCH)
    return no_nulls(rounded(R.fuse(dense, lexical, K, (0.3, 0.7)), score=9), "dense_rank", "lexical_rank")


HQ = "q AS (SELECT item_id AS query_id, v AS q FROM benchmark JOIN v ON chunk_id = item_id)"
FUSE = """f AS (SELECT query_id, chunk_id, sum(p) AS score, max(dr) AS dense_rank, max(lr) AS lexical_rank FROM (
  SELECT query_id, chunk_id, 0.3 / (60 + rank) AS p, rank AS dr, NULL AS lr FROM dn UNION ALL SELECT query_id, chunk_id, 0.7 / (60 + rank), NULL, rank FROM lx) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, least(coalesce(dense_rank, 1000000000), coalesce(lexical_rank, 1000000000)), CAST(chunk_id AS VARCHAR)) AS BIGINT) AS rank FROM f)
SELECT query_id, chunk_id, round(score, 9) AS score, CAST(coalesce(dense_rank, 0) AS BIGINT) AS dense_rank, CAST(coalesce(lexical_rank, 0) AS BIGINT) AS lexical_rank, rank FROM r WHERE rank <= 8"""
VEC_DOCS = VEC.split("\nq AS")[0].rstrip(",").replace("FROM embeddings", "FROM embeddings JOIN documents ON doc_id = vec_id")
ORACLES["hierarchical_hybrid"] = f"""WITH {VEC_DOCS}, {HQ}, {anchor_sql("series")}, {anchor_sql("document_key")},
h AS (SELECT query_id, chunk_id, 0.1 * list_dot_product(q, sa.a) / {NORM.format("q")} + 0.1 * list_dot_product(q, da.a) / {NORM.format("q")} + 0.8 * ({COS}) AS score FROM q, v JOIN series_a sa USING (series) JOIN document_key_a da USING (document_key)),
dn AS (SELECT query_id, chunk_id, {RANK} FROM h {TOP.format(k=32)}), {bm25_sql()}, lx AS (SELECT query_id, chunk_id, {RANK} FROM bm {TOP.format(k=32)}), {FUSE}"""


@query
def rrf_fusion(spark, d):
    q, v = dense_side(spark, d)
    lexical = R.bm25_topk(questions(spark, d), chunks(spark, d), K * R.OVERFETCH)
    return no_nulls(rounded(R.fuse(R.dense_topk(q, v, K * R.OVERFETCH), lexical, K, (0.3, 0.7)), score=9), "dense_rank", "lexical_rank")


ORACLES["rrf_fusion"] = f"""WITH {VEC_DOCS}, {HQ}, h AS (SELECT query_id, chunk_id, list_dot_product(q, v) AS score FROM q, v),
dn AS (SELECT query_id, chunk_id, {RANK} FROM h {TOP.format(k=32)}), {bm25_sql()}, lx AS (SELECT query_id, chunk_id, {RANK} FROM bm {TOP.format(k=32)}), {FUSE}"""


@query
def lexical_query_terms(spark, d):
    return questions(spark, d).select("query_id", T.lexical_query(F.concat(F.lit("[3GPP Release 17] What is the "), F.col("text"))).alias("lexical"))


ORACLES["lexical_query_terms"] = f"""WITH t AS (SELECT item_id AS query_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower('What is the ' || text), '[a-z0-9]+') AS l FROM benchmark)),
k AS (SELECT query_id, t, min(i) AS i FROM t WHERE length(t) >= 2 AND t NOT IN {STOP} GROUP BY ALL)
SELECT item_id AS query_id, string_agg('"' || t || '"', ' OR ' ORDER BY i) AS lexical FROM benchmark LEFT JOIN k ON query_id = item_id GROUP BY item_id"""


@query
def bm25_stats(spark, d):
    tf, length = R.postings(chunks(spark, d))
    return length.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), F.round(F.avg("length"), 6).alias("avg_length")).crossJoin(F.broadcast(tf.agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("term").alias("terms"))))


ORACLES["bm25_stats"] = f"WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents), l AS (SELECT len({TOKENS.format('text')}) AS n FROM documents) SELECT n, tokens, avg_length, postings, terms FROM (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_length FROM l), (SELECT count(*) AS postings, count(DISTINCT term) AS terms FROM (SELECT DISTINCT doc_id, term FROM t))"


@query
def bm25_topk(spark, d):
    return rounded(R.bm25_topk(questions(spark, d), chunks(spark, d), K), score=6)


@query
def bm25_topk_series_filter(spark, d):
    only = chunks(spark, d).where(F.col("series").isin("src1", "src2", "src3")).select("chunk_id")
    return rounded(R.bm25_topk(questions(spark, d), chunks(spark, d), K, only), score=6)


@query
def bm25_candidate_set(spark, d):
    only = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")).distinct()
    return rounded(R.bm25_topk(questions(spark, d), chunks(spark, d), K, only), score=6)


@query
def bm25_two_field(spark, d):
    return rounded(R.bm25_topk(questions(spark, d), chunks(spark, d), K, heading="heading"), score=6)


OUT = f"SELECT query_id, chunk_id, round(score, 6) AS score, {RANK} FROM bm {TOP.format(k=K)}"
ORACLES["bm25_topk"] = f"WITH {bm25_sql()} {OUT}"
ORACLES["bm25_topk_series_filter"] = f"WITH {bm25_sql(where='''JOIN documents dd USING (doc_id) WHERE dd.source IN ('src1', 'src2', 'src3')''')} {OUT}"
ORACLES["bm25_candidate_set"] = f"WITH {bm25_sql(where='WHERE doc_id IN (SELECT doc_id FROM labels)')} {OUT}"
ORACLES["bm25_two_field"] = f"WITH {bm25_sql(heading=True)} {OUT}"


@query
def router_semantic(spark, d):
    return rounded(R.route(vector_queries(spark, d), R.anchors(vectors(spark, d), "series", DIMS), 5).drop("probability"), score=6)


@query
def router_softmax(spark, d):
    return rounded(R.route(vector_queries(spark, d), R.anchors(vectors(spark, d), "series", DIMS), 10).drop("score", "rank"), probability=6)


ROUTE = f"WITH {VEC}, {anchor_sql('series')}, p AS (SELECT query_id, series, list_dot_product(q, a) AS p, list_dot_product(q, a) / ({NORM.format('q')} * {NORM.format('a')}) AS score FROM q, series_a)"
ORACLES["router_semantic"] = f"{ROUTE} SELECT query_id, series, round(score, 6) AS score, {RANK.replace('chunk_id', 'series')} FROM p {TOP.format(k=5).replace('chunk_id', 'series')}"
ORACLES["router_softmax"] = f"{ROUTE}, e AS (SELECT query_id, series, exp((p - max(p) OVER (PARTITION BY query_id)) * 10) AS e FROM p) SELECT query_id, series, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS probability FROM e"


@query
def router_neural(spark, d):
    rng = np.random.default_rng(3)
    sizes = {"a": [DIMS, 768, 512, 256], "b": [18, 128, 256], "c": [256, 128, 18]}
    w: dict = {"alpha": 0.6, "beta": 0.4}
    for n, s in sizes.items():
        for i, (x, y) in enumerate(zip(s, s[1:], strict=False)):
            w |= {f"{n}{i}": rng.standard_normal((x, y)) / np.sqrt(x), f"{n}{i}_bias": np.zeros(y)}
        if n != "c":
            w |= {f"{n}_{k}": np.full(256, v) for k, v in (("mean", 0.0), ("var", 1.0), ("gamma", 1.0), ("beta", 0.0))}
    return R.neural_route(vector_queries(spark, d), rng.standard_normal((18, DIMS)).tolist(), w, [str(s) for s in range(21, 39)], 5)


@query
def series_selection(spark, d):
    have = chunks(spark, d).select("series").distinct()
    asked = have.where("series in ('src1', 'src3', 'src5')").unionByName(spark.sql("select explode(array('src998', 'src999')) as series"))
    return R.select_series(asked, have, "src0")


ORACLES["series_selection"] = "WITH a AS (SELECT DISTINCT source AS series FROM documents), c AS (SELECT series FROM a WHERE series IN ('src1', 'src3', 'src5') UNION SELECT 'src998' UNION SELECT 'src999') SELECT series, CASE WHEN series IN (SELECT series FROM a) THEN 'searched' ELSE 'empty' END AS status FROM c UNION SELECT series, 'searched' FROM a WHERE series = 'src0'"


def cited(spark, d):
    """Chunks by file (source), document (lang) and heading 'h' or 'h.k'; references derived from the id."""
    head = F.concat(F.lit("h"), (F.col("doc_id") % 11).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("."), (F.col("doc_id") % 3).cast("string"))).otherwise(F.lit("")))
    base = table(spark, d, "documents")
    c = base.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file"), F.col("lang").alias("document_id"), head.alias("heading"), F.col("doc_id").alias("position"))
    i = F.col("doc_id")
    refs = [
        ("internal", F.col("source"), F.col("lang"), F.concat(F.lit("h"), ((7 * i + 1) % 11).cast("string"))),
        ("external", F.concat(F.lit("src"), ((3 * i + 1) % 23).cast("string")), F.lit("en"), F.concat(F.lit("h"), ((5 * i + 3) % 13).cast("string"))),
        ("other", F.col("source"), F.col("lang"), F.lit("h1")),
        ("external", F.when(i % 5 != 0, F.lit("src1")), F.when(i % 4 != 0, F.lit("en")), F.lit("h9")),
    ]
    r = None
    for n, (kind, file, doc, heading) in enumerate(refs):
        one = base.select(i.alias("parent_id"), F.lit(n).cast("long").alias("ref"), F.lit(kind).alias("type"), file.alias("target_file"), doc.alias("document_id"), heading.alias("target_heading"))
        r = one if r is None else r.unionByName(one)
    return r, c


CITE = """c AS (SELECT doc_id AS chunk_id, source AS file, lang AS document_id, 'h' || (doc_id % 11) || CASE WHEN doc_id % 2 = 0 THEN '.' || (doc_id % 3) ELSE '' END AS heading FROM documents),
r AS (SELECT doc_id AS parent_id, 0 AS ref, 'internal' AS type, source AS tf, lang AS td, 'h' || ((7 * doc_id + 1) % 11) AS th FROM documents
 UNION ALL SELECT doc_id, 1, 'external', 'src' || ((3 * doc_id + 1) % 23), 'en', 'h' || ((5 * doc_id + 3) % 13) FROM documents
 UNION ALL SELECT doc_id, 3, 'external', CASE WHEN doc_id % 5 <> 0 THEN 'src1' END, CASE WHEN doc_id % 4 <> 0 THEN 'en' END, 'h9' FROM documents),
ex AS (SELECT parent_id, ref, type, 'resolved' AS status, chunk_id AS target_id FROM r JOIN c ON tf = file AND td = document_id AND th = heading),
de AS (SELECT parent_id, ref, type, 'resolved_descendant' AS status, chunk_id AS target_id FROM (SELECT * FROM r ANTI JOIN ex USING (parent_id, ref)) JOIN c ON tf = file AND td = document_id AND starts_with(heading, th || '.')),
no AS (SELECT parent_id, ref, type, CASE WHEN tf IS NULL THEN 'missing_target_chunk_file' WHEN td IS NULL THEN 'invalid_target_reference' WHEN tf NOT IN (SELECT source FROM documents) THEN 'target_chunk_file_missing' ELSE 'target_heading_not_found' END AS status, NULL AS target_id
 FROM r ANTI JOIN ex USING (parent_id, ref) ANTI JOIN de USING (parent_id, ref)),
res AS (SELECT * FROM ex UNION ALL SELECT * FROM de UNION ALL SELECT * FROM no)"""


@query
def citation_resolve(spark, d):
    g = C.resolve(*cited(spark, d))
    return g.groupBy("parent_id", "ref", "type", "status").agg(F.count("target_id").alias("targets"), F.coalesce(F.min("target_id"), F.lit(-1)).alias("first_target"))


ORACLES["citation_resolve"] = f"WITH {CITE} SELECT parent_id, CAST(ref AS BIGINT) AS ref, type, status, count(target_id) AS targets, CAST(coalesce(min(target_id), -1) AS BIGINT) AS first_target FROM res GROUP BY ALL"


@query
def citation_decisions(spark, d):
    g = C.resolve(*cited(spark, d))
    return g.select("parent_id", "ref", "type", "status").distinct().groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


ORACLES["citation_decisions"] = f"WITH {CITE} SELECT type, status, count(*) AS n FROM (SELECT DISTINCT parent_id, ref, type, status FROM res) GROUP BY ALL"


def seeds(spark, d):
    s = R.dense_topk(vector_queries(spark, d), vectors(spark, d), K)
    return s.select("query_id", "chunk_id", F.col("rank").alias("pos"))


def by_product(spark, d):
    q, v = vector_queries(spark, d).withColumnRenamed("v", "q"), vectors(spark, d).select("chunk_id", "v")
    return lambda c: c.join(v, "chunk_id").join(F.broadcast(q), "query_id").select("query_id", "chunk_id", V.dot(F.col("q"), F.col("v")).alias("score"))


SEED = f"s0 AS (SELECT query_id, chunk_id, list_dot_product(q, v) AS score FROM q, v), sd AS (SELECT query_id, chunk_id, {RANK} FROM s0 {TOP.format(k=K)})"


def bfs_sql(scores: str, frontier: str = "sd", depth: int = 1) -> str:
    again = "" if frontier == "sd" else f" ANTI JOIN {frontier} USING (query_id, chunk_id)"
    return f"""g AS (SELECT fo.query_id, fo.rank AS pos, res.parent_id, ref, target_id AS chunk_id FROM {frontier} fo JOIN res ON fo.chunk_id = res.parent_id AND target_id IS NOT NULL),
fr AS (SELECT * FROM g ANTI JOIN sd USING (query_id, chunk_id){again}), {scores},
a AS (SELECT fr.*, score, row_number() OVER (PARTITION BY query_id, pos, ref ORDER BY round(score, 9) DESC NULLS LAST, chunk_id) AS ig FROM fr LEFT JOIN sc USING (query_id, chunk_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos, ref, ig) AS fi FROM a WHERE ig <= 4 AND score IS NOT NULL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos, ref, ig) AS BIGINT) AS rank FROM b WHERE fi = 1)
SELECT query_id, CAST(parent_id AS BIGINT) AS parent_id, CAST(chunk_id AS BIGINT) AS chunk_id, CAST({depth} AS BIGINT) AS depth, round(score, 6) AS score, rank FROM o WHERE rank <= 4"""


@query
def citation_semantic_bfs(spark, d):
    return rounded(C.expand(seeds(spark, d), C.resolve(*cited(spark, d)), by_product(spark, d)), score=6)


PRODUCT = "sc AS (SELECT query_id, chunk_id, list_dot_product(q, v) AS score FROM (SELECT DISTINCT query_id, chunk_id FROM fr) JOIN v USING (chunk_id) JOIN q USING (query_id))"
ORACLES["citation_semantic_bfs"] = f"WITH {VEC}, {CITE}, {SEED}, {bfs_sql(PRODUCT)}"


@query
def citation_rrf_bfs(spark, d):
    texts = chunks(spark, d)
    q = vector_queries(spark, d).select("query_id").join(texts, F.col("query_id") == F.col("chunk_id")).select("query_id", "text")
    references, targets = cited(spark, d)
    resolved = lambda parents: C.resolve(references.join(parents.withColumnRenamed("chunk_id", "parent_id"), "parent_id", "left_semi"), targets)
    return rounded(C.expand(seeds(spark, d), resolved, lambda c: C.rrf_scores(c, by_product(spark, d)(c), R.bm25(q, texts, c))), score=9)


ASKED = "(SELECT doc_id, text FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)) asked"
FUSED = """cd AS (SELECT DISTINCT query_id, chunk_id FROM fr), pr AS (SELECT query_id, chunk_id, list_dot_product(q, v) AS score FROM cd JOIN v USING (chunk_id) JOIN q USING (query_id)),
dr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS n FROM pr),
lr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS n FROM cd JOIN bm USING (query_id, chunk_id)),
sc AS (SELECT query_id, chunk_id, coalesce(0.3 / (60 + dr.n), 0) + coalesce(0.7 / (60 + lr.n), 0) AS score FROM dr FULL JOIN lr USING (query_id, chunk_id))"""
ORACLES["citation_rrf_bfs"] = f"WITH {VEC}, {CITE}, {SEED}, {bm25_sql().replace('item_id', 'doc_id').replace('FROM benchmark', 'FROM ' + ASKED)}, {bfs_sql(FUSED).replace('round(score, 6)', 'round(score, 9)')}"


@query
def citation_semantic_bfs_depth2(spark, d):
    return rounded(C.expand(seeds(spark, d), C.resolve(*cited(spark, d)), by_product(spark, d), depth=2), score=6)


ORACLES["citation_semantic_bfs_depth2"] = f"WITH {VEC}, {CITE}, {SEED}, p1 AS (WITH {bfs_sql(PRODUCT)}), p2 AS (WITH {bfs_sql(PRODUCT, 'p1', 2)}) SELECT * FROM p1 UNION ALL SELECT * FROM p2"


def facet_cover(spark, d):
    """Facets of a question are three fixed vectors; a chunk covers them by its cosine with each."""
    v = vectors(spark, d).select("chunk_id", V.normalised(F.col("v")).alias("v"))
    facets = v.where("chunk_id in (1, 2, 3)").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "v"))).alias("f")).select(F.col("f.v").alias("f"))
    covers = v.crossJoin(F.broadcast(facets)).select("chunk_id", F.transform("f", lambda f: V.dot(f, F.col("v"))).alias("cover"))
    return lambda rows: rows.join(covers, "chunk_id")


def gain_of(spark, d, **limits):
    work = Workspace(spark, "citation_gain")
    return C.gain_expansion(work.save(seeds(spark, d), "seeds"), work.save(C.resolve(*cited(spark, d)), "resolved"), facet_cover(spark, d), **limits)


@query
def citation_gain(spark, d):
    return rounded(gain_of(spark, d)[0].select("query_id", "parent_id", "chunk_id", "gain", "rank"), gain=6)


@query
def citation_gain_depth2(spark, d):
    return rounded(gain_of(spark, d, depth=2)[0].select("query_id", "depth", "parent_id", "chunk_id", "gain", "rank"), gain=6)


@query
def citation_selected_sums(spark, d):
    return C.selected_sums(gain_of(spark, d)[0], "gain").drop("score_sum")


@query
def citation_trail(spark, d):
    work = Workspace(spark, "citation_trail")  # written once each, as the trails read them many times
    s, g = work.save(seeds(spark, d), "seeds"), work.save(C.resolve(*cited(spark, d)), "resolved")
    trails = [("semantic", C.ranked_trail(s, g, by_product(spark, d))), ("gain", C.gain_expansion(s, g, facet_cover(spark, d))[1])]
    each = [t.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("strategy"), "type", "status", "n") for name, t in trails]
    return each[0].unionByName(each[1])


@query
def citation_gain_first_pick(spark, d):
    return rounded(gain_of(spark, d, per_depth=1, per_heading=10**6)[0].select("query_id", "parent_id", "chunk_id", "gain"), gain=6)


ORACLES["citation_gain_first_pick"] = f"""WITH {VEC}, {CITE}, {SEED}, nv AS (SELECT chunk_id, list_transform(v, lambda x: x / {NORM.format("v")}) AS v FROM v),
f AS (SELECT chunk_id AS k, v AS f FROM nv WHERE chunk_id IN (1, 2, 3)),
cov AS (SELECT chunk_id, k, list_dot_product(f, v) AS c FROM nv, f),
g AS (SELECT sd.query_id, sd.rank * 1000000000000 + ref * 10000000000 + target_id AS ord, parent_id, target_id AS chunk_id FROM sd JOIN res ON sd.chunk_id = parent_id AND target_id IS NOT NULL),
h AS (SELECT * FROM g ANTI JOIN sd USING (query_id, chunk_id)),
p AS (SELECT query_id, ord, parent_id, h.chunk_id, max(greatest(0, t.c - s.c)) AS gain, sum(greatest(0, t.c - s.c)) AS total FROM h JOIN cov t ON t.chunk_id = h.chunk_id JOIN cov s ON s.chunk_id = parent_id AND s.k = t.k GROUP BY ALL)
SELECT query_id, CAST(parent_id AS BIGINT) AS parent_id, CAST(chunk_id AS BIGINT) AS chunk_id, round(gain, 6) AS gain FROM p WHERE gain > 0 AND gain + 1e-12 >= 0.01 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(gain, 9) DESC, round(total, 9) DESC, ord) = 1"""


def part_terms(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("definition"), F.min("p_partkey").alias("ord"))


@query
def enrich_terms(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Is a "), F.upper("p_name"), F.lit("'s part big?")).alias("text"))
    return W.matched_terms(q, part_terms(spark, d))


ORACLES["enrich_terms"] = "WITH t AS (SELECT p_name AS term, min(p_type) AS definition, min(p_partkey) AS ord, lower(p_name) AS f FROM part GROUP BY p_name) SELECT p_partkey AS query_id, term, definition, ord FROM part JOIN t ON contains(lower('Is a ' || upper(p_name) || 's part big?'), f)"


@query
def enrich_abbreviations(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    a = spark.sql("select * from values ('the', 'definite'), ('The', 'Definite'), ('der', 'article'), ('of', 'genitive') as t(word, expansion)")
    m = W.matched_abbreviations(q, F.broadcast(a))
    return m.groupBy("query_id", "word", "expansion").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first_pos"))


ORACLES["enrich_abbreviations"] = r"""WITH a AS (SELECT * FROM (VALUES ('the', 'definite'), ('The', 'Definite'), ('der', 'article'), ('of', 'genitive')) t(word, expansion)),
w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[!()\-\[\]{};:''"\\,<>./?@#$%^&*_~]', '', 'g'), '\s+'), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM w)
SELECT doc_id AS query_id, word, expansion, count(*) AS n, CAST(min(pos) AS BIGINT) AS first_pos FROM e JOIN a USING (word) GROUP BY ALL"""


@query
def acronym_candidates(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return W.acronym_candidates(s.select(F.substring("n_name", 1, 8).alias("acronym"), F.concat_ws("-", F.lit("Group"), (F.col("s_suppkey") % 3).cast("string")).alias("expansion"), F.col("s_suppkey").alias("source"), F.col("s_suppkey").alias("ord")))


ORACLES["acronym_candidates"] = "WITH s AS (SELECT substr(n_name, 1, 8) AS acronym, 'Group-' || (s_suppkey % 3) AS expansion FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT acronym, expansion, count(*) AS source_count FROM s GROUP BY ALL) SELECT acronym, expansion, source_count, count(*) OVER (PARTITION BY acronym) = 1 AS usable FROM m"


@query
def option_parse_score(spark, d):
    c = table(spark, d, "conversations")
    said = F.concat(F.col("text"), F.lit(" Option "), (F.col("turn") % 5).cast("string"), F.lit("."))
    expected = F.when(F.col("conv_id") % 9 != 0, F.concat(F.lit("option "), (F.col("conv_id") % 4).cast("string")))
    p = T.extract_option(said)
    return c.select("conv_id", "turn", p.alias("predicted"), T.option_number(said).alias("number"), T.scored(p, expected).alias("is_correct"))


ORACLES["option_parse_score"] = r"""WITH a AS (SELECT conv_id, turn, text || ' Option ' || (turn % 5) || '.' AS t, CASE WHEN conv_id % 9 <> 0 THEN 'option ' || (conv_id % 4) END AS e FROM conversations),
b AS (SELECT *, nullif(regexp_extract(coalesce(t, ''), '(?i)\boption\s*([1-9][0-9]*)\b', 1), '') AS n, regexp_extract(coalesce(t, ''), '(?i)\boption\s*([0-9]+)\b', 1) AS m FROM a)
SELECT conv_id, turn, 'option ' || n AS predicted, TRY_CAST(m AS BIGINT) AS number, CASE WHEN e IS NOT NULL THEN coalesce('option ' || n = e, false) END AS is_correct FROM b"""


@query
def prompt_render(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(T.seed_header(F.col("source"), F.lit(None), F.col("lang"), F.col("doc_id")), F.lit("\n"), F.col("text")).alias("block"))


ORACLES["prompt_render"] = "SELECT doc_id AS chunk_id, '[series=' || source || '; document=None; heading=' || lang || '; chunk_id=' || doc_id || ']' || chr(10) || text AS block FROM documents"


@query
def checkpoint_last_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return E.last_wins(e, "user_id", "event_id")


ORACLES["checkpoint_last_wins"] = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query
def resume_pending(spark, d):
    return E.pending(dataset(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("question_id")))


ORACLES["resume_pending"] = "SELECT doc_id AS question_id, lang AS category, 14 + doc_id % 6 AS release FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


@query
def progress_running(spark, d):
    r = runs(spark, d).select(F.col("run").alias("group"), F.col("question_id").alias("seq"), "is_correct")
    return E.progress(r, 10)


RUNS = "runs AS (SELECT 'A' AS run, doc_id AS question_id, quality = 1 AS is_correct FROM labels UNION ALL SELECT 'B', doc_id, toxic = 1 FROM labels UNION ALL SELECT 'C', doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 END FROM labels)"
ORACLES["progress_running"] = f"""WITH {RUNS}, w AS (SELECT run AS "group", count(*) OVER u AS completed, count(is_correct) OVER u AS evaluated, CAST(coalesce(sum(is_correct::INT) OVER u, 0) AS BIGINT) AS correct, count(*) OVER (PARTITION BY run) AS total FROM runs WINDOW u AS (PARTITION BY run ORDER BY question_id ROWS UNBOUNDED PRECEDING))
SELECT "group", completed, evaluated, correct, round(CASE WHEN evaluated = 0 THEN 0 ELSE correct / evaluated END, 6) AS accuracy FROM w WHERE completed % 10 = 0 OR completed = total"""


@query
def run_summary(spark, d):
    return E.summary(runs(spark, d).where("run = 'C'"), dataset(spark, d))


ORACLES["run_summary"] = f"""WITH {RUNS}, o AS (SELECT lang AS category, run IS NOT NULL AS ran, is_correct FROM documents LEFT JOIN (SELECT * FROM runs WHERE run = 'C') ON question_id = doc_id),
a AS (SELECT category, count(*) FILTER (ran) AS run_rows, count(*) AS dataset_questions, count(is_correct) AS scored, count(*) FILTER (is_correct) AS correct, count(*) FILTER (ran AND is_correct IS NULL) AS unscored FROM o GROUP BY GROUPING SETS ((category), ()))
SELECT *, round_even(100.0 * correct / nullif(scored, 0), 2) AS accuracy, round_even(100.0 * scored / dataset_questions, 2) AS coverage FROM a"""


@query
def run_unknown_ids(spark, d):
    known = dataset(spark, d).where("category = 'en'")
    return runs(spark, d).join(known, "question_id", "left_anti").select("run", "question_id")


ORACLES["run_unknown_ids"] = f"WITH {RUNS} SELECT run, question_id FROM runs WHERE question_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"


@query
def compare_slices(spark, d):
    return E.slices(runs(spark, d), dataset(spark, d), "release", list(range(14, 20)))


ORACLES["compare_slices"] = f"WITH {RUNS}, g AS (SELECT run, release FROM (SELECT DISTINCT run FROM runs), (SELECT unnest(generate_series(14, 19)) AS release)), n AS (SELECT run, 14 + question_id % 6 AS release, count(*) AS n FROM runs JOIN documents ON doc_id = question_id WHERE is_correct GROUP BY ALL) SELECT run, release, coalesce(n, 0) AS correct FROM g LEFT JOIN n USING (run, release)"


@query
def compare_pairwise(spark, d):
    return E.pairwise(runs(spark, d))


ORACLES["compare_pairwise"] = f"WITH {RUNS} SELECT a.run AS left_run, b.run AS right_run, count(*) FILTER (a.is_correct AND NOT b.is_correct) AS left_only, count(*) FILTER (NOT a.is_correct AND b.is_correct) AS right_only, count(*) FILTER (a.is_correct AND b.is_correct) AS both_correct, count(*) FILTER (NOT a.is_correct AND NOT b.is_correct) AS both_wrong FROM runs a JOIN runs b ON a.question_id = b.question_id AND a.run < b.run WHERE a.is_correct IS NOT NULL AND b.is_correct IS NOT NULL GROUP BY ALL"


@query
def compare_baseline(spark, d):
    r = runs(spark, d)
    return E.compare(r.where("run = 'C'"), r.where("run = 'A'"))


ORACLES["compare_baseline"] = f"WITH {RUNS}, j AS (SELECT x.is_correct AS c, y.is_correct AS b FROM runs x JOIN runs y USING (question_id) WHERE x.run = 'C' AND y.run = 'A' AND x.is_correct IS NOT NULL AND y.is_correct IS NOT NULL) SELECT count(*) AS shared, count(*) FILTER (c) AS candidate_correct, count(*) FILTER (b) AS baseline_correct, count(*) FILTER (c AND NOT b) AS improved, count(*) FILTER (NOT c AND b) AS regressed, count(*) FILTER (c = b) AS unchanged, round(count(*) FILTER (c) / count(*), 6) AS candidate_accuracy FROM j"


@query
def venn_regions(spark, d):
    return E.regions(runs(spark, d), ["A", "B", "C"])


ORACLES["venn_regions"] = f"WITH {RUNS}, m AS (SELECT question_id, max(CASE WHEN run = 'A' AND is_correct THEN 1 ELSE 0 END) || '' || max(CASE WHEN run = 'B' AND is_correct THEN 1 ELSE 0 END) || max(CASE WHEN run = 'C' AND is_correct THEN 1 ELSE 0 END) AS mask FROM runs GROUP BY question_id) SELECT mask, count(*) AS questions FROM m WHERE mask <> '000' GROUP BY mask"


@query
def coverage_diff(spark, d):
    return E.coverage_difference(dataset(spark, d), runs(spark, d))


ORACLES["coverage_diff"] = "SELECT 'missing' AS side, doc_id AS question_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"


@query
def asset_digests(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source")).cast("binary"), 256).alias("row_sha256"))


ORACLES["asset_digests"] = """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS row_sha256 FROM documents"""


@query
def config_flatten(spark, d):
    t = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return t.select("event_id", "key", "value", F.col("value").try_cast("double").isNotNull().alias("is_number"))


ORACLES["config_flatten"] = "SELECT event_id, key, props->>key AS value, TRY_CAST(props->>key AS DOUBLE) IS NOT NULL AS is_number FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)"


@query
def trace_rounding(spark, d):
    s = R.dense_topk(vector_queries(spark, d), vectors(spark, d), K)
    return s.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 6).alias("total"))


ORACLES["trace_rounding"] = f"WITH {VEC}, {SEED.replace('SELECT query_id, chunk_id, CAST', 'SELECT query_id, chunk_id, score, CAST')} SELECT query_id, count(*) AS hits, round(max(score), 6) AS best, round(sum(score), 6) AS total FROM sd GROUP BY query_id"
