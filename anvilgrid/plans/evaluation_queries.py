"""Further named queries: questions and prompts, joins and checks of a corpus, reports of runs, a whole benchmark.

They are registered beside those of the catalogue, over the same bindings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from anvilgrid.functions import text as T
from anvilgrid.functions import vectors as V
from anvilgrid.operators import checks as X
from anvilgrid.operators import citations as C
from anvilgrid.operators import retrieval as R
from anvilgrid.operators import runs as E
from anvilgrid.operators import vocabulary as W
from anvilgrid.plans import evaluation as B
from anvilgrid.plans.catalogue import CITE, DIMS, FUSE, ORACLES, PRODUCT, RANK, RUNS, SEED, STOP, TOKENS, TOP, VEC, anchor_sql, bfs_sql, bm25_sql, by_product, chunks, cited, dataset, dense_side, query, questions, rounded, runs, seeds, table, vectors
from anvilgrid.plans.models import EchoClient
from anvilgrid.sources import readers, sinks


def values(spark, text: str):
    return spark.sql(f"select * from values {text}")


TERMS = "('the', 'an article', 1), ('Of The', 'a pair', 2), ('de-la', 'another: pair', 3), ('zzqq', 'none', 4)"
SHORT = "('of', 'genitive'), ('de', 'of'), ('The', 'first')"


@query
def enrich_questions(spark, d):
    q = questions(spark, d).select("query_id", "text")
    return W.enrich(q, values(spark, TERMS + " as t(term, definition, ord)"), values(spark, SHORT + " as t(word, expansion)"))


BARE = r"""regexp_replace({0}, '[!()\-\[\]{{}};:''"\\,<>./?@#$%^&*_~]', '', 'g')"""
ORACLES["enrich_questions"] = rf"""WITH t AS (SELECT * FROM (VALUES {TERMS}) t(term, definition, ord)), a AS (SELECT * FROM (VALUES {SHORT}) a(word, expansion)),
q AS (SELECT item_id, text FROM benchmark),
m AS (SELECT item_id, string_agg(term || ': ' || definition, chr(10) ORDER BY ord) AS l FROM q JOIN t ON contains({BARE.format('lower(text)')}, {BARE.format('lower(term)')}) GROUP BY item_id),
w AS (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT item_id, list_filter(string_split_regex({BARE.format('text')}, '\s+'), lambda x: x <> '') AS l FROM q)),
b AS (SELECT item_id, string_agg(word || ': ' || expansion, chr(10) ORDER BY i) AS l FROM w JOIN a USING (word) GROUP BY item_id)
SELECT item_id AS query_id, text || chr(10) || chr(10) || 'Terms and Definitions:' || chr(10) || chr(10) || coalesce(m.l, '') || chr(10) || chr(10) || 'Abbreviations:' || chr(10) || chr(10) || coalesce(b.l, '') || chr(10) AS enriched
FROM q LEFT JOIN m USING (item_id) LEFT JOIN b USING (item_id)"""


@query
def facet_clean(spark, d):
    said = F.concat(F.lit(" -According to [3GPP Release 17] the 3GPP release 15 "), F.col("text"), F.lit("  in Release 9, of the"))
    return questions(spark, d).select("query_id", T.clean_facet(said).alias("facet"), T.without_tag(said).alias("bare"))


ORACLES["facet_clean"] = r"""WITH q AS (SELECT item_id, ' -According to [3GPP Release 17] the 3GPP release 15 ' || text || '  in Release 9, of the' AS t FROM benchmark),
a AS (SELECT item_id, regexp_replace(t, '(?i)\s*\[\s*3GPP\s+Release\s+\d+\s*\]\s*', ' ', 'g') AS t FROM q),
b AS (SELECT item_id, t AS bare, regexp_replace(t, '(?i)\b(?:according\s+to\s+|under\s+|in\s+|for\s+|from\s+|within\s+)?(?:the\s+)?(?:3GPP\s+)?Release\s+\d+\b', ' ', 'g') AS t FROM a),
c AS (SELECT item_id, bare, regexp_replace(t, '(?i)(?:\b(?:according\s+to|under|in|for|from|within|of|the|context\s+of|reference\s+to)\b\s*)+$', '', 'g') AS t FROM b)
SELECT item_id AS query_id, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ,;:-') AS facet, trim(bare) AS bare FROM c"""


def quiz(spark, d):
    """Benchmark items as questions: four options, the expected one by id, none for some."""
    i = F.col("item_id")
    options = F.array(*[F.struct(F.lit(n).alias("n"), F.concat(F.lit("choice "), ((i * n) % 7).cast("string")).alias("text")) for n in (2, 1, 4, 3)])
    answer = F.when(i % 6 != 0, F.concat(F.lit("option "), (i % 4 + 1).cast("string"), F.lit(": so")))
    return table(spark, d, "benchmark").select(i.alias("query_id"), F.col("text").alias("question"), options.alias("options"), answer.alias("answer"))


QUIZ = f"""SELECT item_id, text, text || chr(10) || chr(10) || 'Option 1: choice ' || (item_id % 7) || chr(10) || 'Option 2: choice ' || (item_id * 2 % 7) || chr(10) || 'Option 3: choice ' || (item_id * 3 % 7) || chr(10) || 'Option 4: choice ' || (item_id * 4 % 7)
  || chr(10) || chr(10) || '{T.ANSWER_FORMAT}' AS prompt, CASE WHEN item_id % 6 <> 0 THEN 'option ' || (item_id % 4 + 1) END AS expected FROM benchmark"""


@query
def answer_prompts(spark, d):
    return quiz(spark, d).select("query_id", T.answer_prompt(F.col("question"), F.col("options")).alias("prompt"), T.extract_option(F.col("answer")).alias("expected"))


ORACLES["answer_prompts"] = f"SELECT item_id AS query_id, prompt, expected FROM ({QUIZ})"


@query
def question_order(spark, d):
    s = B.Settings(DIMS, limit=20, reverse=True)
    q = questions(spark, d).select(F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("question "), F.col("query_id").cast("string"))).otherwise(F.concat(F.lit("q"), F.col("query_id").cast("string"))).alias("query_id"))
    return B.choose_questions(q, s)


ORACLES["question_order"] = "SELECT query_id FROM (SELECT CASE WHEN item_id % 3 <> 0 THEN 'question ' || item_id ELSE 'q' || item_id END AS query_id, item_id FROM benchmark) ORDER BY item_id % 3 <> 0, CASE WHEN item_id % 3 = 0 THEN query_id END DESC, item_id DESC LIMIT 20"


@query
def text_forms(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.lit(" a\\"), F.col("source"), F.lit("/"), i.cast("string"), F.lit("//"))
    c = F.when(i % 4 == 0, T.CATEGORIES[0]).when(i % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("lang")))
    return table(spark, d, "documents").select(
        "doc_id", T.document_id(path).alias("document"), T.slug(F.concat(F.col("source"), F.lit(" & Co. "), F.col("lang"))).alias("slug"), T.category(c).alias("category"),
        T.known_category(c).alias("known"), T.release(F.concat(F.lit("[3gpp release "), (i % 20).cast("string"), F.lit("]"))).alias("release"), T.percentage(F.when(i % 3 != 0, F.round(i / 7, 2))).alias("percentage"),
    )


ORACLES["text_forms"] = """SELECT doc_id, CAST(doc_id AS VARCHAR) AS document, trim(regexp_replace(lower(source || ' & Co. ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
CASE WHEN doc_id % 4 = 0 THEN 'Standards specifications' WHEN doc_id % 4 = 1 THEN 'Uncategorized' ELSE lang END AS category, CASE WHEN doc_id % 4 = 0 THEN 'Standards specifications' END AS known,
CAST(doc_id % 20 AS BIGINT) AS release, CASE WHEN doc_id % 3 <> 0 THEN printf('%.2f%%', round(doc_id / 7.0, 2)) ELSE 'n/a' END AS percentage FROM documents"""


def metadata(spark, d):
    """Rows of a selection: chunks of each file (source) in order, a third of them without a place, some by id alone."""
    place = F.row_number().over(R.Window.partitionBy("file").orderBy("chunk_id")) - 1
    c = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("chunk_id"), F.length("text").alias("size")).withColumn("source_chunk_index", place.cast("long"))
    m = c.select("file", "chunk_id", F.when(F.col("chunk_id") % 3 != 0, F.col("source_chunk_index")).alias("source_chunk_index"))
    return m, c


@query
def source_join(spark, d):
    return X.with_source(*metadata(spark, d)).select("file", "chunk_id", F.col("source.source_chunk_index").alias("place"), F.coalesce(F.col("source.size"), F.lit(0)).cast("long").alias("size"))


ORACLES["source_join"] = "SELECT source AS file, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS place, CAST(length(coalesce(text, '')) AS BIGINT) AS size FROM documents"


def rows_of(spark, d):
    row = (F.row_number().over(R.Window.partitionBy("series").orderBy("chunk_id")) - 1).cast("long")
    return vectors(spark, d).withColumn("embedding_row", row).select("series", "embedding_row", "chunk_id", "v")


@query
def positioned_join(spark, d):
    r = rows_of(spark, d)
    return X.positioned(r.select("series", "embedding_row", F.size("v").cast("long").alias("dims")), r.select("series", "embedding_row", "chunk_id"))


ORACLES["positioned_join"] = f"WITH {VEC} SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY chunk_id) - 1 AS BIGINT) AS embedding_row, CAST(len(v) AS BIGINT) AS dims, chunk_id FROM v"


@query
def lexical_metadata_join(spark, d):
    hits = R.bm25_topk(questions(spark, d), chunks(spark, d), 4).join(chunks(spark, d).select("chunk_id", "series"), "chunk_id")
    place = (F.row_number().over(R.Window.partitionBy("series").orderBy("chunk_id")) - 1).cast("long")
    rows = chunks(spark, d).select("series", "chunk_id", "heading").withColumn("embedding_row", place)
    at = rows.select("chunk_id", F.col("embedding_row").alias("metadata_index"))
    found = X.lexical_metadata(hits.join(at, "chunk_id").drop("chunk_id"), rows)
    return rounded(found.select("query_id", "chunk_id", "heading", "score"), score=6)


ORACLES["lexical_metadata_join"] = f"WITH {bm25_sql()} SELECT query_id, chunk_id, lang AS heading, round(score, 6) AS score FROM (SELECT * FROM bm {TOP.format(k=4)}) JOIN documents ON doc_id = chunk_id"


@query
def corpus_violations(spark, d):
    """Planted faults: a short vector, one that is not finite, rows too many, a wrong index, another chunk's id, a wrong digest."""
    i = F.col("chunk_id")
    v = rows_of(spark, d).withColumn("v", F.when(i % 50 == 1, F.slice("v", 1, 3)).when(i % 50 == 2, F.transform("v", lambda x: x / F.lit(0.0).cast("float") if False else x * F.lit(float("inf")))).otherwise(F.col("v")))
    c = rows_of(spark, d).select("series", F.col("embedding_row").alias("source_chunk_index"), "chunk_id").withColumn("body", X.canonical_json(["chunk_id", "series"]))
    m = rows_of(spark, d).select("series", "embedding_row", F.when(i % 50 == 3, -1).otherwise(F.col("embedding_row")).cast("long").alias("source_chunk_index"), F.when(i % 50 == 4, -i).otherwise(i).alias("chunk_id"))
    man = rows_of(spark, d).groupBy("series").agg((F.count(F.lit(1)) + F.when(F.col("series") == "3", 1).otherwise(0)).alias("chunk_count")).join(X.selected_digest(c.where(F.col("chunk_id") % 50 != 3), "series", "source_chunk_index", "body"), "series", "left")
    man = man.select("series", "chunk_count", F.when(F.col("series") == "5", "none").otherwise(F.col("digest")).alias("source_sha256"), F.lit(None).cast("string").alias("metadata_sha256"))
    return X.corpus_violations(man, v, m, c, DIMS)


ORACLES["corpus_violations"] = """WITH e AS (SELECT CAST(label AS VARCHAR) AS series, vec_id AS i FROM embeddings),
p AS (SELECT series, 'dimensions' AS problem, count(*) AS n FROM e WHERE i % 50 = 1 GROUP BY ALL UNION ALL SELECT series, 'not_finite', count(*) FROM e WHERE i % 50 = 2 GROUP BY ALL
UNION ALL SELECT series, 'chunk_index', count(*) FROM e WHERE i % 50 = 3 GROUP BY ALL UNION ALL SELECT series, 'chunk_identity', count(*) FROM e WHERE i % 50 = 4 AND i <> 0 GROUP BY ALL
UNION ALL SELECT DISTINCT series, 'row_count', 1 FROM e WHERE series = '3' UNION ALL SELECT DISTINCT series, 'source_digest', 1 FROM e WHERE series = '5') SELECT * FROM p"""


@query
def missing_anchors(spark, d):
    v = vectors(spark, d)
    keys = v.select(F.lit("series").alias("level"), F.col("series").alias("key")).unionByName(v.select(F.lit("document").alias("level"), F.col("document_key").alias("key"))).distinct()
    return X.missing_anchors(v, keys.where("key not like '%3' and key not like '4%'"))


ORACLES["missing_anchors"] = f"WITH {VEC} SELECT DISTINCT 'series' AS level, series AS key FROM v WHERE series LIKE '%3' OR series LIKE '4%' UNION SELECT DISTINCT 'document', document_key FROM v WHERE document_key LIKE '%3' OR document_key LIKE '4%'"


@query
def run_violations(spark, d):
    r = runs(spark, d).where("not (run = 'B' and question_id % 10 = 3) and not (run = 'A' and question_id % 10 = 4)")
    return X.run_violations(r, ["A", "B", "C"], expected=100, exactly=3)


ORACLES["run_violations"] = """WITH a AS (SELECT doc_id AS q FROM labels), n AS (SELECT 'A' AS run, q FROM a WHERE q % 10 <> 4 UNION ALL SELECT 'B', q FROM a WHERE q % 10 <> 3 UNION ALL SELECT 'C', q FROM a),
ms AS (SELECT q FROM a WHERE q % 10 = 3 ORDER BY q LIMIT 5), ex AS (SELECT q FROM a WHERE q % 10 = 4 ORDER BY q LIMIT 5)
SELECT run, 'count' AS problem, CAST(count(DISTINCT q) AS VARCHAR) AS detail FROM n GROUP BY run HAVING count(DISTINCT q) <> 100
UNION ALL SELECT 'B', 'missing', string_agg(CAST(q AS VARCHAR), ',' ORDER BY CAST(q AS VARCHAR)) FROM ms HAVING count(*) > 0
UNION ALL SELECT r, 'extra', string_agg(CAST(q AS VARCHAR), ',' ORDER BY CAST(q AS VARCHAR)) FROM ex, (VALUES ('B'), ('C')) t(r) GROUP BY r"""


@query
def record_violations(spark, d):
    i = F.col("doc_id")
    return X.record_violations(table(spark, d, "documents").select(F.when(i % 7 != 0, F.concat(F.lit("q "), (i - i % 2).cast("string"))).when(i % 14 == 0, " ").alias("question_id"))).select(F.coalesce("question_id", F.lit("none")).alias("question_id"), "problem")


ORACLES["record_violations"] = "WITH r AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN 'q ' || (doc_id - doc_id % 2) WHEN doc_id % 14 = 0 THEN ' ' END AS q FROM documents) SELECT coalesce(q, 'none') AS question_id, CASE WHEN coalesce(trim(q), '') = '' THEN 'no id' ELSE 'repeated' END AS problem FROM r GROUP BY q HAVING coalesce(trim(q), '') = '' OR count(*) > 1"


@query
def heading_index(spark, d):
    c = cited(spark, d)[1].withColumn("place", F.when(F.col("chunk_id") % 3 != 0, F.col("chunk_id") % 5))
    return C.heading_index(c).select("file", "document_id", "heading", "n", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


ORACLES["heading_index"] = f"WITH {CITE} SELECT file, document_id, heading, count(*) AS n, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY CASE WHEN chunk_id % 3 <> 0 THEN chunk_id % 5 ELSE 0 END, chunk_id) AS chunks FROM c GROUP BY ALL"


@query
def summary_by_category(spark, d):
    records = runs(spark, d).where("run = 'A' and question_id % 5 != 0").withColumn("status", F.when(F.col("question_id") % 11 == 0, "failed").otherwise("ok"))
    known = F.when(F.col("question_id") % 4 == 0, T.CATEGORIES[0]).otherwise(F.col("category"))
    return E.summary_by_category(records, dataset(spark, d).withColumn("category", known))


ORACLES["summary_by_category"] = f"""WITH {RUNS}, s AS (SELECT doc_id AS q, CASE WHEN doc_id % 4 = 0 THEN 'Standards specifications' ELSE lang END AS c FROM documents),
j AS (SELECT c, question_id, is_correct, question_id % 11 = 0 AS f FROM s LEFT JOIN (SELECT * FROM runs WHERE run = 'A' AND question_id % 5 <> 0) ON q = question_id),
g AS (SELECT c, count(question_id) AS run_rows, count(*) AS dataset_questions, count(is_correct) AS scored, count(*) FILTER (is_correct) AS correct, count(*) FILTER (question_id IS NOT NULL AND is_correct IS NULL) AS unscored, count(*) FILTER (f AND question_id IS NOT NULL) AS failed FROM j GROUP BY c
  UNION ALL SELECT 'Standards overview', 0, 0, 0, 0, 0, 0)
SELECT c AS category, CAST(row_number() OVER (ORDER BY CASE c WHEN 'Standards specifications' THEN 0 WHEN 'Standards overview' THEN 1 ELSE 2 END, c) AS BIGINT) AS position, run_rows, dataset_questions, scored, correct, unscored, failed,
 CASE WHEN scored > 0 THEN round(100.0 * correct / scored, 2) END AS accuracy, CASE WHEN dataset_questions > 0 THEN round(100.0 * scored / dataset_questions, 2) END AS coverage FROM g"""


@query
def run_totals(spark, d):
    return E.totals(runs(spark, d))


ORACLES["run_totals"] = f"WITH {RUNS} SELECT run, count(*) AS rows, count(is_correct) AS scored, count(*) FILTER (is_correct) AS correct FROM runs GROUP BY run"


@query
def resume_completed(spark, d):
    ordered = dataset(spark, d).select("question_id")
    return E.completed(ordered, runs(spark, d).where("run = 'C' and question_id % 3 = 0"))


ORACLES["resume_completed"] = f"WITH {RUNS} SELECT doc_id AS question_id FROM documents WHERE doc_id IN (SELECT question_id FROM runs WHERE run = 'C' AND question_id % 3 = 0)"


@query
def console_report(spark, d):
    s = seeds(spark, d).withColumnRenamed("pos", "rank").join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text"), "chunk_id")
    hits = s.select("query_id", F.col("rank").alias("pos"), F.col("source").alias("series"), F.when(F.col("rank") > 4, "citation").otherwise("semantic").alias("origin"), (F.col("chunk_id") / 3).alias("score"), F.when(F.col("rank") > 5, F.col("chunk_id") / 7).alias("gain"), F.col("chunk_id").alias("parent_id"), "text")
    return sinks.console_hits(hits)


ORACLES["console_report"] = f"""WITH {VEC}, {SEED} SELECT query_id, rank AS pos, '[' || source || '] origin=' || CASE WHEN rank > 4 THEN 'citation' ELSE 'semantic' END || ' score=' || printf('%.4f', chunk_id / 3.0)
|| CASE WHEN rank > 4 THEN ' citation_gain=' || printf('%.4f', CASE WHEN rank > 5 THEN chunk_id / 7.0 ELSE 0.0 END) || ' parent=' || chunk_id ELSE '' END AS line, text[1:500] AS head FROM sd JOIN documents ON doc_id = chunk_id"""


def corpus(spark, d):
    both = vectors(spark, d).select("chunk_id", "v")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("series"), F.concat_ws("/", "source", "lang").alias("document_key"), F.col("lang").alias("document_id"), F.lit("h").alias("heading"))
    return B.Corpus(texts.join(both, "chunk_id"), C.resolve(*cited(spark, d)), values(spark, TERMS + " as t(term, definition, ord)"), values(spark, SHORT + " as t(word, expansion)"), texts=chunks(spark, d))


def by_id(spark, d):
    """Stands for an embedder: a question's vector is the embeddings row of its id."""
    v = vectors(spark, d).select(F.col("chunk_id").alias("query_id"), "v")
    return lambda asked: asked.join(v, "query_id")


def ran(spark, d):
    return B.benchmark(quiz(spark, d), corpus(spark, d), B.Settings(DIMS, top_k=4), EchoClient(), by_id(spark, d))


@query
def benchmark_run(spark, d):
    records, _ = ran(spark, d)
    return records.select("question_id", "expected_option", "predicted_option", "is_correct", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))


@query
def benchmark_blocks(spark, d):
    return ran(spark, d)[1].select("query_id", "prompt_position", "origin", "chunk_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256"))


DOCV = """v AS (SELECT vec_id AS chunk_id, source AS series, source || '/' || lang AS document_key, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 3 + 1)) AS v, text, lang FROM embeddings JOIN documents ON doc_id = vec_id),
q AS (SELECT item_id AS query_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 3 + 1)) AS q FROM benchmark JOIN embeddings ON vec_id = item_id)"""
UNIT = "list_dot_product(q, {1}) / (sqrt(list_dot_product(q, q)) * greatest(sqrt(list_dot_product({0}, {0})), 1e-12))"
RUN = f"""WITH {DOCV}, {anchor_sql("series")}, {anchor_sql("document_key")},
h AS (SELECT query_id, chunk_id, 0.1 * list_dot_product(q, sa.a) / sqrt(list_dot_product(q, q)) + 0.1 * list_dot_product(q, da.a) / sqrt(list_dot_product(q, q)) + 0.8 * ({UNIT.format('v', 'v')}) AS score FROM q, v JOIN series_a sa USING (series) JOIN document_key_a da USING (document_key)),
dn AS (SELECT query_id, chunk_id, {RANK} FROM h {TOP.format(k=16)}), {bm25_sql(where='WHERE doc_id IN (SELECT chunk_id FROM v)')}, lx AS (SELECT query_id, chunk_id, {RANK} FROM bm WHERE query_id IN (SELECT query_id FROM q) {TOP.format(k=16)}),
sd AS (SELECT query_id, chunk_id, rank FROM ({FUSE.replace('f AS (', 'WITH f AS (', 1)}) WHERE rank <= 4), {CITE},
bf AS (WITH {bfs_sql(PRODUCT)}),
blocks AS (SELECT query_id, rank AS prompt_position, 'semantic' AS origin, chunk_id, -1 AS parent_id, '[series=' || series || '; document=' || lang || '; heading=h; chunk_id=' || chunk_id || ']' || chr(10) || coalesce(text, '') AS block FROM sd JOIN v USING (chunk_id)
 UNION ALL SELECT query_id, 4 + rank, 'citation', chunk_id, parent_id, '[Referenced candidate; series=' || series || '; document=' || lang || '; heading=h; chunk_id=' || chunk_id || '; citation_depth=1; cited_by=' || parent_id || '; path=' || parent_id || ' -> ' || chunk_id || ']' || chr(10) || coalesce(text, '') FROM bf JOIN v USING (chunk_id)),
placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY prompt_position) AS BIGINT) AS prompt_position, origin, chunk_id, CAST(parent_id AS BIGINT) AS parent_id, block FROM blocks)"""
ORACLES["benchmark_blocks"] = f"{RUN} SELECT query_id, prompt_position, origin, chunk_id, parent_id, sha256(block) AS block_sha256 FROM placed"
ORACLES["benchmark_run"] = f"""{RUN}, z AS ({QUIZ}), p AS (SELECT item_id, expected, '{T.STRICT_INSTRUCTION}' || chr(10) || chr(10) || 'Question:' || chr(10) || prompt || chr(10) || chr(10) || 'Retrieved context:' || chr(10) || coalesce(c, '') AS prompt
 FROM z JOIN q ON item_id = query_id LEFT JOIN (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY prompt_position) AS c FROM placed GROUP BY query_id) b ON item_id = b.query_id),
o AS (SELECT *, 'option ' || (length(prompt) % 4 + 1) AS predicted FROM p)
SELECT item_id AS question_id, expected AS expected_option, predicted AS predicted_option, CASE WHEN expected IS NOT NULL THEN predicted = expected END AS is_correct, sha256(prompt) AS prompt_sha256 FROM o"""


@query
def routed_hybrid(spark, d):
    a = R.anchors(vectors(spark, d), "series", DIMS)
    q, v = dense_side(spark, d)
    c = v.join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    asked = q.join(questions(spark, d).select("query_id", F.col("text").alias("question")), "query_id")
    s = B.Settings(DIMS, anchors="router", citations="none", router_k=2)
    return rounded(B.retrieve(asked, B.Corpus(c, descriptions=a), s), score=9)


ORACLES["routed_hybrid"] = f"""WITH {VEC.split(chr(10) + 'q AS')[0].rstrip(',')}, {anchor_sql('series')}, q AS (SELECT item_id AS query_id, v AS q FROM benchmark JOIN v ON chunk_id = item_id),
ro AS (SELECT query_id, series, list_dot_product(q, a) / sqrt(list_dot_product(q, q)) AS score FROM q, series_a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, series) <= 2),
dv AS (SELECT v.* FROM v JOIN documents ON doc_id = chunk_id), h AS (SELECT query_id, chunk_id, list_dot_product(q, v) AS score FROM q JOIN ro USING (query_id) JOIN dv USING (series)),
dn AS (SELECT query_id, chunk_id, {RANK} FROM h {TOP.format(k=32)}), {bm25_sql().replace('FROM documents', 'FROM (SELECT documents.* FROM documents JOIN embeddings ON vec_id = doc_id) documents')},
lx AS (SELECT query_id, chunk_id, {RANK} FROM (SELECT bm.* FROM bm JOIN v USING (chunk_id) JOIN ro USING (query_id, series)) {TOP.format(k=32)}),
{FUSE.replace('SELECT query_id, chunk_id, round(score, 9) AS score, CAST(coalesce(dense_rank, 0) AS BIGINT) AS dense_rank, CAST(coalesce(lexical_rank, 0) AS BIGINT) AS lexical_rank, rank FROM r', 'SELECT query_id, chunk_id, rank AS pos, round(score, 9) AS score FROM r')}"""
