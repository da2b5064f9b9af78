"""Validation as data: each check returns the rows that break a rule, and ``demand`` raises if there are any.

Nothing is collected but the first violations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anvilgrid.functions import vectors as V


def demand(violations: DataFrame, shown: int = 5) -> None:
    """Raises with the first violations in order."""
    rows = violations.orderBy(*violations.columns).limit(shown).collect()
    if rows:
        raise ValueError("; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows))


def positioned(vectors: DataFrame, metadata: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Vector rows (series, embedding_row, ...) with the metadata of their place; raises where either side has a row more."""
    both = vectors.withColumn("_v", F.lit(True)).join(metadata.withColumn("_m", F.lit(True)), [*keys, "embedding_row"], "full")
    odd = F.raise_error(F.concat(F.lit("vectors and metadata differ in length: "), F.col(keys[0]).cast("string"))).cast("boolean")
    return both.where(F.when(F.col("_v").isNull() | F.col("_m").isNull(), odd).otherwise(True)).drop("_v", "_m")


def with_source(metadata: DataFrame, chunks: DataFrame) -> DataFrame:
    """metadata (file, source_chunk_index, chunk_id, ...) with the ``source`` struct of its chunk: that of its place where the
    index is one of the file, else the first with its id. Raises where none is, or its id differs."""
    body = F.struct(*[c for c in chunks.columns if c != "file"])
    place = chunks.select(F.col("file").alias("_file"), F.col("source_chunk_index").alias("_at"), body.alias("_by_place"))
    first = chunks.groupBy(F.col("file").alias("_file"), F.col("chunk_id").alias("_id")).agg(F.min_by(body, "source_chunk_index").alias("_by_id"))
    found = metadata.join(place, (F.col("file") == F.col("_file")) & (F.col("source_chunk_index") == F.col("_at")), "left").drop("_file", "_at")
    lost = found.where("_by_place is null").drop("_by_place").join(first, (F.col("file") == F.col("_file")) & (F.col("chunk_id") == F.col("_id")), "left").drop("_file", "_id").withColumnRenamed("_by_id", "source")
    every = found.where("_by_place is not null").withColumnRenamed("_by_place", "source").unionByName(lost)
    kind = every.schema["source"].dataType
    fail = lambda m: F.raise_error(F.concat(F.lit(m), F.coalesce(F.col("chunk_id").cast("string"), F.lit("null")))).cast(kind)
    other = F.col("chunk_id").isNotNull() & (F.col("source.chunk_id") != F.col("chunk_id"))
    return every.withColumn("source", F.when(F.col("source").isNull(), fail("no source chunk of ")).when(other, fail("another source chunk than ")).otherwise(F.col("source")))


def lexical_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Lexical hits (query_id, series, metadata_index, score) with the metadata row of that place in their series."""
    at = metadata.withColumnRenamed("series", "_series").withColumnRenamed("embedding_row", "_row")
    return hits.join(at, (F.col("series") == F.col("_series")) & (F.col("metadata_index") == F.col("_row")), "left").drop("_series", "_row")


def corpus_violations(manifest: DataFrame, vectors: DataFrame, metadata: DataFrame, chunks: DataFrame, dims: int) -> DataFrame:
    """series, problem, n. manifest: series, chunk_count, source_sha256, metadata_sha256 (null: not asked); vectors: series,
    embedding_row, v; metadata: series, embedding_row, source_chunk_index, chunk_id, metadata_sha256 of its file; chunks:
    series, source_chunk_index, chunk_id, body (canonical JSON)."""
    count = lambda df, name: df.groupBy("series").agg(F.count(F.lit(1)).alias(name))
    sizes = manifest.join(count(vectors, "vectors"), "series", "left").join(count(metadata, "rows"), "series", "left").fillna(0, ["vectors", "rows"])
    rules: list[DataFrame] = []

    def rule(df: DataFrame, broken: Column, problem: str) -> None:
        rules.append(df.where(broken).groupBy("series").agg(F.count(F.lit(1)).alias("n")).select("series", F.lit(problem).alias("problem"), "n"))

    rule(sizes, (F.col("vectors") != F.col("chunk_count")) | (F.col("rows") != F.col("vectors")), "row_count")
    rule(vectors, F.col("v").isNull() | (F.size("v") != dims), "dimensions")
    rule(vectors, ~F.coalesce(V.finite(F.col("v")), F.lit(True)), "not_finite")
    at = metadata.select("series", "embedding_row", "source_chunk_index", F.col("chunk_id").alias("named"))
    joined = at.join(chunks.select("series", "source_chunk_index", "chunk_id", "body"), ["series", "source_chunk_index"], "left")
    rule(joined, F.col("chunk_id").isNull(), "chunk_index")
    rule(joined, F.col("chunk_id").isNotNull() & ~F.col("named").eqNullSafe(F.col("chunk_id")), "chunk_identity")
    digest = selected_digest(joined.where("body is not null"), "series", "embedding_row", "body")
    rule(manifest.join(digest, "series"), F.col("source_sha256") != F.col("digest"), "source_digest")
    listed = metadata.groupBy("series").agg(F.max("metadata_sha256").alias("found")).join(manifest, "series") if "metadata_sha256" in metadata.columns else None
    if listed is not None:
        rule(listed, F.col("metadata_sha256") != F.col("found"), "metadata_digest")
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def selected_digest(rows: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """key, digest: SHA-256 of the JSON list of the bodies of each key in order. A key's bodies become one text, as the digest
    of a list asks; beyond an executor's memory the bodies' own digests are to be compared instead (body_digests)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda s: s[body])
    return rows.groupBy(key).agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).cast("binary"), 256).alias("digest"))


def body_digests(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, n, checksum: an order-free sum of the bodies' 64-bit digests, combined before the shuffle."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(body).cast("decimal(38,0)")).alias("checksum"))


def canonical_json(columns: list[str]) -> Column:
    """The columns as a JSON object without blanks, fields in order of their names."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def anchor_violations(given: dict, expected: dict) -> list[str]:
    """Settings in which an anchor manifest differs from what is expected."""
    return sorted(f"{k}: {given.get(k)!r} is not {v!r}" for k, v in expected.items() if given.get(k) != v)


def missing_anchors(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """level, key of every series and document of chunks without an anchor (level, key)."""
    keys = chunks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).cast("string").alias("key")) for n, c in (("series", "series"), ("document", "document_key"))])).alias("k")).select("k.*").distinct()
    return keys.join(anchors.select("level", "key"), ["level", "key"], "left_anti")


def anchor_shape_violations(anchors: DataFrame, dims: int) -> DataFrame:
    """level, key, problem of anchors (level, key, anchor) that repeat, have other dimensions or no length."""
    each = anchors.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("anchor") != dims).alias("odd"), F.min(V.norm(F.col("anchor"))).alias("norm"))
    why = F.when(F.col("n") > 1, "repeated").when(F.col("odd"), "dimensions").when(F.col("norm") <= 1e-12, "zero")
    return each.select("level", "key", why.alias("problem")).where("problem is not null")


def missing_files(files: DataFrame, wanted: list[str]) -> DataFrame:
    """path of the wanted runtime files that a listing (path) has not."""
    return files.sparkSession.createDataFrame([(w,) for w in wanted], "path string").join(files.select("path"), "path", "left_anti")


def run_violations(runs: DataFrame, labels: list[str], expected: int | None = None, exactly: int | None = None, at_least: int = 2) -> DataFrame:
    """run, problem, detail of runs (run, question_id) that cannot be compared: the coverage of each is held against the first's.

    The labels are checked at once: too few, too many or repeated ones raise.
    """
    if (exactly is not None and len(labels) != exactly) or len(labels) < at_least or len(set(labels)) != len(labels):
        raise ValueError(f"{exactly or f'at least {at_least}'} runs with different labels are wanted")
    if expected is not None and expected < 1:
        raise ValueError("the expected count must be positive")
    ids = runs.select("run", "question_id").distinct()
    sizes = runs.sparkSession.createDataFrame([(x,) for x in labels], "run string").join(ids.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run", "left").fillna(0, ["n"])
    out = sizes.where(F.col("n") != expected).select("run", F.lit("count").alias("problem"), F.col("n").cast("string").alias("detail")) if expected is not None else sizes.limit(0).select("run", F.lit("").alias("problem"), F.lit("").alias("detail"))
    first = ids.where(F.col("run") == labels[0]).select("question_id")
    for label in labels[1:]:
        own = ids.where(F.col("run") == label).select("question_id")
        for problem, extra in (("missing", first.join(own, "question_id", "left_anti")), ("extra", own.join(first, "question_id", "left_anti"))):
            five = extra.orderBy("question_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list(F.col("question_id").cast("string"))), ",").alias("detail")).where("detail != ''")
            out = out.unionByName(five.select(F.lit(label).alias("run"), F.lit(problem).alias("problem"), "detail"))
    return out


def record_violations(records: DataFrame) -> DataFrame:
    """question_id, problem of checkpoint records without an id or with one that another line has."""
    blank = F.coalesce(F.trim("question_id"), F.lit("")) == ""
    none = records.where(blank).groupBy("question_id").agg(F.lit("no id").alias("problem"))
    twice = records.where(~blank).groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("question_id", F.lit("repeated").alias("problem"))
    return none.unionByName(twice)
