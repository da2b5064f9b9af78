"""Sources and sinks: manifests, matrices, chunk files, question sets, checkpoints, vocabulary, bundles."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anvilgrid.functions import text as T
from anvilgrid.operators.vocabulary import acronym_candidates
from anvilgrid.session import ship

SERIES = "map<string,struct<vector_file:string,metadata_file:string,chunk_file:string,chunk_count:long,metadata_sha256:string,source_sha256:string>>"
REFERENCE = "struct<type:string,document_id:string,target_heading:string,target_chunk_file:string,target_series:string>"
CHUNK = f"struct<chunk_id:string,text:string,series:string,document_id:string,heading:string,chunk_index_in_heading:int,source_chunk_index:long,references:array<{REFERENCE}>>"
RECORD = "question_id string, expected_option string, predicted_option string, is_correct boolean, answer string, status string, correct boolean"
ALLOWED = r"^[A-Za-z0-9_][A-Za-z0-9_./-]*$"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """series, ord, its files and count, and the offset of its first row, in the manifest's order."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"series {SERIES}, dimensions int").alias("m"))
    each = raw.select(F.posexplode(F.map_entries("m.series")).alias("ord", "e"), "m.dimensions").select("ord", F.col("e.key").alias("series"), "e.value.*", "dimensions")
    return each.withColumn("offset", F.sum("chunk_count").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["offset"])


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, embedding_row, embedding of .npy matrices."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for i in range(0, len(m), 4096):
                    part = m[i : i + 4096].astype(np.float32)
                    yield pd.DataFrame({"file": p.rsplit("/", 1)[-1], "embedding_row": np.arange(i, i + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, embedding_row long, embedding array<float>")


def anchor_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """level (series or document), key, anchor of an .npz file; raises for keys that repeat, wrong shapes and zero vectors."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for level in ("series", "document"):
                        keys, v = z[f"{level}_keys"].astype(str), z[f"{level}_vectors"].astype(np.float64)
                        if v.shape != (len(keys), dims) or len(set(keys.tolist())) != len(keys):
                            raise ValueError(f"{level} anchors have keys that repeat or another shape")
                        norm = np.sqrt((v * v).sum(1, keepdims=True))
                        if (norm <= 1e-12).any():
                            raise ValueError(f"{level} anchors have a vector without length")
                        for i in range(0, len(v), 4096):
                            yield pd.DataFrame({"level": level, "key": keys[i : i + 4096], "anchor": list((v / norm)[i : i + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "level string, key string, anchor array<double>")


def router_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """ord, series (the label's first word), description, anchor of a JSON object of labels, in its order."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<description:string,embeddings:array<double>>>").alias("m"))
    each = raw.select(F.posexplode(F.map_entries("m")).alias("ord", "e"))
    return each.select("ord", F.split(F.trim("e.key"), r"\s+")[0].alias("series"), F.col("e.value.description").alias("description"), F.col("e.value.embeddings").alias("anchor"))


def router_checkpoint(path: str) -> dict[str, np.ndarray]:
    """The weights of a routing network from an .npz file, by name (driver side: a network is small)."""
    with np.load(path, allow_pickle=False) as z:
        return {k: z[k].astype(np.float64) for k in z.files}


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """file and chunk columns of JSON files that are a list of chunks or an object with one; a missing index is the place."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.trim("value").alias("value"))
    chunks = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{CHUNK}>")).otherwise(F.from_json("value", f"chunks array<{CHUNK}>")["chunks"])
    checked = F.when(chunks.isNull(), F.raise_error(F.lit("a chunk file holds no list")).cast(f"array<{CHUNK}>")).otherwise(chunks)
    each = raw.select("file", F.posexplode(checked).alias("pos", "c")).select("file", "pos", "c.*")
    return each.withColumn("source_chunk_index", F.coalesce("source_chunk_index", F.col("pos").cast("long"))).drop("pos")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, options (array by number), answer, category of a JSON object keyed by id."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("question_id", "body"))
    m = raw.select("question_id", F.from_json("body", "map<string,string>").alias("m")).where("m is not null")
    options = F.filter(F.map_entries("m"), lambda e: e["key"].rlike(T.OPTION_KEY))
    numbered = F.transform(options, lambda e: F.struct(F.regexp_extract(e["key"], T.OPTION_KEY, 1).cast("int").alias("n"), e["value"].alias("text")))
    return m.select("question_id", F.col("m")["question"].alias("question"), F.array_sort(numbered).alias("options"), F.col("m")["answer"].alias("answer"), F.col("m")["category"].alias("category"))


def invalid_questions(questions: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = F.when(blank(F.col("question")), "no question").when(F.size("options") < 2, "fewer than two options").when(F.exists("options", lambda o: blank(o["text"])), "a blank option")
    return questions.select("question_id", why.alias("why")).where("why is not null")


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """line, record of a checkpoint in any shape: lines of objects, a list, an object of records, or ids to objects."""
    fields = [f.split(" ")[0] for f in RECORD.split(", ")]
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    head = whole.select(F.substring("value", 1, 1).alias("c"), F.try_parse_json("value").isNotNull().alias("one"), F.coalesce(F.get_json_object("value", "$.records"), F.get_json_object("value", "$.results"), F.get_json_object("value", "$.rows")).alias("list"), F.get_json_object("value", "$.question_id").isNotNull().alias("single")).first()
    if head is None:
        raise ValueError("an empty checkpoint")
    if head.one and (head.c == "[" or head.list):
        of = F.col("value") if head.c == "[" else F.coalesce(F.get_json_object("value", "$.records"), F.get_json_object("value", "$.results"), F.get_json_object("value", "$.rows"))
        return whole.select(F.posexplode(F.from_json(of, f"array<struct<{RECORD.replace(' ', ':', 99).replace(',:', ',')}>>")).alias("line", "r")).select(F.col("line").cast("long"), *[F.col(f"r.{c}") for c in fields])
    if head.one and not head.single:
        each = whole.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("line", "e"))
        parsed = each.select(F.col("line").cast("long"), F.col("e.key").alias("key"), F.from_json("e.value", RECORD).alias("r"))
        return parsed.select("line", F.coalesce("r.question_id", "key").alias("question_id"), *[F.col(f"r.{c}") for c in fields[1:]])
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("line", "v")).where("trim(v) != ''")
    bad = F.when(~F.trim("v").startswith("{"), F.raise_error(F.lit("a line holds no object")).cast("string")).otherwise(F.col("v"))
    return lines.select(F.col("line").cast("long"), F.from_json(bad, RECORD).alias("r")).select("line", *[F.col(f"r.{c}") for c in fields])


def append_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def vocabulary_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """pos, kind, key, value of numbered paragraphs (pos, text) of a vocabulary document; the last of equal keys holds.

    Entries begin after the second paragraph with 'References'. A paragraph with 'Terms and definitions' opens the terms
    (a colon parts them, dots at the end go), one with 'Abbreviations' the abbreviations (a tab parts them, one letter is none).
    """
    whole = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one document's paragraphs
    text = F.trim("text")
    opens = F.when(text.contains("Terms and definitions"), "term").when(text.contains("Abbreviations"), "abbreviation")
    seen = paragraphs.select("pos", F.regexp_replace(F.col("text"), r"^\s+|\s+$", "").alias("text"))
    seen = seen.withColumn("sections", F.sum(F.col("text").contains("References").cast("int")).over(whole)).where("sections >= 2")
    seen = seen.withColumn("opens", opens).withColumn("kind", F.last("opens", ignorenulls=True).over(whole)).where("opens is null and kind is not null")
    parts = F.when(F.col("kind") == "term", F.split("text", ":", 2)).otherwise(F.split("text", "\t", 2))
    each = seen.select("pos", "kind", parts.alias("p")).where("size(p) = 2")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    each = each.select("pos", "kind", strip(F.col("p")[0]).alias("key"), strip(F.col("p")[1]).alias("value"))
    each = each.where("kind = 'term' or length(key) > 1").withColumn("value", F.when(F.col("kind") == "term", F.regexp_replace("value", r"\.+$", "")).otherwise(F.col("value")))
    last = each.groupBy("kind", "key").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"))
    return last.select("pos", "kind", "key", "value")


def vocabulary_json(spark: SparkSession, definitions: str, abbreviations: str) -> DataFrame:
    """kind, key, value, ord of a terms file and an acronyms file; an acronym counts with exactly one expansion.

    Raises where the terms or acronyms are missing or a term is not a pair of texts.
    """
    fail = lambda m, kind: F.raise_error(F.lit(m)).cast(kind)
    body = "struct<term:string,definition:string>"
    raw = spark.read.text(definitions, wholetext=True)
    listed = F.from_json("value", f"terms array<{body}>")["terms"]
    terms = raw.select(F.posexplode(F.coalesce(listed, fail("a terms list is missing", f"array<{body}>"))).alias("ord", "t"))
    bad = F.col("t").isNull() | F.col("t.term").isNull() | F.col("t.definition").isNull()
    terms = terms.select(F.when(bad, fail("an invalid term", "string")).otherwise(F.col("t.term")).alias("key"), F.col("t.definition").alias("value"), F.col("ord").cast("long"))
    terms = terms.groupBy("key").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    known = acronym_candidates(acronym_sources(spark, abbreviations)).where("usable")
    return terms.select(F.lit("term").alias("kind"), "key", "value", "ord").unionByName(known.select(F.lit("abbreviation").alias("kind"), F.col("acronym").alias("key"), F.col("expansion").alias("value"), F.lit(0).cast("long").alias("ord")))


def acronym_sources(spark: SparkSession, path: str) -> DataFrame:
    """acronym, expansion, source, series, document, ord: a row for each source of each candidate of an acronyms file."""
    source = "struct<series:string,source_document_key:string>"
    candidate = f"array<struct<expansion:string,sources:array<{source}>>>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"acronyms map<string,{candidate}>")["acronyms"]
    checked = F.coalesce(listed, F.raise_error(F.lit("an acronyms object is missing")).cast(f"map<string,{candidate}>"))
    each = raw.select(F.explode(checked).alias("acronym", "c")).select("acronym", F.posexplode("c").alias("ord", "c")).where("trim(c.expansion) != ''")
    each = each.select("acronym", F.trim("c.expansion").alias("expansion"), F.col("ord").cast("long"), F.posexplode("c.sources").alias("source", "s"))
    return each.select("acronym", "expansion", "source", F.col("s.series").alias("series"), T.document_id(F.col("s.source_document_key")).alias("document"), "ord")


def docx_paragraphs(content: bytes) -> list[str]:
    """Texts of the paragraphs of a DOCX file."""
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return ["".join("\t" if e.tag == f"{w}tab" else e.text or "" for e in p.iter() if e.tag in (f"{w}t", f"{w}tab")) for p in root.iter(f"{w}p")]


#: Runtime files of a bundle: folders by their suffixes; parts of a path that are never taken.
ASSET_SUFFIXES = {"chunks": (".json",), "embeddings": (".json", ".jsonl", ".npy", ".npz", ".sqlite3"), "resources": (".json", ".docx", ".pth")}
SKIPPED = (".cache", ".partial", "__pycache__")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of files below a folder; links are not followed, as the listing of a store has none."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def links(folder: str) -> list[str]:
    """Symbolic links below a local folder, sorted: a bundle must have none."""
    return sorted(str(p) for p in Path(folder).rglob("*") if p.is_symlink())


def is_runtime_asset(path: Column, suffixes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """A relative path without way out or cache folder, in a known folder with one of its suffixes."""
    known = F.lit(False)
    for folder, ends in (suffixes or ASSET_SUFFIXES).items():
        known = known | (path.startswith(f"{folder}/") & path.rlike("(" + "|".join(re.escape(x) for x in ends) + ")$"))
    return known & safe(path) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of a bundle's manifest; raises unless its format_version is 1 and its paths are there, each once."""
    body = "array<struct<path:string,size:long,sha256:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"format_version int, files {body}").alias("m"))
    paths = F.col("m.files.path")
    wrong = F.when(~F.col("m.format_version").eqNullSafe(F.lit(1)), "an unknown format of the manifest").when(F.coalesce(F.size("m.files"), F.lit(0)) < 1, "a manifest without files").when(F.size(F.array_distinct(paths)) < F.size(paths), "a path that is listed twice")
    return raw.select(F.explode(F.when(wrong.isNull(), F.col("m.files")).otherwise(F.raise_error(wrong).cast(body))).alias("f")).select("f.*")


def verify(there: DataFrame, listed: DataFrame) -> DataFrame:
    """path, problem of listed files (path, size, sha256) that are missing or differ, and of paths not allowed."""
    found = there.withColumnRenamed("size", "size2").withColumnRenamed("sha256", "sha2")
    why = F.when(~F.col("path").rlike(ALLOWED) | F.col("path").contains(".."), "not allowed").when(F.col("size2").isNull(), "missing").when(F.col("size") != F.col("size2"), "size").when(F.col("sha256") != F.col("sha2"), "sha256")
    return listed.join(found, "path", "left").select("path", why.alias("problem")).where("problem is not null")


def flat_config(config: dict, prefix: str = "") -> dict[str, str]:
    """Nested settings as scalars: null as text, lists as sorted JSON."""
    out: dict[str, str] = {}
    for k, v in config.items():
        if isinstance(v, dict):
            out |= flat_config(v, f"{prefix}{k}.")
        else:
            out[prefix + k] = "null" if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True)
    return out


def settings(path: str) -> dict:
    import tomllib

    with open(path, "rb") as f:
        return tomllib.load(f)


def setting(config: dict, section: str, key: str):
    try:
        return config[section][key]
    except KeyError as e:
        raise KeyError(f"no setting {section}.{key}") from e


def labelled_path(text: str) -> tuple[str, str]:
    label, sep, path = text.partition("=")
    if not sep or not label.strip() or not path.strip():
        raise ValueError("LABEL=PATH is wanted")
    return label.strip(), path.strip()


def safe(path: Column) -> Column:
    return path.rlike(ALLOWED) & ~path.contains("..")


def repository_path(path: str, root: str, prefix: str) -> Path:
    """A path below root; a leading prefix (the root folder's own name) that was given by accident is dropped."""
    p = Path(path)
    return p if p.is_absolute() else (Path(root) / Path(*p.parts[p.parts[:1] == (prefix,) :])).resolve()
