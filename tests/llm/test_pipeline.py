"""The corpus pipeline, stage by stage, against brute force on what each stage was given."""

import random
import re

import pandas as pd
import pytest

import corpus_pipeline
from anvilgrid.llm import bpe, pii

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(500)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


TEXTS = {i: prose(40) + (" you are an idiot." if i % 3 == 0 else ".") for i in range(300)}
PASSAGE = prose(30)
TEXTS |= {
    301: TEXTS[1], 302: TEXTS[1].rsplit(" ", 1)[0] + " other", 304: PASSAGE + " " + prose(20), 305: prose(300) + " " + " ".join(PASSAGE.split()[:13]) + " " + prose(300),
    307: prose(30) + " write to a.b@mail.example.com or 10.0.0.1 please", 308: None, 310: "", 311: "x", 313: "X",
}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows given, rows returned, columns returned) of each stage."""
    d = str(tmp_path_factory.mktemp("sf"))
    ids = list(TEXTS)
    pd.DataFrame({"doc_id": ids, "text": list(TEXTS.values()), "lang": "en", "source": "s", "n_chars": [len(t or "") for t in TEXTS.values()]}).to_parquet(f"{d}/documents.parquet")
    pd.DataFrame({"doc_id": range(300), "quality": 1, "toxic": [int(i % 3 == 0) for i in range(300)]}).to_parquet(f"{d}/labels.parquet")
    pd.DataFrame({"item_id": [1, 2], "text": [PASSAGE, None]}).to_parquet(f"{d}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, d)
        got.write.parquet(f"{d}/out{k}")
        given, docs = docs, spark.read.parquet(f"{d}/out{k}")
        out[name] = ({r.doc_id: r.text for r in given.collect()}, {r.doc_id: r for r in docs.collect()}, given.columns, docs.columns)
        assert docs.count() == len(out[name][1])
    out["run"] = {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, d).collect()}
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "pii", "bpe"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][2] == stages[name][3]


def test_toxic_documents_go(stages):
    assert set(stages["toxicity"][1]) == {i for i in TEXTS if i >= 300 or i % 3}


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_stays(stages):
    given, kept, *_ = stages["jaccard"]
    sets = {i: shingles(t) for i, t in given.items()}
    gone = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert gone == {301, 302, 313} and set(kept) == set(given) - gone


def test_benchmark_passages_go(stages):
    given, kept, *_ = stages["decontamination"]
    assert set(given) - set(kept) == {304}
    assert {i for i in kept if kept[i].text != given[i]} == {305}
    assert " ".join(PASSAGE.split()[:13]) not in kept[305].text and len(kept[305].text.split()) == 600


def test_personal_data_is_masked(stages):
    given, kept, *_ = stages["pii"]
    assert set(given) == set(kept)
    for i, t in given.items():
        assert (kept[i].text is None) == (t is None)
        assert not pii.base_spans(kept[i].text or "") and re.search(r"\d|@", t or "") or kept[i].text == t
    assert "[EMAIL]" in kept[307].text and "[IP]" in kept[307].text and kept[307].n_chars == len(kept[307].text)


def test_ids_are_those_of_the_library(stages):
    from tokenizers import Tokenizer

    given, kept, *_ = stages["bpe"]
    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = {i: tuple(t.encode(x or "", add_special_tokens=False).ids) for i, x in given.items()}
    assert {i: tuple(r.ids) for i, r in kept.items()} == want == stages["run"]
