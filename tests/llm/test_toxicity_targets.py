"""A target meets a threat or an insult on either side of it, in the scores too."""

import numpy as np
import pytest

from anvilgrid.llm import toxicity

NAMES = ["abuse", "aimed", "menace", "denied", "quoted"]


def reading(text, stems=()):
    lexicon = toxicity.Lexicon(list(stems))
    return [n for n, x in zip(NAMES, lexicon.readings(text, True), strict=True) if x]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I will kill you.", ["menace"]), ("We will destroy every one of them!", ["menace"]), ("you, they kill.", ["menace"]), ("Ich werde dich töten.", ["menace"]), ("Voy a matar a todos ustedes.", ["menace"]),
        ("I will not kill you.", ["denied"]), ("She wrote that we kill them.", ["quoted"]), ("What an idiot you are.", ["aimed"]), ("kill the red process tree now you", []), ("Kill it. You there", []),
    ],
)
def test_targets_on_both_sides(text, want):
    assert reading(text) == want


def test_threats_count_in_scores(spark):
    d = spark.createDataFrame([(1, "I will kill you."), (2, "The frost will kill tomato plants."), (3, "I will not hurt you.")], "doc_id long, text string")
    model = ([], toxicity.PRIOR)
    assert {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score_toxicity(d, model).collect()} == {1: True, 2: False, 3: False}
    assert [r.doc_id for r in toxicity.drop_toxic(d, model).orderBy("doc_id").collect()] == [2, 3]


def test_labels_can_make_a_threat_word_an_insult():
    assert reading("The frost will kill tomato plants.", ["kill"]) == ["abuse"] and reading("I will kill you.", ["kill"]) == ["menace"]


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("trash collection is on Monday", False), ("The word idiot is in the dictionary.", False), ("You must kill the process", False), ("", False),
        ("You are an idiot.", True), ("I will kill you.", True), ("idiot, moron, scum", True), ("What trash. What scum.", True),
        ("You are not an idiot.", False), ("They said you are an idiot.", False), ("I will never hurt you.", False),
    ],
)
def test_clauses_decide_and_not_isolated_words(text, toxic):
    assert (toxicity.rate(toxicity.Lexicon([]), toxicity.PRIOR, text) >= toxicity.THRESHOLD) == toxic


def test_fitted_weights_keep_their_meaning():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (400, len(toxicity.WEIGHTS))).astype(float)
    y = (x[:, 0] > 0).astype(float)  # labels that an isolated insult decides
    w = toxicity.fit_weights(x, y)
    assert w[0] + w[1 + toxicity.INSULTED] <= -toxicity.MARGIN + 1e-9 and (w[1 + toxicity.WAS_DENIED :] <= 0).all() and (w[1:5] >= 0).all()


def test_query_columns(spark, tmp_path):
    """held_out and predicted are the folds and threshold of the contract, over all rows and whole texts."""
    import zlib

    texts = {i: "you are an idiot" if i % 3 == 0 else "a quiet day" for i in range(60)}
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()] + [(None, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 61 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(r.predicted == int(r.score >= 0.5) == int(r.doc_id is not None and r.doc_id % 3 == 0) for r in rows)
