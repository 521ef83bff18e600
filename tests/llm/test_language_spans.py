import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import language_spans as L

EN = ("the", "house", "tree", "with", "water", "this", "which", "through", "night", "weather", "thing", "should")
DE = ("der", "haus", "baum", "mit", "wasser", "dieser", "welche", "durch", "nacht", "wetter", "ding", "sollte", "über")
RU = ("дом", "вода", "дерево", "ночь", "погода", "который", "через")


def training():
    return [(i, sentence(80, i, v), lang, "a") for lang, v, first in (("en", EN, 0), ("de", DE, 100), ("ru", RU, 200)) for i in range(first, first + 20)]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(documents(spark, training()))


def test_held_out_accuracy(spark, model):
    rows = [(i, sentence(30, 500 + i, v), lang, "a") for lang, v, first in (("en", EN, 0), ("de", DE, 100), ("ru", RU, 200)) for i in range(first, first + 30)]
    got = {r.doc_id: r for r in L.predict(documents(spark, rows), model).collect()}
    assert all(got[d].lang_pred == lang and got[d].score > 0.9 for d, _, lang, _ in rows)


def test_spans_of_mixed_text(spark, model):
    parts = [(sentence(25, 1, EN), "en"), (sentence(25, 2, DE), "de"), (sentence(9, 3, RU), "ru"), (sentence(25, 4, EN), "en")]
    text = "; ".join(t for t, _ in parts)
    got = L.spans(documents(spark, [(1, text, None, None), (2, "1234 ..", None, None)]), model).orderBy("start").collect()
    assert [r.lang for r in got] == [x for _, x in parts]
    assert [text[r.start : r.stop] for r in got] == [t for t, _ in parts]


def plain_viterbi(scores, begins, switch):
    """Best total for each text and language sequence, by plain dynamic programming."""
    best, out = None, []
    for s, new in zip(scores, begins, strict=True):
        best = [0] * len(s) if best is None or new else [max(v, max(best) - switch) for v in best]
        best = [v + x for v, x in zip(best, s, strict=True)]
        out.append(best)
    return np.array(out)


def test_blocked_viterbi_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 65, 700):
        scores, begins = rng.integers(-500, 500, (n, 3)), rng.random(n) < 0.02
        begins[0] = True
        for block in (1, 7, 64):
            assert (L.forward(scores, begins, 640, block) == plain_viterbi(scores, begins, 640)).all()


def test_labels_are_one_best_sequence():
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 63, 64, 65, 128, 129, 400]:
        for unit in (1, 64):  # whole numbers in few steps: many ties
            scores, begins = rng.integers(-4, 5, (n, 3)) * unit, rng.random(n) < 0.05
            begins[0] = True
            sums = L.forward(scores, begins, 2 * unit)
            last = np.append(begins[1:], True)
            for block in (1, 7, 64):
                got = L.traced(sums, begins, 2 * unit, block)
                moved = (got[1:] != got[:-1]) & ~begins[1:]
                assert scores[np.arange(n), got].sum() - 2 * unit * moved.sum() == sums[last].max(1).sum()


def test_awkward_texts(spark, model):
    rows = [*AWKWARD, (20, "́́", "en", "a"), (21, "\U00020000\U00020001", None, None), (22, "1 2 3 !!", "en", "a")]
    got = L.predict(documents(spark, rows), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc in (1, 2, 9, 20, 22):
        assert (by[doc].lang_pred, by[doc].score, by[doc].n_spans) == ("und", 0.0, 0)
    assert by[21].lang_pred in model.langs and all(0 <= r.score <= 1 for r in got)
    assert L.predict(documents(spark, []), model).count() == 0


def test_no_training_rows(spark):
    empty = L.train(documents(spark, [(1, "text", None, None), (2, None, "en", None)]))
    assert plain(L.predict(documents(spark, [(1, "text", "en", "a")]), empty)) == [(1, "und", 0.0, 0)]


def test_model_does_not_depend_on_partitions(spark, model):
    again = L.train(documents(spark, training()[::-1], 7))
    assert again.langs == model.langs and (again.scores == model.scores).all() and (again.candidate == model.candidate).all()


def test_held_out_share(spark):
    got = spark.range(1000).select(L.held_out(F.col("id")).alias("h")).where("h").count()
    assert 200 < got < 300
