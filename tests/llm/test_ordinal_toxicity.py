from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents, sentence
from wayfare.llm import ordinal_toxicity as O

BAD = ("vile", "fiend", "rotten")


def corpus(n=300):
    rows, labels = [], []
    vocabulary = tuple(f"{a}{b}" for a in ("al", "be", "co", "du", "en") for b in ("ra", "to", "mi", "lu"))
    for i in range(n):
        text, toxic = sentence(60 + i % 50, i, vocabulary), int(i % 5 == 0)
        if toxic:
            text = " ".join([text, *(BAD[(i + k) % 3] for k in range(1 + (i // 5) % 6))])
        rows.append((i, text, "en", "a"))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_order(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(spark, rows)
    model = O.train(docs, table.where("doc_id < 200"))
    assert model.cuts == sorted(model.cuts) and len(model.cuts) == O.TOP
    got = {r.doc_id: r for r in O.score(docs, model).collect()}
    assert all(got[i].toxic == bool(t) for i, t in labels if i >= 200)
    heavy = [got[i].expected_severity for i, t in labels if t and (i // 5) % 6 == 5]
    light = [got[i].expected_severity for i, t in labels if t and (i // 5) % 6 == 0]
    assert min(heavy) > max(light) > 0.5
    assert all(0 <= r.expected_severity <= O.TOP and 0 <= r.severity <= O.TOP for r in got.values())


def test_same_model_whatever_the_partitions(spark):
    rows, labels = corpus(120)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert O.train(documents(spark, rows, 2), table) == O.train(documents(spark, rows[::-1], 5), table.repartition(4))


def test_sample_is_bounded(spark):
    rows, labels = corpus(120)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = O.sample(documents(spark, rows), table, "doc_id", "text", "toxic", 10)
    assert sum(k == 0 for k, _ in got) == 10 and sum(k == 1 for k, _ in got) == 10


def test_repeated_identifiers_lose_no_row_of_the_sample(spark):
    rows, labels = corpus(60)
    table = spark.createDataFrame(labels + labels, "doc_id long, toxic int")
    copies = [(i, f"{text} copy {k}", *rest) for i, text, *rest in rows for k in range(9)]
    got = O.sample(documents(spark, copies, 2), table, "doc_id", "text", "toxic", 10)
    assert [k for k, _ in got] == [0] * 10 + [1] * 10
    assert got == O.sample(documents(spark, copies[::-1], 5), table, "doc_id", "text", "toxic", 10)


def test_awkward_rows_and_labels(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, 0), (77, 0), (5, None)], "doc_id long, toxic int")
    got = O.score(docs, O.train(docs, labels)).collect()
    assert len(got) == len(AWKWARD) and not any(r.toxic for r in got)
    none = labels.where(F.lit(False))
    assert all(r.expected_severity == 0 for r in O.score(docs, O.train(docs, none)).collect())
    assert O.score(documents(spark, []), O.train(docs, labels)).count() == 0
