"""The registered queries against their SQL twins, and the pipeline against brute force."""

import hashlib
from array import array

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_chosen_path, test_divergence, test_mixing
from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import bpe
from wayfare.llm.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "labels")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("number", range(1, 13))
def test_every_operator_has_one_query_over_all_rows(spark, number):
    names = [n for n in QUERIES if n.startswith(f"op{number}_")]
    assert len(names) == 1
    got = QUERIES[names[0]](spark, SF)
    turns = number in (1, 12)
    table = spark.read.parquet(f"{SF}/{'conversations' if turns else 'documents'}.parquet")
    key = "conv_id" if turns else "doc_id"
    assert plain(got.select(key)) == plain(table.select(key).distinct() if turns else table.select(key))


def test_language_accuracy_on_held_out_documents(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    hits = QUERIES["op4_language_spans"](spark, SF).where("held_out").join(lang, "doc_id")
    assert hits.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.9


def test_pipeline_against_brute_force(spark, tmp_path):
    big = tuple(f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fo", "gi") for b in ("ra", "to", "mi", "lu", "ne", "so", "pa"))
    rows = [*AWKWARD, (None, sentence(100, 77, big), "en", "s1"), (None, sentence(100, 77, big), "en", "s1"), (5, sentence(100, 78, big), "en", "s1")]
    rows += [(100 + i, sentence(80 + 3 * i, i, big), "en", f"s{i % 3}") for i in range(40)]
    rows += [(200 + i, sentence(80 + 3 * i, i, big), "en", "s1") for i in range(0, 40, 5)]  # equal texts
    rows += [(300 + i, sentence(80 + 3 * i, i, big) + " tail", "en", "s2") for i in range(0, 40, 4)]  # near copies
    rows += [(400, sentence(150, 3, big).upper().replace(" ", "!! "), "en", "s0")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = plain(corpus_pipeline.run(spark, str(tmp_path)))

    # by place in the list, since identifiers are null or repeat
    kept = {t[0] for t in test_divergence.brute([(k, *r[1:]) for k, r in enumerate(rows)]) if t[-1]}
    left = [r for k, r in enumerate(rows) if k in kept]
    largest = {}
    for r in left:
        largest[r[1]] = max(largest.get(r[1], -1), -1 if r[0] is None else r[0])
    left = [r for r in left if largest[r[1]] == (-1 if r[0] is None else r[0])]
    assert [r[0] for r in left].count(5) == 3 and [r[0] for r in left].count(None) == 2
    classes = {t[0]: t[1] for t in test_chosen_path.brute([(k, *r[1:]) for k, r in enumerate(left)])}
    first = {}
    for k, r in enumerate(left):
        best = first.setdefault(classes[k], r)
        first[classes[k]] = min(best, r, key=lambda r: (r[0] is None, r[0] or 0))
    left = list(first.values())
    taken = {(t[0], t[1]): t[4] // t[1] if t[1] else 0 for t in test_mixing.brute(left)}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text, *_ in left:
        ids = library.encode_ordinary(text)
        want += [(doc, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * taken[doc, len(text.split())]
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert 20 < len(got) < 2 * len(left)


def test_stages_keep_the_columns_of_documents(spark):
    docs = documents(spark, [(i, sentence(70, i), "en", "a") for i in range(20)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
