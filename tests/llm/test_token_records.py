import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import token_records as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = T.Encoder(PATH, 2, memo=500)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def ids(packed):
    return np.frombuffer(packed, "<u2").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab Z.,'s\n\t 1é\x1c", max_size=60))
def test_same_ids_as_the_library(text):
    assert ids(ENCODER.encode(text)) == library(text)


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)
    for text in (sentence(3000, 1), "x" * 400, " " * 200 + "b", "<|endoftext|> é" * 30, sentence(40, 2, ("a  b", "\n c", "é", "1 2"))):
        assert ids(ENCODER.encode(text)) == library(text)


def test_frames_notice_damage(tmp_path):
    fs, base = T.opened(str(tmp_path))
    w = T.Writer(fs, base, "x")
    for k in range(5):
        w.add(T.payload(None if k == 2 else k, np.arange(k, dtype="<u2").tobytes(), 2), k)
    w.close()
    assert [(d, v.tolist()) for d, v in T.records(fs, f"{base}/x")] == [(None if k == 2 else k, list(range(k))) for k in range(5)]
    whole = (tmp_path / "x.rec").read_bytes()
    for at in range(len(whole)):
        (tmp_path / "x.rec").write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(T.Broken):
            list(T.records(fs, f"{base}/x"))
    for cut in (whole[:-1], whole + b"\0"):
        (tmp_path / "x.rec").write_bytes(cut)
        with pytest.raises(T.Broken):
            list(T.records(fs, f"{base}/x"))


def brute(rows):
    """Of documents whose identifiers differ, in order, nulls first."""
    out, start = [], 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        got = library(text)
        out.append((doc, start, len(got), zlib.crc32(np.array(got, "<u4"))))
        start += len(got)
    return out


def test_written_and_read_back(spark, tmp_path):
    rows = [r for r in AWKWARD if r[0] not in (None, 5)] + [(None, "no id", "en", "c")] + [(100 + i, sentence(i, i), "en", "a") for i in range(200)]
    files = T.write(documents(spark, rows), PATH, str(tmp_path / "out"), end_id=2, file_bytes=2000)
    assert files.count() > 20
    assert sorted(map(tuple, T.read_digests(files).collect()), key=lambda r: r[1]) == brute(rows)
    names = {r["name"] for r in files.collect()}
    assert {p.stem for p in Path(tmp_path / "out").iterdir()} == names
    want = sorted(([r[0], library(r[1])] for r in rows), key=str)
    assert sorted(([r[0], r[1]] for r in T.read(files).collect()), key=str) == want

    order = T.shuffled(files, 7).collect()
    again, other = T.shuffled(files, 7).collect(), T.shuffled(files, 8).collect()
    assert order == again and order != other and sorted(order) == sorted(other)
    got = [[r[0], r[1]] for r in T.fetch(T.shuffled(files, 7), keep_open=2).collect()]
    assert sorted(got, key=str) == want and got != sorted(got, key=str)
    some = spark.createDataFrame([(order[0]["folder"], order[0]["name"], 10_000)], "folder string, name string, record long")
    with pytest.raises(PythonException, match="there is no record"):
        T.fetch(some).collect()


def test_repeated_rows_have_places_of_their_own(spark):
    rows = [(5, "b c", "en", "a")] * 40 + [(5, "other text", "en", "a")] * 3 + [(None, None, None, None)] * 50
    got = plain(T.encode_and_read(documents(spark, rows), PATH, 2), "doc_id", "start", "n_tokens")
    assert sorted(r[1] for r in got if r[0] is None) == list(range(50))
    assert sorted(r[1] for r in got) == sorted(np.cumsum([0, *(r[2] for r in sorted(got, key=lambda r: r[1]))])[:-1].tolist())
    assert len(got) == 93


def test_empty_table(spark):
    assert T.encode_and_read(documents(spark, AWKWARD).limit(0), PATH, 2).count() == 0
