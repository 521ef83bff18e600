import hashlib

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import exact_dedup as D


def brute(rows, largest):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text, *_ in rows:
        ids = [d for d in groups[text or ""] if d is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        out.append((doc, keep, len(groups[text or ""]), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_against_brute_force_with_and_without_spilling(spark):
    rows = AWKWARD + [(100 + i, sentence(5 + i % 7, i % 9), "en", "a") for i in range(200)]
    docs = documents(spark, rows, 5)
    for keep in ("smallest", "largest"):
        for budget in (1, 2000, D.BUDGET):
            got = plain(D.dedup(docs, keep=keep, budget=budget), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
            assert got == brute(rows, keep == "largest")


def test_kept_rows_keep_their_columns(spark):
    docs = documents(spark, AWKWARD)
    kept = D.kept(docs, keep="largest")
    assert kept.columns == docs.columns
    # nulls and the empty text are one group, kept by 2; the repeated row of document 5 stays twice, as both carry the owner
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 3, 5, 5, 6, 7, 8, 9]


def test_empty_table(spark):
    assert D.dedup(documents(spark, [])).count() == 0


def test_trie_splits_edges_and_holds_prefixes():
    t = D.Trie(larger=False)
    for i, key in enumerate([b"roman", b"romane", b"rom", b"rubens", b"", b"roman"]):
        t.insert(key, i, 1)
    got = sorted(t.terminals(t.root, b""))
    assert got == [(b"", 4, 1), (b"rom", 2, 1), (b"roman", 0, 2), (b"romane", 1, 1), (b"rubens", 3, 1)]
    out = sorted(t.spill())
    assert out == got[1:] and not t.root.kids


def test_equal_hashes_stay_apart():
    t = D.Trie(larger=True)
    for i, content in enumerate([b"abc", b"abd", b"abc"]):
        t.insert(D.key_of(content, 42), i, 1)
    assert sorted((k[D.HEAD :], o, n) for k, o, n in t.spill()) == [(b"abc", 2, 2), (b"abd", 1, 1)]
