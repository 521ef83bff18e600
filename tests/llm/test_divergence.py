import math
import re
from collections import Counter

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import divergence as D

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def base(text):
    text = text or ""
    w = WORDS(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, earlier, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORDS(x):
            dup += x in earlier
            earlier.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def js(p, q):
    a, b = sum(p.values()), sum(q.values())
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        total += sum(z * math.log2(z / m) for z in (x, y) if z) / 2
    return math.sqrt(max(total, 0.0))


def words_of(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def brute(rows, limits=D.Limits()):
    chars, counts, totals = {}, {}, Counter()
    table = D.class_table()
    kinds = lambda t: Counter(int(table[min(ord(c), 0xFFFF)]) for c in t)
    for _, t, lang, _ in rows:
        if lang is not None and t is not None:
            chars.setdefault(lang, Counter()).update(kinds(t))
            w = words_of(t)
            totals[lang] += len(w)
            counts.setdefault(lang, Counter()).update(x for x in w if len(x) <= 6)
    refs = {}
    for lang in chars:
        top = dict(sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:50])
        if totals[lang] >= limits.min_reference_words and top:
            refs[lang] = (chars[lang], top, top | {"": totals[lang] - sum(top.values())})
    out = []
    for doc, t, lang, _ in rows:
        b = base(t)
        kept = not b[-1]
        if kept and refs:
            w = words_of(t)

            def far(x, w=w, t=t):
                h = Counter(v if v in refs[x][1] else "" for v in w)
                return js(kinds(t), refs[x][0]), js(h, refs[x][2]) if w else 0.0

            c, d = far(lang) if lang in refs else min((far(x) for x in refs), key=sum)
            kept = not (c > 0.15 + 0.75 / b[0] ** 0.5 or (len(w) >= 100 and d > 0.2 + 2.5 / len(w) ** 0.5))
        out.append((doc, *b, kept))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
GERMAN = ("der", "die", "und", "zu", "haus", "baum", "weg", "mit", "ist", "nicht", "ein", "wald", "see", "berg", "tal")


def corpus():
    big = tuple(f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fo", "gi") for b in ("ra", "to", "mi", "lu", "ne", "so", "pa"))
    rows = list(AWKWARD)
    rows += [(100 + i, sentence(80 + i, i, big) + "\nline\nline\n \n \na|b $5", "en", "a") for i in range(30)]
    rows += [(200 + i, sentence(80 + i, i, tuple(f"{w}{x}" for w in GERMAN for x in ("", "en", "er"))), "de", "a") for i in range(30)]
    rows += [(300, sentence(150, 3, big).upper().replace(" ", "!! "), "en", "a"), (301, sentence(150, 4, big).replace(" ", " | "), "en", "a"),
             (302, sentence(150, 5, tuple(f"{w}{x}" for w in GERMAN for x in ("", "en", "er"))), "xx", "a"), (303, "same words here " * 40, "en", "a")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    assert plain(D.judge(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_what_goes_and_what_stays(spark):
    kept = {r.doc_id: r.kept for r in D.judge(documents(spark, corpus())).collect()}
    assert not kept[300] and not kept[301] and not kept[303]
    assert kept[302] and all(kept[i] for i in range(100, 130)) and all(kept[i] for i in range(200, 230))


def test_kept_filters_rows_with_all_columns(spark):
    docs = documents(spark, corpus())
    out = D.kept(docs)
    assert out.columns == docs.columns
    good = D.judge(docs).where("kept").select("doc_id")
    assert plain(out.select("doc_id")) == plain(good)


def test_no_references_and_empty_table(spark):
    rows = [(1, sentence(70, 1, tuple(f"w{k}" for k in range(60))), None, "a"), (2, "short", "en", "a")]
    assert plain(D.judge(documents(spark, rows)), *COLUMNS) == brute(rows)
    assert D.judge(documents(spark, [])).count() == 0


def test_distance():
    import numpy as np

    assert D.js_distance(np.array([1.0, 0]), np.array([0, 2.0])) == 1.0
    assert D.js_distance(np.array([3.0, 1]), np.array([6.0, 2])) == 0.0


def test_rare_language_is_judged_by_base_rules_alone(spark):
    rows = corpus()
    rare = tuple(f"{a}{b}" for a in ("qu", "zh", "ny", "hw") for b in ("ix", "ox", "ux", "ax", "ex"))
    rows += [(400, sentence(200, 1, rare), "rare", "a"), (401, sentence(200, 2, rare), None, "a"), (402, "same words here " * 60, "rare", "a")]
    got = {r.doc_id: r for r in D.judge(documents(spark, rows)).collect()}
    assert got[400].kept and got[401].kept and not got[402].kept
    assert got[400].word_distance > 0.5  # still measured
    assert {400, 401} <= {r.doc_id for r in D.kept(documents(spark, rows)).select("doc_id").collect()}


def test_labelled_good_rows_set_the_word_test(spark):
    big = tuple(f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fo", "gi") for b in ("ra", "to", "mi", "lu", "ne", "so", "pa"))
    rows = [(i, sentence(60 if i % 2 else 150, i, big), "en", "a") for i in range(300)]
    junk = tuple(f"{w}ertionez" for w in "abcdefghijklmnopqrst")
    rows += [(900 + k, sentence(n, k, junk), "en", "a") for k, n in enumerate((60, 75, 99))]
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(i, 0) for i in range(900, 903)], "doc_id long, quality int")
    docs = documents(spark, rows)
    loose = {r.doc_id for r in D.judge(docs).where("kept").collect()}
    tight = {r.doc_id for r in D.judge(docs, labels=labels).where("kept").collect()}
    assert {900, 901, 902} <= loose and tight == set(range(300))
    refs = D.references(docs)
    assert D.fitted(docs, labels.limit(20), refs) == D.Limits() == D.fitted(docs, labels.limit(0), refs)


def test_every_label_counts(spark):
    rows = [(i, sentence(60 if i % 2 else 150, i, tuple(f"{a}{b}" for a in ("al", "be", "co", "du") for b in ("ra", "to", "mi", "lu"))), "en", "a") for i in range(300)]
    docs = documents(spark, rows)
    # far more labels than any share of which would leave enough of these documents
    labels = spark.range(60_000).selectExpr("id AS doc_id", "1 AS quality")
    refs = D.references(docs)
    assert D.fitted(docs, labels, refs) == D.fitted(docs, labels.where("doc_id < 300"), refs) != D.Limits()


def test_labels_meet_measures_not_texts(spark, monkeypatch):
    rows = [(i, sentence(60 if i % 2 else 150, i, tuple(f"{a}{b}" for a in ("al", "be", "co", "du") for b in ("ra", "to", "mi", "lu"))), "en", "a") for i in range(300)]
    rows += [(None, sentence(80, 1), "en", "a"), (7, None, "en", "a"), (8, sentence(80, 8), None, "a")]
    docs = documents(spark, rows)
    labels = spark.range(400).selectExpr("id AS doc_id", "int(id % 3 > 0) AS quality")
    met, meet = [], D.with_slacks
    monkeypatch.setattr(D, "with_slacks", lambda found, *rest: met.append(found.dtypes) or meet(found, *rest))
    limits = D.fitted(docs, labels, D.references(docs))
    by_labels, by_limits = D.judge(docs, labels=labels), D.judge(docs, limits=limits)
    assert limits != D.Limits() and plain(by_labels) == plain(by_limits)
    assert sorted(r.doc_id for r in D.kept(docs, labels=labels).collect()) == sorted(r.doc_id for r in by_limits.where("kept").collect())
    assert met == [[("id", "bigint"), ("letters", "bigint"), ("word_distance", "double")]] * 3
