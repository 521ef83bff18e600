from pyspark.sql import functions as F

from wayfare.llm import preference as P

SCHEMA = "conv_id long, turn long, role string, text string, turns int, chosen int, at int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def text(ts):
    return "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in ts)


def spans(ts):
    out, at = [], 0
    for r, t in ts:
        first = at + len(f"<|{r or 'unknown'}|>\n")
        at = first + len(t or "") + len("<|end|>\n")
        if r == "assistant":
            out.append((first, at))
    return out


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n, text(a[:n]), text(a[n:]), spans(a[n:]), text(b[n:]), spans(b[n:])


def run(spark, pairs):
    rows = [(k, i, side, r, t) for k, (a, b) in pairs.items() for side, ts in (("a", a), ("b", b)) for i, (r, t) in enumerate(ts)]
    made = {}
    for side in "ab":
        own = table(spark, [(k, i, r, t) for k, i, s, r, t in rows if s == side])
        made[side] = P.turns(own, out=side)
    keys = spark.createDataFrame([(k,) for k in pairs], "conv_id long")
    joined = keys.join(made["a"], "conv_id", "left").join(made["b"], "conv_id", "left")
    got = P.formatted(joined, "a", "b").collect()
    return {r.conv_id: (r.n_shared, r.prompt, r.chosen, [tuple(x) for x in r.chosen_spans], r.rejected, [tuple(x) for x in r.rejected_spans]) for r in got}


def test_against_plain_loops(spark):
    u, a = ("user", "hé\n"), ("assistant", "yes")
    pairs = {
        1: ([u, a, u, ("assistant", "x" * 50_000)], [u, a, u, ("assistant", "no")]), 2: ([u, a], [u, a]), 3: ([a], [u]), 4: ([u, a, a, a], [u]),
        5: ([(None, "t"), (None, None)], [(None, "t"), (None, "")]), 6: ([(None, None)], [(None, None), ("assistant", None)]), 7: ([], [a]), 8: ([], []),
        9: ([("system", "😀"), u, a, u], [("system", "😀"), u, ("assistant", "yes "), u]),
    }
    got = run(spark, pairs)
    assert got == {k: brute(a, b) for k, (a, b) in pairs.items()}


def test_order_and_repeats_of_turns(spark):
    t = table(spark, [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, None, "user", "z"), (None, 1, "user", "n"), (None, 1, None, "n")])
    got = {r.conv_id: [(x.turn, x.role, x.text) for x in r.turns] for r in P.turns(t).collect()}
    assert got == {1: [(None, "user", "z"), (1, "user", "a"), (2, "user", "b"), (2, "user", "b")], None: [(1, None, "n"), (1, "user", "n")]}


def test_alternatives_share_all_but_the_last_answer(spark):
    t = table(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (2, 0, "user", "s"), (2, 1, "assistant", "b"), (3, 0, "user", "alone")])
    got = {r.conv_id: [x.text for x in r.rejected] for r in P.alternatives(P.turns(t)).collect()}
    assert got == {1: ["q", "b"], 2: ["s"], 3: ["alone"]}


def test_no_python_in_the_plan_and_empty_table(spark):
    done = P.formatted(P.alternatives(P.turns(table(spark, []))))
    assert done.count() == 0
    assert "Python" not in done._jdf.queryExecution().toString() and "Arrow" not in done._jdf.queryExecution().toString()
    assert done.select(F.size("chosen_spans")).columns
