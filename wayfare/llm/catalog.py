"""The queries of this subpackage, over whole tables, and the same semantics as SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import (
    bpe,
    chosen_path,
    collocations,
    divergence,
    exact_dedup,
    language_spans,
    licences,
    mixing,
    ordinal_toxicity,
    preference,
    sharding,
    token_records,
    turn_repair,
)
from wayfare.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 1: chat formatting ----------------------------------------------------------------------------------------


def _render_sql(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '')"


def _spans_sql(turns: str) -> str:
    """Start and stop of the assistant's parts, from the lengths of what stands before them."""
    head, body = "length('<|' || coalesce({t}.role, 'unknown') || '|>') + 1", "length(coalesce({t}.text, '')) + 8"
    upto = f"coalesce(list_sum(list_transform({turns}[1:i-1], lambda t: {head.format(t='t')} + {body.format(t='t')})), 0)"
    x = f"{turns}[i]"
    first = f"{upto} + {head.format(t=f'({x})')}"
    return (
        f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: ({x}).role = 'assistant'), "
        f"lambda i: ({first})::BIGINT || '-' || ({first} + {body.format(t=f'({x})')})::BIGINT), ',')"
    )


PREFERENCE_SQL = f"""
WITH c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts FROM conversations GROUP BY conv_id),
l AS (SELECT *, coalesce(list_max(list_filter(range(1, len(ts) + 1), lambda i: (ts[i]).role = 'assistant')), len(ts) + 1) AS at FROM c),
p AS (SELECT l.conv_id, l.ts AS a, list_concat(l.ts[1:l.at-1], coalesce(o.ts[o.at:o.at], [])) AS b FROM l LEFT JOIN l o ON o.conv_id = l.conv_id + 1),
n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n FROM p),
r AS (SELECT conv_id, n, a[1:n] AS s, a[n+1:] AS x, b[n+1:] AS y FROM n)
SELECT conv_id, n::INTEGER AS n_shared, {_render_sql('s')} AS prompt, {_render_sql('x')} AS chosen, {_spans_sql('x')} AS chosen_spans,
       {_render_sql('y')} AS rejected, {_spans_sql('y')} AS rejected_spans FROM r
"""


@query("op1_preference_pairs", PREFERENCE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.alternatives(preference.turns(table(spark, sf_dir, "conversations")))

    def listed(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")

    done = preference.formatted(pairs)
    return done.select("conv_id", "n_shared", "prompt", "chosen", listed("chosen_spans").alias("chosen_spans"), "rejected", listed("rejected_spans").alias("rejected_spans"))


# ---- 2: quality rules ------------------------------------------------------------------------------------------


@query("op2_divergence")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


# ---- 3: toxicity -----------------------------------------------------------------------------------------------


@query("op3_ordinal_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_toxicity.score(docs, ordinal_toxicity.train(docs, table(spark, sf_dir, "labels")))


# ---- 4: language ID --------------------------------------------------------------------------------------------


@query("op4_language_spans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_spans.train(docs.where(~language_spans.held_out("doc_id")))
    known = docs.select("doc_id", "text")
    return language_spans.predict(known, model).select("doc_id", language_spans.held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_spans")


# ---- 5: licence scans ------------------------------------------------------------------------------------------


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    lines = f"regexp_replace(lower({text}), {_quoted(licences.COPYRIGHT_LINE)}, ' ', 'g')"
    plain = f"' ' || trim(regexp_replace({lines}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for spelled, same in licences.SPELLINGS.items():
        if spelled != same:
            plain = f"replace({plain}, ' {spelled} ', ' {same} ')"
    return f"trim({plain})"


LICENCE_SQL = f"""
WITH t(licence, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licences.KNOWN)}),
k AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(licence) AS licence FROM t GROUP BY 1),
d AS (SELECT doc_id, text, sha256({_canonical_sql('text')}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
n AS (
  SELECT doc_id, string_agg(k.licence, ',' ORDER BY i) AS notices
  FROM (SELECT doc_id, i, sha256({_canonical_sql('line')}) AS digest FROM l WHERE line <> '') x JOIN k ON k.digest = x.digest GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.licence, coalesce(n.notices, '') AS notices FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op5_licence_digests", LICENCE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of each document that is a licence text as a whole, and of each of its lines that is a notice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = licences.known(spark)
    return licences.notices(licences.lookup(docs, known), known).select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


# ---- 6: n-gram Jaccard join ------------------------------------------------------------------------------------

JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS shingle
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
k AS (SELECT doc_id, min(reached) AS class_id, count(*) AS class_size FROM r GROUP BY doc_id)
SELECT k.doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = k.doc_id) AS n_links, coalesce(n.n, 0) AS n_shingles, class_size
FROM k LEFT JOIN n ON n.doc_id = k.doc_id
"""


@query("op6_chosen_path_join", JOIN_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents"))


# ---- 7: mixing -------------------------------------------------------------------------------------------------

MIX_SQL = r"""
WITH r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '?') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
p AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM s),
o AS (
  SELECT *, sum(cap) OVER w AS capped_to_here, sum(weight) OVER () - sum(weight) OVER w + weight AS weight_from_here
  FROM p WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap < weight * ((goal - (capped_to_here - cap)) / weight_from_here) AS capped FROM o),
l AS (SELECT (max(goal) - coalesce(sum(cap) FILTER (capped), 0)) / sum(weight) FILTER (NOT capped) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN capped OR level IS NULL THEN cap ELSE weight * level END AS target FROM c, l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
n AS (SELECT *, target - whole * source_size AS need FROM w),
g AS (SELECT source, draw, sum(size) AS words FROM r GROUP BY source, draw),
q AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY draw) AS upto FROM g),
k AS (
  SELECT q.source, draw, upto <= need OR (upto - words <= need AND upto - need < need - (upto - words)) AS more
  FROM q JOIN n ON q.source IS NOT DISTINCT FROM n.source)
SELECT r.doc_id, r.size, n.source_size, n.target, (n.whole + k.more::INT)::BIGINT AS times, (r.size * (n.whole + k.more::INT))::BIGINT AS taken
FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source JOIN k ON r.source IS NOT DISTINCT FROM k.source AND r.draw = k.draw
"""


@query("op7_mix_sources", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# ---- 8: byte-level BPE -----------------------------------------------------------------------------------------


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


# ---- 9: exact dedup --------------------------------------------------------------------------------------------

DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query("op9_exact_dedup", DEDUP_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), keep="largest")


# ---- 10: sharding ----------------------------------------------------------------------------------------------


@query("op10_virtual_slots")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version"
    )


# ---- 11: binary records ----------------------------------------------------------------------------------------

END_ID = 2


@query("op11_token_records")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


# ---- 12: conversation repair -----------------------------------------------------------------------------------

#: The checksum table of CRC-32, and the checksum of an ASCII string, in SQL.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _step_sql() -> tuple[str, str]:
    """The four states after a turn, each as [cost and audit, output], from those before (z0 to z3)."""

    def more(x: str, cost: str, edit: str, out: str) -> str:
        paid = f"lpad((left({x}[1], 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({x}[1], 13)"
        return f"[{paid} || '{edit}', {x}[2] || {out}]"

    own, extra = "(chr(10) || r.role || ':' || r.text)", "(r.fault IS NOT DISTINCT FROM 'truncated')::INT"
    stays = "r.fault IS DISTINCT FROM 'blank' AND r.fault IS DISTINCT FROM 'duplicate'"
    edits: dict[int, list[str]] = {q: [more(f"z{q}", "3", "D", "''")] for q in turn_repair.STATES}
    for (p, x), q in turn_repair.NEXT.items():
        edits[q].append(f"CASE WHEN {stays} AND left(r.role, 1) = '{x}' THEN {more(f'z{p}', extra, 'K', own)} END")
        if x in turn_repair.ROLE:
            renamed = f"(chr(10) || '{turn_repair.ROLE[x]}:' || r.text)"
            edits[q].append(f"CASE WHEN {stays} THEN {more(f'z{p}', '2 + ' + extra, 'R', renamed)} END")
    after = {q: f"least({', '.join(o)})" for q, o in edits.items()}
    inner = ", ".join(f"{v} AS e{q}" for q, v in after.items())
    user, assistant, both = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || 'user:' || chr(10) || 'assistant:'"
    closed = (
        "e0 AS z0, e1 AS z1, "
        f"least(e2, {more('e0', '2', 'I', user)}, {more('e1', '2', 'I', user)}, {more('e3', '2', 'I', user)}) AS z2, "
        f"least(e3, {more('e2', '2', 'I', assistant)}, {more('e0', '4', 'II', both)}, {more('e1', '4', 'II', both)}) AS z3"
    )
    return inner, closed


_INNER, _CLOSED = _step_sql()

REPAIR_SQL = f"""
WITH RECURSIVE k AS (SELECT {CRC_TABLE} AS t),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC.format(x="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit
  FROM conversations, k),
d AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
m AS (
  SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS (
  SELECT conv_id, i, turn, role, text, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM m),
f AS (
  SELECT conv_id, 0::BIGINT AS i, [repeat('0', 12), ''] AS z0, NULL::VARCHAR[] AS z1, [repeat('0', 11) || '2I', chr(10) || 'user:'] AS z2,
         [repeat('0', 11) || '4II', chr(10) || 'user:' || chr(10) || 'assistant:'] AS z3 FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_CLOSED} FROM (
    SELECT f.conv_id, r.i, {_INNER} FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1)),
e AS (SELECT conv_id, least(z0, z3) AS z FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM r GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, left(z[1], 12)::BIGINT AS cost, substr(z[1], 13) AS audit, sha256(substr(z[2], 2)) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults planted by a checksum of conversation and number."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    hit = F.crc32(F.concat_ws(":", *named)) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), hit.alias("hit"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.where("hit <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query("op12_turn_repair", REPAIR_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.summary(damaged(conversations), conversations)


# ---- 13: collocations ------------------------------------------------------------------------------------------

PHRASE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS m FROM g),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS v FROM f WHERE m > 1 AND a >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, k.m, k.a, k.k, l.a AS l, r.a AS r, (2000000::HUGEINT * k.a // (l.a + r.a))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(v[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(v[k.k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, m, v, unnest(range(1, m)) AS i FROM c WHERE m > 2),
j AS (SELECT lang, a, m, v, i, unnest(range(i + 1, m + 1)) AS j FROM i),
h AS (SELECT lang, array_to_string(v[i:j], ' ') AS phrase, max(a) AS longer FROM j WHERE j - i + 1 < m GROUP BY 1, 2),
y AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < 80 * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT z.lang, rank, phrase, a, l, r, n.n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""


@query("op13_collocations", PHRASE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
