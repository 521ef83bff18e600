import hashlib
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import sharding as S


def test_sizes_checksums_and_places(spark):
    rows = AWKWARD + [(100 + i, sentence(30 + i % 200, i), "en", "a") for i in range(2000)]
    got = S.shard(documents(spark, rows)).collect()
    wanted = sorted((d is None, str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((r.doc_id is None, str(r.doc_id), r["size"], r.text_crc32) for r in got) == wanted
    places, load = {}, [0] * S.SHARDS
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r["size"]
    assert set(places) <= set(range(S.SHARDS))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    longest = max(r["size"] for r in got)
    rest = sorted(load)[:-1]
    assert max(rest) - min(rest) <= 2000 and max(load) <= max(longest, max(rest)) + 2000


def test_same_rows_same_shards(spark):
    rows = [(i, sentence(10 + i % 50, i), "en", "a") for i in range(300)]
    a = plain(S.shard(documents(spark, rows, 2)), "doc_id", "shard", "slot", "vslot")
    assert a == plain(S.shard(documents(spark, rows[::-1], 7)), "doc_id", "shard", "slot", "vslot")


def test_rebalancing_moves_only_what_it_must():
    sizes = {s: 100 + s % 13 for s in range(S.SLOTS)}
    one = S.first_map(sizes, 24)
    two = S.rebalanced(one, sizes, 25)
    moved = [s for s in range(S.SLOTS) if one[s] != two[s]]
    assert all(two[s] == 24 for s in moved)
    assert 0.8 * S.SLOTS / 25 <= len(moved) <= 1.2 * S.SLOTS / 25
    load = [sum(sizes[s] for s in range(S.SLOTS) if two[s] == k) for k in range(25)]
    assert max(load) <= 1.02 * min(load)


def test_versions_are_kept(spark, tmp_path):
    S.store_map(spark, [0, 1, 0], 1, str(tmp_path))
    S.store_map(spark, [0, 1, 2], 2, str(tmp_path))
    got = spark.read.parquet(str(tmp_path)).collect()
    assert sorted((r.version, r.vslot, r.shard) for r in got) == [(1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 0), (2, 1, 1), (2, 2, 2)]


def test_slots_and_shards_match_a_plain_loop(spark):
    rows = AWKWARD + [(None, None, None, None)] * 40 + [(100 + i, sentence(10 + i % 50, i), "en", "a") for i in range(300)]
    seen, wanted, sizes = Counter(), [], Counter()
    for d, t, *_ in rows:
        raw = (t or "").encode()
        key = ("?" if d is None else str(d), zlib.crc32(raw), len(raw) + 8)
        said = ":".join(map(str, (*key, seen[key])))
        seen[key] += 1
        slot = int(hashlib.md5(said.encode()).hexdigest()[:12], 16) % S.SLOTS
        wanted.append((*key, slot))
        sizes[slot] += key[2]
    load, shard_of = [0] * S.SHARDS, {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        shard_of[slot] = load.index(min(load))
        load[shard_of[slot]] += sizes[slot]
    got = S.shard(documents(spark, rows)).collect()
    assert sorted(("?" if r.doc_id is None else str(r.doc_id), r.text_crc32, r["size"], r.vslot, r.shard) for r in got) == sorted((*w, shard_of[w[3]]) for w in wanted)


def test_equal_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "COPIES", 64)
    rows = [(None, "the same text", "en", "a")] * 2000 + [(i, sentence(3, i), "en", "a") for i in range(1000)]
    got = S.shard(documents(spark, rows)).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert len(got) == 3000 and max(load.values()) <= 1.1 * min(load.values())


def test_a_stored_map_is_read_and_edited(spark, tmp_path):
    folder = str(tmp_path / "map")
    docs = documents(spark, [(i, sentence(10 + i % 50, i), "en", "a") for i in range(3000)])
    of = lambda d: {r.doc_id: (r.shard, r.map_version) for r in d.collect()}
    one = of(S.shard(docs, folder=folder))
    assert of(S.shard(docs, folder=folder)) == one and {v for _, v in one.values()} == {1}
    two = of(S.shard(docs, S.SHARDS + 1, folder=folder))
    moved = [d for d in one if one[d][0] != two[d][0]]
    assert {v for _, v in two.values()} == {2} and {two[d][0] for d in moved} == {S.SHARDS} and 60 <= len(moved) <= 180
    three = of(S.shard(docs, S.SHARDS, folder=folder))
    assert {v for _, v in three.values()} == {3} and {s for s, _ in three.values()} == set(range(S.SHARDS))
    assert sum(two[d][0] != three[d][0] for d in two) <= 200
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        S.store_map(spark, [0], 1, folder)


def test_empty_table(spark):
    assert S.shard(documents(spark, [])).count() == 0
