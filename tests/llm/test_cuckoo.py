"""The cuckoo-filter index against plain sets and dictionaries."""

import hashlib
import random
import re

import numpy as np

from gleaner.llm import cuckoo
from gleaner.llm.cuckoo import CuckooFilter, DigestIndex, exact_duplicates

SCHEMA = "doc_id long, text string, `a.b` string, _sha int, kept string, size int, _gen int"
TEXTS = [None, "", " \t\n\x0b\x0c\r", "a b", "ab", "a  b", "a b", "x" * 300_000, "x" * 150_000 + " " + "x" * 150_000, "Ab", "é\U0001f600", "é \U0001f600"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "y", 1, "k", 2, 3) for i, t in rows], SCHEMA)


def expected(rows):
    """(doc_id, keep_id, group_size, kept, sha) by plain grouping."""
    groups, out = {}, []
    for at, (i, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, at))
    for plain, members in groups.items():
        best = min(members)
        for m in members:
            sha = hashlib.sha256(plain.encode()).hexdigest()
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), m == best, sha))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_filter_is_a_set():
    draw = np.random.default_rng(4)
    for size in (1, 17, 3_000):
        key = draw.integers(0, 2**64, size, dtype=np.uint64)
        index = CuckooFilter(16)
        index.insert(key)
        index.insert(key[: size // 2])
        assert len(index) == len(np.unique(key)) and index.contains(key).all()
        stored = np.sort(index.keys[index.slots != 0])
        assert (stored == np.unique(key)).all()
        half, rest = key[: size // 2], key[size // 2 :]
        assert index.delete(half) == len(half) and index.delete(half) == 0
        assert index.contains(rest).all() and len(index) == len(rest)
        again = CuckooFilter.load(index.slots.tobytes(), index.keys.tobytes())
        assert again.contains(rest).all()


def test_filter_grows_from_its_keys_and_is_seldom_wrong():
    draw = np.random.default_rng(5)
    index = CuckooFilter(16)
    key = draw.integers(0, 2**64, 20_000, dtype=np.uint64)
    for part in np.array_split(key, 50):
        index.insert(part)
    assert len(index.slots) >= 8192 and index.contains(key).all() and len(index) == 20_000
    other = draw.integers(0, 2**64, 50_000, dtype=np.uint64)
    assert index.contains(other).mean() < 0.001


def test_equal_texts(spark):
    rows = list(enumerate(TEXTS)) + [(3, "a b"), (None, "ab"), (None, "only here"), (99, "a b\n")]
    assert found(exact_duplicates(table(spark, rows), shards=3)) == expected(rows)


def test_hot_text(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3_000)]
    assert found(exact_duplicates(table(spark, rows), shards=5)) == expected(rows)


def test_nothing(spark):
    assert exact_duplicates(table(spark, [])).collect() == []


def test_false_hits_are_verified(spark, monkeypatch):
    """With a filter that knows everything, only the bucket tells texts apart."""
    rows = [(i, f"text {i % 40}") for i in range(100)]
    monkeypatch.setattr(CuckooFilter, "contains", lambda self, key: np.ones(len(key), bool))
    arrivals = []
    for i, t in rows:
        plain = t.replace(" ", "").encode()
        cuckoo._merged(found_rows := {}, hashlib.sha256(plain).digest(), len(plain), (i, 1, i, len(t)), 1)
        arrivals.append(cuckoo._rows(found_rows, 1))
    import pyarrow as pa

    empty = pa.table({**{n: pa.nulls(0, arrivals[0].schema.field(n).type) for n in cuckoo._NAMES}, "slots": pa.nulls(0, pa.binary()), "keys": pa.nulls(0, pa.binary())})
    out = cuckoo._admit(1)((pa.scalar(0),), empty, pa.Table.from_batches(arrivals)).to_pylist()
    entries = [r for r in out if r["slots"] is None]
    assert len(entries) == 40 and sum(r["size"] for r in entries) == 100


def test_live_digests_come_and_go(spark, tmp_path):
    draw = random.Random(8)
    index = DigestIndex(spark, str(tmp_path / "live"), shards=4)
    live = []
    for step in range(2):
        new = [(step * 100 + k, f"text {draw.randint(0, 30)}" + " " * draw.randint(0, 2)) for k in range(40)]
        index.insert(table(spark, new))
        live += new
        gone = {i for i, _ in draw.sample(live, 25)}
        index.delete(spark.createDataFrame([(i,) for i in gone | {-5}], "doc_id long"))
        live = [r for r in live if r[0] not in gone]
        assert found(index.decisions()) == expected(live)
    again = DigestIndex.open(spark, str(tmp_path / "live"))
    assert again.shards == 4 and found(again.decisions()) == expected(live)
    alive = {re.sub(r"\s", "", t) for _, t in live}
    slots = [CuckooFilter.load(r.slots, r.keys) for r in again._filters("slots", "keys").collect()]
    assert sum(map(len, slots)) == len(alive)
    asked = table(spark, [(1, f"text {k}") for k in range(60)])
    known = {bytes(r._sha).hex() for r in again.probe(asked).collect()}
    assert known == {hashlib.sha256(t.encode()).hexdigest() for t in alive}
