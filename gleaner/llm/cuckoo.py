"""Exact duplicates through an index of cuckoo filters over the digests of live texts.

Texts are equal when they are identical after all white space (``[\\x20\\x09-\\x0D]``) is deleted. The index is a
folder of three tables, dealt over shards by digest: ``members`` has one narrow row per document, ``entries``
one per distinct text with the row that stays and the number of copies, ``filters`` one cuckoo filter per shard.
A digest that its filter does not know is new at once; a hit is verified against the content that the shard's
bucket holds (SHA-256 and length of the normalised text), so a false positive only costs a look. Digests are
inserted and deleted; a filter that overflows is built again at twice its size from the keys stored beside its
fingerprints. Fingerprints alone are read to probe.

Every change is a new generation, written beside the old ones: a job that is lost leaves the last complete
generation, since its filters are written last. Rows of equal texts are combined in each task before they are
shuffled, so a text that a third of all rows share sends one row per task; texts themselves never move.

Of equal texts the one with the most code points before normalisation stays, then the least doc_id, then the
first row. Defined cases: a null text is empty, and empty texts are equal to each other; a row without doc_id
stays only where no equal row has one, and ``keep_id`` is null there; rows that repeat a doc_id are rows of
their own, of which one is kept; an empty table gives no rows; other columns are not looked at. A text may have
any length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.words import mix
from gleaner.session import checkpoint_dir

SLOTS = 4
#: moves of stored digests before a filter counts as full
KICKS = 60
#: shards at least, and rows of a shard at most on average; a filter and its bucket lie in one task
SHARDS = 256
SHARD_ROWS = 50_000
#: rows a task combines at a time
COMBINED = 100_000
#: copies beyond this share of all rows meet their entry by a broadcast: at most 1 / HOT entries
HOT = 0.001

_U = np.uint64
_ENTRY = "shard int, _sha binary, _bytes long, doc_id long, _gen int, _row long, _chars long, size long"
_STATE = f"{_ENTRY}, slots binary, keys binary"
_NAMES = [field.split()[0] for field in _ENTRY.split(", ")]


class CuckooFilter:
    """A set of 64-bit keys as 16-bit fingerprints, four to a bucket; keys are kept beside them for resizing."""

    def __init__(self, buckets: int = 16):
        self.slots = np.zeros((buckets, SLOTS), np.uint16)
        self.keys = np.zeros((buckets, SLOTS), np.uint64)

    @classmethod
    def load(cls, slots: bytes, keys: bytes | None = None) -> CuckooFilter:
        self = cls.__new__(cls)
        self.slots = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        self.keys = np.frombuffer(keys, np.uint64).reshape(-1, SLOTS).copy() if keys is not None else None
        return self

    def __len__(self) -> int:
        return int(np.count_nonzero(self.slots))

    @staticmethod
    def _print(key: np.ndarray) -> np.ndarray:
        return np.maximum(mix(key ^ _U(0x5BD1E9955BD1E995)) >> _U(48), _U(1)).astype(np.uint16)

    def _first(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) & _U(len(self.slots) - 1)).astype(np.int64)

    def _other(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        step = mix(self._print(key).astype(np.uint64)) & _U(len(self.slots) - 1)
        return at ^ step.astype(np.int64)

    def contains(self, key: np.ndarray) -> np.ndarray:
        """May hold the key: never False for one that is stored."""
        at, mark = self._first(key), self._print(key)[:, None]
        return (self.slots[at] == mark).any(1) | (self.slots[self._other(key, at)] == mark).any(1)

    def _stored(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the key itself is stored, in which bucket and slot."""
        first = self._first(key)
        found, bucket, slot = np.zeros(len(key), bool), first.copy(), np.zeros(len(key), np.int64)
        for at in (self._other(key, first), first):
            same = (self.keys[at] == key[:, None]) & (self.slots[at] != 0)
            hit = same.any(1)
            found |= hit
            bucket[hit], slot[hit] = at[hit], same.argmax(1)[hit]
        return found, bucket, slot

    def _fill(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put keys into free slots of their buckets; those that found none come back."""
        order = np.argsort(at, kind="stable")
        key, at = key[order], at[order]
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        taken = self.slots[at] != 0
        fits = rank < SLOTS - taken.sum(1)
        slot = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
        self.slots[at[fits], slot], self.keys[at[fits], slot] = self._print(key[fits]), key[fits]
        return key[~fits], at[~fits]

    def insert(self, key: np.ndarray) -> None:
        """Add keys; one that is stored already is not stored twice."""
        key = np.unique(key)
        key = key[~self._stored(key)[0]]
        at = self._first(key)
        turn = 0
        while len(key):
            key, at = self._fill(key, at)
            key, at = self._fill(key, self._other(key, at)) if len(key) else (key, at)
            if not len(key):
                break
            turn += 1
            if turn % KICKS == 0:
                key = np.concatenate((key, self.keys[self.slots != 0]))
                self.__init__(2 * len(self.slots))
                at = self._first(key)
                continue
            # one key of a bucket takes a stored one's slot, which goes on to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = ((mix(key[one] + _U(turn)) >> _U(9)) & _U(SLOTS - 1)).astype(np.int64)
            out = self.keys[at[one], slot]
            self.keys[at[one], slot], self.slots[at[one], slot] = key[one], self._print(key[one])
            rest = np.ones(len(key), bool)
            rest[one] = False
            key, at = np.concatenate((out, key[rest])), np.concatenate((self._other(out, at[one]), at[rest]))

    def delete(self, key: np.ndarray) -> int:
        """Remove the keys that are stored, and those only; their number."""
        key = np.unique(key)
        found, bucket, slot = self._stored(key)
        self.slots[bucket[found], slot[found]] = 0
        self.keys[bucket[found], slot[found]] = 0
        return int(found.sum())


def _keys(sha: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.array([int.from_bytes(x[:8], "big") for x in sha.to_pylist()], dtype=np.uint64)


def _better(a: tuple, b: tuple) -> bool:
    """Whether row ``a`` stays rather than ``b``: (doc_id, _gen, _row, _chars)."""
    return (-a[3], a[0] is None, a[0] or 0, a[1], a[2]) < (-b[3], b[0] is None, b[0] or 0, b[1], b[2])


def _merged(into: dict, sha: bytes, length: int, row: tuple, size: int) -> bool:
    """Count a row with the equal ones; False if its text is new."""
    known = into.get((sha, length))
    if known is None:
        into[(sha, length)] = [row, size]
        return False
    known[1] += size
    if _better(row, known[0]):
        known[0] = row
    return True


def _rows(found: dict, shards: int) -> pa.RecordBatch:
    rows = [[sha, length, *row, size] for (sha, length), (row, size) in found.items()]
    shard = [int.from_bytes(r[0][:8], "big") % shards for r in rows]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *columns], names=_NAMES)


def _combine(shards: int):
    """mapInArrow: one row for the equal texts that a task meets together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_sha", "_bytes", "doc_id", "_gen", "_row", "_chars")]
            for sha, length, *row in zip(*columns):
                _merged(found, sha, length, tuple(row), 1)
            if len(found) >= COMBINED:
                yield _rows(found, shards)
                found = {}
        yield _rows(found, shards)

    return run


def _with_filter(rows: pa.RecordBatch, shard: int, index: CuckooFilter) -> pa.Table:
    """Entries, and the filter as a row of its own."""
    entries = pa.Table.from_batches([rows])
    state = pa.table({
        "shard": pa.array([shard], pa.int32()),
        **{f.name: pa.nulls(1, f.type) for f in entries.schema if f.name != "shard"},
        "slots": pa.array([index.slots.tobytes()], pa.binary()), "keys": pa.array([index.keys.tobytes()], pa.binary()),
    })
    blank = pa.nulls(entries.num_rows, pa.binary())
    return pa.concat_tables([entries.append_column("slots", blank).append_column("keys", blank), state])


def _loaded(state: pa.Table) -> tuple[CuckooFilter, dict]:
    """A shard's filter and the entries that were fetched from its bucket."""
    slots, keys = state.column("slots").to_pylist(), state.column("keys").to_pylist()
    index = next((CuckooFilter.load(s, k) for s, k in zip(slots, keys) if s is not None), None) or CuckooFilter()
    known: dict = {}
    columns = [state.column(c).to_pylist() for c in ("_sha", "_bytes", "doc_id", "_gen", "_row", "_chars", "size")]
    for sha, length, *row, size in zip(*columns):
        if sha is not None:
            known[(sha, length)] = [tuple(row), size]
    return index, known


def _admit(shards: int):
    """Cogrouped by shard, (filter and suspects, arrivals): the new filter and the entries that changed."""

    def run(key: tuple, state: pa.Table, arrivals: pa.Table) -> pa.Table:
        index, known = _loaded(state)
        touched = set()
        for block in arrivals.to_batches(max_chunksize=8192):
            maybe = index.contains(_keys(block.column("_sha")))
            columns = [block.column(c).to_pylist() for c in ("_sha", "_bytes", "doc_id", "_gen", "_row", "_chars", "size")]
            new, later = [], []
            for hit, sha, length, *row, size in zip(maybe, *columns):
                if hit:
                    later.append((sha, length, tuple(row), size))
                elif not _merged(known, sha, length, tuple(row), size):
                    new.append(sha)
                touched.add((sha, length))
            # what the filter knows is held against the bucket; where it was wrong, the text is new after all
            new += [sha for sha, length, row, size in later if not _merged(known, sha, length, row, size)]
            index.insert(_keys(pa.array(new, pa.binary())))
        return _with_filter(_rows({k: known[k] for k in touched}, shards), key[0].as_py(), index)

    return run


def _retire(shards: int):
    """Cogrouped by shard, (filter and entries that share a key with what changed, the changed entries)."""

    def run(key: tuple, state: pa.Table, changed: pa.Table) -> pa.Table:
        index, known = _loaded(state)
        _, now = _loaded(changed)
        known.update(now)
        alive = {sha[:8] for (sha, _), (_, size) in known.items() if size}
        dead = [sha for (sha, _), (_, size) in now.items() if not size and sha[:8] not in alive]
        index.delete(_keys(pa.array(dead, pa.binary())))
        return _with_filter(_rows(now, shards), key[0].as_py(), index)

    return run


def _probing(key: tuple, filters: pa.Table, arrivals: pa.Table) -> pa.Table:
    """Cogrouped by shard: digests of arrivals that the shard's filter may know."""
    kept = arrivals.select(["shard", "_sha", "_bytes"])
    if not filters.num_rows:
        return kept.slice(0, 0)
    index = CuckooFilter.load(filters.column("slots")[0].as_py())
    return kept.filter(pa.array(index.contains(_keys(kept.column("_sha")))))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, _sha, _bytes, _chars, _row``: what is left of a document; its text goes no further."""
    text = F.coalesce("text", F.lit(""))
    plain = F.translate(text, " \t\n\x0b\x0c\r", "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(plain, 256)).alias("_sha"),
        F.octet_length(plain).cast("long").alias("_bytes"), F.length(text).cast("long").alias("_chars"),
        F.monotonically_increasing_id().alias("_row"),
    )


class DigestIndex:
    """The live texts below a folder that all executors share; ``shards`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path, self.shards, self.generation = spark, path.rstrip("/"), shards, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """An index that an earlier session wrote; what a lost job left unfinished is not seen."""
        last = spark.read.parquet(f"{path.rstrip('/')}/filters").agg(F.max("gen"), F.max_by("shards", "gen")).first()
        self = cls(spark, path, last[1])
        self.generation = last[0]
        return self

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/gen={self.generation + 1}")

    def _read(self, table: str, schema: str) -> DataFrame:
        """Rows of all generations; a table that has none yet is empty."""
        if table == "gone" and not self._removed():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, gen int").parquet(f"{self.path}/{table}").filter(F.col("gen") <= self.generation).drop("gen")

    def _removed(self) -> bool:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/gone")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _filters(self, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/filters/gen={self.generation}").select("shard", *columns)

    def entries(self) -> DataFrame:
        """The newest state of every text that is or was live: ``size`` 0 is none."""
        if not self.generation:
            return self.spark.createDataFrame([], _ENTRY)
        stored = self._read("entries", f"{_ENTRY}, version int")
        if self.generation == 1:
            return stored.drop("version")
        newest = stored.groupBy("_sha", "_bytes").agg(F.max(F.struct("version", *[c for c in _NAMES if c not in ("_sha", "_bytes")])).alias("e"))
        return newest.select("_sha", "_bytes", "e.*").select(_NAMES)

    def members(self) -> DataFrame:
        """The rows that are live."""
        columns = "doc_id long, _sha binary, _bytes long, _chars long, _row long, _gen int"
        rows = self._read("members", columns)
        return rows.join(self._read("gone", "_gen int, _row long"), ["_gen", "_row"], "anti") if self._removed() else rows

    def _commit(self, out: DataFrame) -> None:
        """Entries and filters of a new generation; the filters, written last, make it count."""
        target = f"{self.path}/changes/{uuid.uuid4().hex}"
        out.write.parquet(target)
        out = self.spark.read.schema(_STATE).parquet(target)
        version = F.lit(self.generation + 1)
        self._write(out.filter("slots IS NULL").select(*_NAMES, version.alias("version")), "entries")
        self._write(out.filter("slots IS NOT NULL").select("shard", "slots", "keys", F.lit(self.shards).alias("shards")), "filters")
        self.generation += 1

    def probe(self, docs: DataFrame) -> DataFrame:
        """``shard, _sha, _bytes`` of the texts of ``docs`` that are live, by filter and bucket."""
        arrivals = digests(docs).withColumn("_gen", F.lit(0)).mapInArrow(_combine(self.shards), _ENTRY)
        return self._suspects(arrivals).select("shard", "_sha", "_bytes")

    def _suspects(self, arrivals: DataFrame) -> DataFrame:
        """Stored entries of the arrivals that pass their filter."""
        hits = self._filters("slots").groupBy("shard").cogroup(arrivals.groupBy("shard")).applyInArrow(_probing, "shard int, _sha binary, _bytes long")
        return self.entries().filter("size > 0").join(hits, ["shard", "_sha", "_bytes"], "semi").select(_NAMES)

    def _state(self, entries: DataFrame) -> DataFrame:
        empty = {c: F.lit(None).cast(entries.schema[c].dataType) for c in _NAMES if c != "shard"}
        return entries.withColumns({"slots": F.lit(None).cast("binary"), "keys": F.lit(None).cast("binary")}).unionByName(
            self._filters("slots", "keys").withColumns(empty)
        )

    def insert(self, docs: DataFrame) -> None:
        """Add the texts of ``docs``."""
        self._write(digests(docs).withColumn("_gen", F.lit(self.generation + 1)), "members")
        new = self.spark.read.parquet(f"{self.path}/members/gen={self.generation + 1}")
        if not self.generation:
            self.shards = max(self.shards, -(-new.count() // SHARD_ROWS))
        arrivals = new.select("_sha", "_bytes", "doc_id", "_gen", "_row", "_chars").mapInArrow(_combine(self.shards), _ENTRY)
        if self.generation:
            state = self._state(self._suspects(arrivals))
            arrivals = arrivals.toDF(*_NAMES)
        else:
            state = self.spark.createDataFrame([], _STATE)
        self._commit(state.groupBy("shard").cogroup(arrivals.groupBy("shard")).applyInArrow(_admit(self.shards), _STATE))

    def delete(self, ids: DataFrame) -> None:
        """Remove all live rows with the ids of ``ids (doc_id)``; texts that have no row left leave the filters."""
        live = self.members()
        leaving = live.join(ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "semi").select("_gen", "_row", "_sha", "_bytes")
        self._write(leaving.select("_gen", "_row", "_sha", "_bytes"), "gone")
        gone = self.spark.read.parquet(f"{self.path}/gone/gen={self.generation + 1}")
        touched = gone.select("_sha", "_bytes").distinct()
        kept = live.join(gone, ["_gen", "_row"], "anti").join(touched, ["_sha", "_bytes"], "semi")
        best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "_gen", "_row", "_chars"))
        left = kept.groupBy("_sha", "_bytes").agg(best.alias("b"), F.count("*").alias("_left"))
        changed = self.entries().join(touched, ["_sha", "_bytes"], "semi").join(left, ["_sha", "_bytes"], "left").select(
            "shard", "_sha", "_bytes", *[F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c) if c != "doc_id" else F.col("b.doc_id").alias(c) for c in _NAMES[3:7]],
            F.coalesce("_left", F.lit(0)).alias("size"),
        )
        key = F.substring("_sha", 1, 8).alias("_key")
        near = self.entries().withColumn("_key", key).join(gone.select(key).distinct(), "_key", "semi").select(_NAMES)
        listed = changed.toDF(*_NAMES).withColumns({"slots": F.lit(None).cast("binary"), "keys": F.lit(None).cast("binary")})
        self._commit(self._state(near).groupBy("shard").cogroup(listed.groupBy("shard")).applyInArrow(_retire(self.shards), _STATE))

    def decisions(self) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, text_sha256`` of every live row.

        A text with more than ``HOT`` of all rows is met by broadcast, of which there are at most ``1 / HOT``.
        """
        rows = self.members()
        entry = self.entries().filter("size > 0").select(
            "_sha", "_bytes", F.col("doc_id").alias("keep_id"), F.col("_gen").alias("_kg"), F.col("_row").alias("_kr"), F.col("size").alias("group_size")
        )
        total = entry.agg(F.sum("group_size")).first()[0] or 0
        hot = F.broadcast(entry.filter(F.col("group_size") > HOT * total))
        cold = entry.filter(F.col("group_size") <= HOT * total)
        on = ["_sha", "_bytes"]
        both = rows.join(hot, on).unionByName(rows.join(hot, on, "anti").join(cold, on))
        return both.select(
            "doc_id", "keep_id", "group_size", ((F.col("_gen") == F.col("_kg")) & (F.col("_row") == F.col("_kr"))).alias("kept"),
            F.lower(F.hex("_sha")).alias("text_sha256"),
        )


def exact_duplicates(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: an index of its own is filled and asked."""
    spark = docs.sparkSession
    index = DigestIndex(spark, f"{checkpoint_dir(spark)}/exact-{uuid.uuid4().hex}", shards)
    index.insert(docs)
    return index.decisions()
