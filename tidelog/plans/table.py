"""KvTable: a versioned key/value table on any Hadoop file system.

Layout below the root::

    _snapshots/<20 digits>.json   one immutable version each; the largest is current
    log/<uuid>/                   appended batches that no table holds yet
    data/<uuid>/                  sorted, range-partitioned tables

Puts and deletes are numbered within their batch; the snapshot that publishes
the batch gives it its base, so batches of several writers are ordered by
publication and no number is given twice.

A commit writes files under new names and then publishes a snapshot by an
exclusive create-and-rename; a reader that has loaded a snapshot keeps reading
its files until vacuum() removes them after the retention time.  Durability
means that the snapshot is visible, nothing less and nothing more.
"""

from __future__ import annotations

import base64
import enum
import json
import time
import uuid
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import resolve as R
from tidelog.operators.ranges import Range
from tidelog.plans.tiers import TableMeta, Version
from tidelog.sources.storage import Storage


class TableError(Exception):
    """Base of the errors of this module."""


class CorruptSnapshotError(TableError):
    """A snapshot that cannot be read or fails its checksum."""


class CommitConflictError(TableError):
    """Another writer has published the next snapshot first."""


class Durability(enum.Enum):
    """When appended batches are published: each alone, in groups, or at flush."""

    ALWAYS = "always"
    GROUP_COMMIT = "group"
    BUFFERED = "buffered"

    @property
    def is_durable(self) -> bool:
        """Whether a batch is published once its append, or the commit of its group, returns."""
        return self is not Durability.BUFFERED

    @classmethod
    def parse(cls, name: str) -> Durability:
        """A mode by its name or one of the usual other names."""
        aliases = {"groupcommit": "group", "group-commit": "group", "os": "buffered", "osbuffered": "buffered"}
        return cls(aliases.get(name, name))


@dataclass(frozen=True)
class Options:
    """Policy of a table.

    ``durability``: see Durability.  ``group_batches``: appends of a group
    before it is committed; commit() ends a group early.  ``flush_bytes``:
    stored bytes of pending batches from which a commit flushes.
    ``fanout``: tables of a tier before it is merged.  ``bloom``: write
    Parquet bloom filters for the key.  ``partitions``: range partitions of a
    table file, None for the session's shuffle setting.
    """

    durability: Durability = Durability.ALWAYS
    group_batches: int = 8
    flush_bytes: int = 256 << 20
    fanout: int = 4
    bloom: bool = True
    partitions: int | None = None


def _plain(x):
    return {"bytes": base64.b64encode(bytes(x)).decode()} if isinstance(x, (bytes, bytearray)) else x


def _unplain(x):
    return base64.b64decode(x["bytes"]) if isinstance(x, dict) else x


@dataclass(frozen=True)
class Staged:
    """A batch on disk that no snapshot has.

    ``rows`` numbers of its own to be based, or None if its rows have their
    final sequence numbers, the greatest of which is ``top``.
    """

    path: str
    rows: int | None
    top: int
    size: int


class KvTable:
    """A handle pinned to one snapshot; refresh() moves it to the newest."""

    def __init__(self, spark: SparkSession, root: str, key_type: str = "binary", value_type: str = "binary", options: Options | None = None, storage: Storage | None = None):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or Options()
        self.schema = T._parse_datatype_string(f"key {key_type}, seq bigint, tag tinyint, value {value_type}")
        self.storage = storage or Storage(spark, self.root)
        self.storage.mkdirs("_snapshots")
        self._unpublished: list[Staged] = []
        self.refresh()

    @classmethod
    def open(cls, spark: SparkSession, root: str, **kw) -> KvTable:
        """Open a table, or create an empty one."""
        return cls(spark, root, **kw)

    # --- snapshots ------------------------------------------------------------------

    def snapshots(self) -> list[int]:
        """Numbers of the published snapshots, ascending."""
        names = [name for name, _ in self.storage.list("_snapshots")]
        return sorted(int(n[:20]) for n in names if len(n) == 25 and n.endswith(".json") and n[:20].isdigit())

    def refresh(self, number: int | None = None) -> KvTable:
        """Pin the newest snapshot, or the one given."""
        known = self.snapshots()
        self.number = number if number is not None else (known[-1] if known else 0)
        self.version = self._load(self.number) if self.number else Version()
        return self

    def _load(self, number: int) -> Version:
        text = self.spark.read.text(f"{self.root}/_snapshots/{number:020d}.json", wholetext=True).first()
        try:
            body = json.loads(text[0])
            state = body["state"]
            if body["crc"] != _crc(state):
                raise CorruptSnapshotError(f"snapshot {number} fails its checksum")
            tiers = tuple(tuple(TableMeta(m["id"], m["path"], m["num_entries"], _unplain(m["first_key"]), _unplain(m["last_key"])) for m in t) for t in state["tiers"])
            return Version(tiers, state["next_seq"], state["next_table_id"], tuple((path, base) for path, base in state["pending"]))
        except (TypeError, KeyError, ValueError) as e:
            raise CorruptSnapshotError(f"snapshot {number} cannot be read") from e

    def _publish(self, version: Version) -> None:
        """Make a version current; CommitConflictError if its number is taken."""
        number = self.number + 1
        tiers = [[asdict(t) | {"first_key": _plain(t.first_key), "last_key": _plain(t.last_key)} for t in tier] for tier in version.tiers]
        state = {"tiers": tiers, "next_seq": version.next_seq, "next_table_id": version.next_table_id, "pending": [list(p) for p in version.pending]}
        text = json.dumps({"state": state, "crc": _crc(state)})
        if not self.storage.publish(f"_snapshots/{number:020d}.json", text.encode()):
            raise CommitConflictError(f"snapshot {number} exists")
        self.number, self.version = number, version

    # --- writes ---------------------------------------------------------------------

    def append(self, log: DataFrame) -> None:
        """Append log rows (key, seq, tag, value) with sequence numbers of their own.

        Rows may come late, but not so late that a merge has dropped a newer
        delete of their key: merges into the oldest tier forget deletes.
        Invalid rows fail the append before anything is published.
        """
        self._append(self._checked(log), own=True)

    def stage(self, log: DataFrame) -> None:
        """Write log rows without publishing them; commit() does, as often as it is tried."""
        self._write(self._checked(log), own=True)

    def _checked(self, log: DataFrame) -> DataFrame:
        return R.validate(log.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]))

    def put_many(self, rows: DataFrame, order_by: list[str] | None = None) -> None:
        """Upsert (key, value) rows; later rows of ``order_by`` win."""
        self._append(self._numbered(rows.select("key", "value", F.lit(R.PUT).alias("tag"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by or ())]), order_by))

    def delete_many(self, rows: DataFrame) -> None:
        """Delete keys; keys that are not there are legal."""
        value = F.lit(None).cast(self.schema["value"].dataType).alias("value")
        self._append(self._numbered(rows.select("key", value, F.lit(R.DELETE).alias("tag")), None))

    def put(self, key, value) -> None:
        self._one(key, R.PUT, value)

    def delete(self, key) -> None:
        self._one(key, R.DELETE, None)

    def _one(self, key, tag, value) -> None:
        if key is None or (tag == R.PUT and value is None):
            raise ValueError("a key and the value of a put must not be null")
        self._append(self.spark.createDataFrame([(key, 0, tag, value)], self.schema))

    def _numbered(self, rows: DataFrame, order_by: list[str] | None) -> DataFrame:
        order = [f"_o{i}" for i in range(len(order_by))] if order_by else ["key"]
        return self._checked(R.assign_seq(rows, order, 0))

    def _write(self, log: DataFrame, own: bool = False) -> Staged:
        path = f"log/{uuid.uuid4().hex}"
        self.storage.save(log.select(*self.schema.names), path)
        rows, top = self.spark.read.schema(self.schema).parquet(f"{self.root}/{path}").agg(F.count("*"), F.max("seq")).first()
        batch = Staged(path, None if own else rows, top or 0, self.storage.size(path))
        self._unpublished.append(batch)
        return batch

    def _append(self, log: DataFrame, own: bool = False) -> None:
        batch = self._write(log, own)
        mode = self.options.durability
        if mode is Durability.ALWAYS or (mode is Durability.GROUP_COMMIT and len(self._unpublished) >= self.options.group_batches):
            try:
                self.commit()
            except CommitConflictError:
                if batch in self._unpublished:
                    self._unpublished.remove(batch)  # the caller appends again after refresh()
                raise
        elif mode is Durability.BUFFERED and self._full(self._unpublished):
            self.flush()

    def _based(self, batches: list[Staged]) -> tuple[tuple[tuple[str, int | None], ...], int]:
        """The batches as they follow the pinned snapshot, each with its base, and the next sequence number."""
        out, after = [], self.version.next_seq
        for b in batches:
            out.append((b.path, None if b.rows is None else after))
            after = max(after, b.top + 1) if b.rows is None else after + b.rows
        return tuple(out), after

    def commit(self) -> None:
        """Publish the appended batches that no snapshot has yet, all in one.

        After a conflict they are kept: refresh() and commit() again.
        """
        if not self._unpublished:
            return
        new, after = self._based(self._unpublished)
        self._publish(Version(self.version.tiers, after, self.version.next_table_id, (*self.version.pending, *new)))
        self._unpublished.clear()
        if self._full([]):
            self.flush()

    def _full(self, staged: list[Staged]) -> bool:
        """Whether pending batches have grown to a table's size."""
        return sum(b.size for b in staged) + sum(self.storage.size(path) for path, _ in self.version.pending) >= self.options.flush_bytes

    def pending_bytes(self) -> int:
        """Accounted bytes of the pending batches, each key once."""
        batches = self._pending()
        if not batches:
            return 0
        size = lambda c: F.octet_length(F.col(c).cast("string")) if self.schema[c].dataType.typeName() not in ("binary", "string") else F.octet_length(c)
        total = R.resolve(self._read_log(batches)).agg(F.sum(size("key") + F.coalesce(size("value"), F.lit(0)) + 32)).first()[0]
        return int(total or 0)

    def _pending(self) -> list[tuple[str, int | None]]:
        """Published and own batches with their bases, in order."""
        return [*self.version.pending, *self._based(self._unpublished)[0]]

    def flush(self) -> None:
        """Write the pending batches as one table of tier 0, then merge full tiers."""
        if batches := self._pending():
            table = self._write_table(R.resolve(self._read_log(batches)))
            self._publish(self.version.with_flush(table, self._based(self._unpublished)[1]))
            self._unpublished.clear()
        self.compact()

    def compact(self) -> int:
        """Merge full tiers until none is left; the number of merges."""
        merges = 0
        while (tier := self.version.candidate(self.options.fanout)) is not None:
            self.merge_tier(tier)
            merges += 1
        return merges

    def merge_tier(self, tier: int) -> None:
        """Merge all tables of a tier into one of the next.

        Deletes go only if nothing older lies below, in the next tier neither.
        """
        rows = R.resolve(self._read_tables(self.version.tiers[tier]))
        if self.version.is_bottom(tier):
            rows = rows.where(R.is_put())
        self._publish(self.version.with_compaction(tier, self._write_table(rows)))

    def _write_table(self, rows: DataFrame) -> TableMeta | None:
        """A range-partitioned, sorted table with Parquet statistics; None if empty."""
        path = f"data/{uuid.uuid4().hex}"
        n = self.options.partitions
        spread = rows.repartitionByRange(n, "key") if n else rows.repartitionByRange("key")
        bloom = {"parquet.bloom.filter.enabled#key": "true"} if self.options.bloom else {}
        self.storage.save(spread.sortWithinPartitions("key"), path, **bloom)
        count, first, last = self.spark.read.schema(self.schema).parquet(f"{self.root}/{path}").agg(F.count("*"), F.min("key"), F.max("key")).first()
        return TableMeta(self.version.next_table_id, path, count, first, last) if count else None

    # --- reads -----------------------------------------------------------------------

    def _read_log(self, batches) -> DataFrame:
        """The rows of (path, base) files; a base is added to the numbers of its batch."""
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{path}" for path, _ in batches])
        bases = {path.rpartition("/")[2]: base for path, base in batches if base is not None}
        if not bases:
            return rows
        base = F.element_at(F.create_map(*[F.lit(x) for item in bases.items() for x in item]), F.regexp_extract("_metadata.file_path", r"/log/([0-9a-f]{32})/", 1))
        return rows.select("key", (F.col("seq") + F.coalesce(base, F.lit(0))).alias("seq"), "tag", "value")

    def _read_tables(self, tables) -> DataFrame:
        return self._read_log([(t.path, None) for t in tables])

    def log(self, r: Range | None = None) -> DataFrame:
        """All versions that the pinned snapshot holds, with tables outside the range left out."""
        r = r or Range()
        tables = [t for t in self.version.newest_first() if _meets(r, t)]
        return self._read_log([(t.path, None) for t in tables] + self._pending()).where(r.contains())

    def resolved(self, r: Range | None = None) -> DataFrame:
        """The newest version of every key of a range, deletes included.

        A table holds one version of a key.  Without pending batches, tables
        whose key ranges meet no other table's are read as they are, and only
        the rest goes through the shuffle of a resolution.
        """
        r = r or Range()
        tables = [t for t in self.version.newest_first() if _meets(r, t)]
        if self.version.pending or self._unpublished:
            return R.resolve(self.log(r))
        alone, rest = _split_overlapping(tables)
        if not rest:
            return self._read_tables(alone).where(r.contains())
        out = R.resolve(self._read_tables(rest).where(r.contains())).select(*self.schema.names)
        return out.unionByName(self._read_tables(alone).where(r.contains())) if alone else out

    def scan(self, lo=None, hi=None, lo_incl: bool = True, hi_incl: bool = False, ordered: bool = True) -> DataFrame:
        """Live (key, value) pairs of a range, ascending by key; crossed bounds give none."""
        rows = R.hide_deletes(self.resolved(Range(lo, hi, lo_incl, hi_incl))).select("key", "value")
        return rows.orderBy("key") if ordered else rows

    def get(self, key):
        """The value of a key, or None if it is absent or deleted."""
        row = R.hide_deletes(self.resolved(Range(key, key, True, True))).first()
        return row["value"] if row else None

    def multi_get(self, keys: DataFrame, key: str = "key", into: str = "value") -> DataFrame:
        """Every row of ``keys`` with the key's value, null where absent or deleted.

        The value goes ``into`` a new last column; a column of that name is
        replaced.  Catalyst pushes nothing of a join below the resolution, so
        versions of other keys go before it by a semi-join: a broadcast if the
        keys are few, else the shuffle that the resolution needs anyway.
        """
        if self.version.pending or self._unpublished or _split_overlapping(self.version.newest_first())[1]:
            found = R.live(self.log().join(keys.select(F.col(key).alias("key")), "key", "left_semi"))
        else:
            found = R.hide_deletes(self.resolved())
        found = found.select(F.struct("key", "value").alias("_found"))
        asked = keys.select(F.struct("*").alias("_row"))
        kept = [F.col(f"_row.`{c}`").alias(c) for c in keys.columns if c != into]
        return asked.join(found, F.col(f"_row.`{key}`") == F.col("_found.key"), "left").select(*kept, F.col("_found.value").alias(into))

    def as_of(self, seq: int) -> DataFrame:
        """Live pairs after the version ``seq``, as far as merges have kept older versions."""
        return R.live(R.as_of(self.log(), seq)).select("key", "value")

    def describe(self) -> DataFrame:
        """One row per table of the pinned snapshot."""
        key = self.schema["key"].dataType.simpleString()
        return self.spark.createDataFrame(self.version.rows(), f"tier int, pos int, id bigint, num_entries bigint, first_key {key}, last_key {key}")

    # --- files -----------------------------------------------------------------------

    def vacuum(self, keep_snapshots: int = 2, older_than_s: float = 3600.0) -> list[str]:
        """Drop old snapshots and every file that none of the kept refers to.

        Files younger than ``older_than_s`` stay: a commit may be under way.
        """
        known = self.snapshots()
        kept = [self._load(n) for n in known[-max(1, keep_snapshots) :]] + [self.version]
        used = {t.path for v in kept for t in v.newest_first()} | {path for v in kept for path, _ in v.pending} | {b.path for b in self._unpublished}
        for n in known[: -max(1, keep_snapshots)]:
            self.storage.delete(f"_snapshots/{n:020d}.json")
        gone = []
        for kind in ("data", "log"):
            for file, changed in self.storage.list(kind):
                name = f"{kind}/{file}"
                if name not in used and time.time() * 1000 - changed >= older_than_s * 1000:
                    self.storage.delete(name)
                    gone.append(name)
        return gone


def _meets(r: Range, t: TableMeta) -> bool:
    low = r.lo is None or (t.last_key >= r.lo if r.lo_incl else t.last_key > r.lo)
    high = r.hi is None or (t.first_key <= r.hi if r.hi_incl else t.first_key < r.hi)
    return low and high


def _split_overlapping(tables: list[TableMeta]) -> tuple[list[TableMeta], list[TableMeta]]:
    """Tables whose key ranges meet no other's, and the rest."""
    order = sorted(tables, key=lambda t: t.first_key)
    clusters: list[list[TableMeta]] = []
    last = None
    for t in order:
        if clusters and t.first_key <= last:
            clusters[-1].append(t)
            last = max(last, t.last_key)
        else:
            clusters.append([t])
            last = t.last_key
    return [c[0] for c in clusters if len(c) == 1], [t for c in clusters if len(c) > 1 for t in c]


def _crc(state: dict) -> int:
    return zlib.crc32(json.dumps(state, sort_keys=True).encode())
