"""Tables, the registry of synced tables, change logs derived from tables, snapshots, and the JSON wire format."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmerge.operators.ordering import numbered

#: The change log: one row per changed cell. ``cid`` is ``TOMBSTONE`` for a deleted row; ``val`` is JSON text or null.
CHANGELOG = T.StructType([T.StructField(name, T.StringType()) for name in ("tbl", "pk", "cid", "val", "site_id")])
CHANGELOG.add("col_version", "long").add("cl", "long").add("seq", "integer").add("db_version", "long")
TOMBSTONE = "__deleted"
DELETE_WINS, ADD_WINS = "DeleteWins", "AddWins"


@dataclass(frozen=True)
class TableMeta:
    """A synced table: one key column, its columns, those that must be there, defaults, and what a tie with a delete does."""

    name: str
    pk: str
    columns: tuple[str, ...]
    required: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    policy: str = DELETE_WINS

    def __post_init__(self):
        if not self.name or self.pk not in self.columns:
            raise ValueError("a synced table needs a name, and a key that is one of its columns")
        if self.policy not in (DELETE_WINS, ADD_WINS):
            raise ValueError(f"unknown delete policy {self.policy}")


class Registry:
    """The synced tables. Its rows are as many as the schema has columns, so a broadcast of it is bounded by the schema."""

    def __init__(self, *tables: TableMeta):
        self.tables = {t.name: t for t in tables}

    def columns(self, spark: SparkSession) -> DataFrame:
        """(tbl, cid, is_pk) for each registered column."""
        rows = [(t.name, c, c == t.pk) for t in self.tables.values() for c in t.columns]
        return spark.createDataFrame(rows, "tbl string, cid string, is_pk boolean")

    def policy(self, tbl: Column) -> Column:
        """The delete policy of a table, ``DeleteWins`` if it isn't registered."""
        out = F.lit(DELETE_WINS)
        for t in self.tables.values():
            out = F.when(tbl == t.name, t.policy).otherwise(out)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temporary views, for SQL that passes through to Spark."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def synced_tables(spark: SparkSession, suffix: str = "_clock") -> list[str]:
    """Tables of the catalog that have a clock table beside them."""
    names = {t.name for t in spark.catalog.listTables()}
    return sorted(n.removesuffix(suffix) for n in names if n.endswith(suffix))


def create_if_missing(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """An empty managed table, unless there is one."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)


def clog_events(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """The events as a change log of four sites: a user is a row, an event type a column, an error a delete. Adds ``event_id``."""
    value = F.floor(F.col("value") / 20) if coarse else F.round(F.col("value") * 100)
    deletes = F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.lit("user_state").alias("tbl"),
        F.col("user_id").cast("string").alias("pk"),
        F.when(deletes, TOMBSTONE).otherwise(F.col("event_type")).alias("cid"),
        F.when(~deletes, value.cast("long").cast("string")).alias("val"),
        F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("site_id"),
    )
    cell = Window.partitionBy("site_id", "pk", "cid").orderBy("event_id")
    row = Window.partitionBy("site_id", "pk").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("__v", F.when(F.col("cid") != TOMBSTONE, F.row_number().over(cell)))
    e = e.withColumn("col_version", F.coalesce("__v", 1 + F.coalesce(F.max("__v").over(row), F.lit(0))).cast("long")).drop("__v")
    e = numbered(e, ["site_id"], "event_id", "db_version")
    return e.select("tbl", "pk", "cid", "val", "site_id", "col_version", F.col("col_version").alias("cl"), F.lit(0).alias("seq"), "db_version", "event_id")


def unpivoted(rows: DataFrame, pk: str, columns: dict[str, str], tbl: str) -> DataFrame:
    """(tbl, pk, cid, val, seq): a row per cell; ``columns`` maps columns of ``rows`` to cell names."""
    cells = F.array(*[F.struct(F.lit(name).alias("cid"), F.col(c).cast("string").alias("val"), F.lit(k).alias("seq")) for k, (c, name) in enumerate(columns.items())])
    return rows.select(F.lit(tbl).alias("tbl"), F.col(pk).cast("string").alias("pk"), F.inline(cells))


ORDER_CELLS = {"o_orderstatus": "status", "o_orderpriority": "priority", "o_custkey": "cust"}


def bootstrap_changelog(rows: DataFrame, pk: str, columns: dict[str, str], tbl: str, site: str, version: Column) -> DataFrame:
    """Existing rows as version-1 cells of one site, so that rows older than their registration are shipped too."""
    keyed = rows.withColumn("__version", version)
    cells = F.array(*[F.struct(F.lit(name).alias("cid"), F.col(c).cast("string").alias("val"), F.lit(k).alias("seq")) for k, (c, name) in enumerate(columns.items())])
    one = F.lit(1).cast("long")
    return keyed.select(F.lit(tbl).alias("tbl"), F.col(pk).cast("string").alias("pk"), F.inline(cells), F.col("__version").cast("long").alias("db_version")).select(
        "tbl", "pk", "cid", "val", F.lit(site).alias("site_id"), one.alias("col_version"), one.alias("cl"), "seq", "db_version"
    )


def clog_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as version 1 of site a, with later and conflicting edits and deletes of site b."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    first = bootstrap_changelog(orders, "o_orderkey", ORDER_CELLS, "orders", "a", key)
    edit = F.struct(F.lit("status").alias("cid"), F.concat("o_orderstatus", F.lit("-b2")).alias("val"), F.lit(2).alias("version"), F.lit(0).alias("seq"))
    tie = F.struct(F.lit("priority").alias("cid"), F.concat(F.lit("A"), "o_orderpriority").alias("val"), F.lit(1).alias("version"), F.lit(1).alias("seq"))
    gone = F.struct(F.lit(TOMBSTONE).alias("cid"), F.lit(None).cast("string").alias("val"), F.lit(2).alias("version"), F.lit(3).alias("seq"))
    edits = F.filter(F.array(F.when(key % 3 == 0, edit), F.when(key % 5 == 0, tie), F.when(key % 11 == 0, gone)), lambda x: x.isNotNull())
    second = orders.select(key.alias("db_version"), F.lit("orders").alias("tbl"), key.cast("string").alias("pk"), F.inline(edits)).select(
        "tbl", "pk", "cid", "val", F.lit("b").alias("site_id"), F.col("version").cast("long").alias("col_version"), F.col("version").cast("long").alias("cl"), "seq", F.col("db_version").cast("long").alias("db_version")
    )
    return first.unionByName(second)


def to_wire(changes: DataFrame) -> DataFrame:
    """(value): each change as one line of JSON, null fields included."""
    return changes.select(F.to_json(F.struct(*[c.name for c in CHANGELOG]), {"ignoreNullFields": "false"}).alias("value"))


#: What a line is read as: a change, and the line itself if a field of it can't be read.
WIRE = T.StructType([*CHANGELOG.fields, T.StructField("__unread", T.StringType())])
_NEEDED = ("tbl", "pk", "cid", "site_id", "col_version", "db_version")


def _read(value: str = "value") -> Column:
    return F.from_json(value, WIRE, {"columnNameOfCorruptRecord": "__unread"})


def _whole(change: Column) -> Column:
    """Whether a change has all that it needs, and nothing in it was unreadable."""
    return change.isNotNull() & change["__unread"].isNull() & reduce(and_, [change[name].isNotNull() for name in _NEEDED])


def from_wire(lines: DataFrame) -> DataFrame:
    """Changes from lines of JSON. Lines that are none are not lost: ``rejected_lines`` has them."""
    # an unfolded column isn't computed again where it is tested
    parsed = lines.select(F.explode(F.array(_read())).alias("__change"))
    return parsed.filter(_whole(F.col("__change"))).select("__change.*").drop("__unread")


def judged_lines(lines: DataFrame) -> DataFrame:
    """(value, change, reason) of each line: the reason is null for a change, else that of ``rejected_lines``. Each line is made and parsed once."""
    change = F.col("change")
    once = lines.select(F.explode(F.array("value")).alias("value"))
    # what doesn't begin as an object is none; parsing it would cost an exception
    begins = F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("{"))
    parsed = once.select("value", F.explode(F.array(F.when(begins, _read()))).alias("change"))
    unkeyed = change["tbl"].isNull() | change["pk"].isNull() | change["cid"].isNull()
    none = change.isNull() | (change["__unread"].isNotNull() & ~F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False)))
    reason = F.when(_whole(change), F.lit(None).cast("string")).when(F.col("value").isNull(), "empty").when(none, "no object")
    return parsed.select("value", "change", reason.when(change["__unread"].isNotNull(), "unreadable").when(unkeyed, "no key").otherwise("no version").alias("reason"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(value, reason): lines that are no changes: no JSON object, one with a field that can't be read, or without a table, key or column, or without site or versions."""
    return judged_lines(lines).filter("reason is not null").select("value", "reason")


class SnapshotStore:
    """State (with ``tbl`` and ``pk``) in parts by a hash of its rows' keys, and pointers that name the folder of each part.

    A write makes new folders only for the parts that it names, then one new pointer. Nothing is overwritten, no number and no folder is used
    twice, and the largest pointer that was written to its end counts: whenever a write breaks off, a reader sees the state of before.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def part(self) -> Column:
        """The part of a row."""
        return F.pmod(F.xxhash64("tbl", "pk"), F.lit(self.parts)).cast("int")

    def _files(self, pattern: str) -> list:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        self._system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath() for x in self._system.globStatus(folder) or []]

    def _pointer(self) -> dict | None:
        """The last complete pointer: the marker of success is written when all else is there."""
        done = sorted(p.getParent().getName() for p in self._files("pointer-*/_SUCCESS"))
        return json.loads(self.spark.read.text(f"{self.path}/{done[-1]}").first()["value"]) if done else None

    def current(self) -> int | None:
        pointer = self._pointer()
        return pointer and pointer["snapshot"]

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """The state, or some parts of it; None before the first write."""
        pointer = self._pointer()
        if pointer is None:
            return None
        schema = T.StructType.fromJson(pointer["schema"])
        folders = [f"{self.path}/{folder}/__part={k}" for k, folder in pointer["parts"].items() if parts is None or int(k) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, state: DataFrame, parts: list[int] | None = None) -> int:
        """Puts ``state`` in the place of all parts, or of those named; its rows must lie in them. Returns the snapshot's number."""
        before = self._pointer() or {"snapshot": -1, "parts": {}}
        folder = f"data-{uuid.uuid4().hex}"
        # dealt out by part, and a large part again to several tasks
        state.withColumn("__part", self.part()).hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{self.path}/{folder}")
        kept = {k: f for k, f in before["parts"].items() if parts is not None and int(k) not in parts}
        new = {p.getName().removeprefix("__part="): folder for p in self._files(f"{folder}/__part=*")}
        number = before["snapshot"] + 1
        line = json.dumps({"snapshot": number, "schema": json.loads(state.schema.json()), "parts": kept | new})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.path}/pointer-{number:012d}-{uuid.uuid4().hex}")
        return number

    def vacuum(self) -> None:
        """Deletes pointers but the current one and the one before, and folders that neither names. No reader of an older state may be left."""
        done = sorted(self._files("pointer-*/_SUCCESS"), key=lambda p: p.getParent().getName())
        kept = [p.getParent() for p in done[-2:]]
        named = {f for p in kept for f in json.loads(self.spark.read.text(p.toString()).first()["value"])["parts"].values()}
        for p in self._files("pointer-*") + self._files("data-*"):
            if p.getName() not in named | {k.getName() for k in kept}:
                self._system.delete(p, True)


def meta_put(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The key/value table with one key set."""
    new = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return meta.filter(F.col("key") != key).unionByName(new)
