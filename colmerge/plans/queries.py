"""The registered queries: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmerge.functions import addresses as A
from colmerge.functions import values as V
from colmerge.operators import delta as D
from colmerge.operators import metrics, notify, peers, resolve, stamping, state, views
from colmerge.operators.ordering import numbered
from colmerge.operators.replay import replay
from colmerge.plans.oracles import SQL
from colmerge.sources.shared import shared_folder, written
from colmerge.sources.statelog import StateLog
from colmerge.sources.tables import ADD_WINS, DELETE_WINS, ORDER_CELLS, TOMBSTONE, Registry, TableMeta, bootstrap_changelog, clog_events, clog_orders, from_wire, judged_lines, meta_put, table, to_wire, unpivoted
from colmerge.sources.versionlog import VersionLog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Version from which the delta queries start.
SINCE = 100
CELLS = ["signup", "view", "click", "purchase"]
USERS = TableMeta("user_state", "user_id", ("user_id", *CELLS), required=("signup", "view"))
REGISTRY = Registry(USERS, TableMeta("orders", "o_orderkey", ("o_orderkey", *ORDER_CELLS.values())))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


@query
def lww_winner(spark, d):
    return resolve.winners(clog_events(spark, d)).select("tbl", "pk", "cid", "val", "site_id", "col_version", "db_version")


@query
def lww_site_tiebreak(spark, d):
    return resolve.winners(clog_events(spark, d, coarse=True)).select("pk", "cid", "val", "site_id", "col_version")


@query
def tombstone_delete_wins(spark, d):
    return resolve.liveness(clog_events(spark, d), DELETE_WINS).select("pk", "mcv", "dcl", "alive")


@query
def tombstone_add_wins(spark, d):
    return resolve.liveness(clog_events(spark, d), ADD_WINS).select("pk", "mcv", "dcl", "alive")


@query
def orders_liveness(spark, d):
    return resolve.liveness(clog_orders(spark, d), REGISTRY.policy(F.col("tbl"))).select("pk", "mcv", "dcl", "alive")


@query
def cellwise_winner(spark, d):
    return resolve.cell_winners(clog_orders(spark, d)).select("pk", "cid", "val", "site_id", "col_version")


@query
def converged_cells(spark, d):
    return resolve.converged(clog_orders(spark, d), ADD_WINS).select("pk", "cid", "val", "site_id", "col_version")


@query
def materialize_rows(spark, d):
    return resolve.materialize(clog_events(spark, d), CELLS, DELETE_WINS).drop("tbl")


@query
def materialize_defaults(spark, d):
    """``plan`` is a column that no row has written."""
    defaults = {c: "0" for c in CELLS} | {"plan": "free"}
    return resolve.materialize(clog_events(spark, d), [*CELLS, "plan"], ADD_WINS, defaults).drop("tbl")


@query
def changes_since(spark, d):
    return D.changes_since(clog_events(spark, d), SINCE).select("pk", "cid", "val", "site_id", "col_version", *_long("seq"), "db_version")


@query
def changes_since_with_values(spark, d):
    """The log's own deletes leave cells without a row."""
    log = clog_orders(spark, d)
    gone = log.filter(F.col("cid") == TOMBSTONE).select(F.col("pk").cast("long").alias("o_orderkey"))
    rows = table(spark, d, "orders").join(gone, "o_orderkey", "left_anti")
    clock = D.changes_since(log, SINCE).drop("val")
    return D.with_values(clock, unpivoted(rows, "o_orderkey", ORDER_CELLS, "orders")).select("pk", "cid", "val", "site_id", "db_version")


@query
def apply_changeset(spark, d):
    log = clog_events(spark, d)
    return state.applied_cells(log.filter(F.col("db_version") <= SINCE), D.changes_since(log, SINCE)).select("pk", "cid", "val", "site_id", "col_version", "outcome")


@query
def apply_idempotent(spark, d):
    log = clog_events(spark, d).drop("event_id")
    delta = D.changes_since(log, SINCE)
    once = state.merge(log.filter(F.col("db_version") <= SINCE), delta)
    return resolve.winners(state.merge(once, delta)).select("pk", "cid", "val", "site_id", "col_version")


@query
def apply_compacted(spark, d):
    log = clog_events(spark, d).drop("event_id")
    return state.compact(state.merge(log, log), DELETE_WINS).select("pk", "cid", "val", "col_version")


@query
def local_write_stamping(spark, d):
    writes = table(spark, d, "events").filter("event_type <> 'error'").select("event_id", F.lit("user_state").alias("tbl"), F.col("user_id").cast("string").alias("pk"), F.col("event_type").alias("cid"))
    clock = writes.groupBy("tbl", "pk", "cid").agg(F.lit(5).cast("long").alias("col_version")).filter("pk % 2 = 0")
    return stamping.stamp_writes(writes, clock).select("event_id", "pk", "cid", "col_version", "db_version")


@query
def tombstone_stamping(spark, d):
    return stamping.stamp_deletes(clog_events(spark, d).select("tbl", "pk", "cid", "event_id")).select("event_id", "pk", "cl", "cleared")


@query
def deferred_insert(spark, d):
    """A third required cell is written by dear purchases only."""
    log = clog_events(spark, d)
    dear = (F.col("cid") == "purchase") & (F.col("val").cast("long") > 9000)
    log = log.withColumn("cid", F.when(dear, "premium").otherwise(F.col("cid")))
    return resolve.deferred(log, [*USERS.required, "premium"]).select("pk", "n_required", "complete")


def _dirty(spark, d):
    """The event log with unknown tables, unknown columns and key columns among its changes."""
    log = clog_events(spark, d)
    cid = F.when(F.col("cid") == TOMBSTONE, TOMBSTONE).when(F.col("event_id") % 10 == 0, "user_id").when(F.col("event_id") % 10 == 1, "colour").otherwise(F.col("cid"))
    return log.withColumn("cid", cid).withColumn("tbl", F.when(F.col("event_id") % 3 == 0, "elsewhere").otherwise(F.col("tbl")))


@query
def table_guard(spark, d):
    return _dirty(spark, d).filter(F.col("tbl").isin(list(REGISTRY.tables))).select("event_id", "tbl", "pk", "cid")


@query
def column_whitelist(spark, d):
    columns = F.broadcast(REGISTRY.columns(spark).select("tbl", "cid"))
    return _dirty(spark, d).join(columns, ["tbl", "cid"], "left_semi").select("event_id", "tbl", "pk", "cid")


@query
def pk_column_guard(spark, d):
    return resolve.valid(_dirty(spark, d), REGISTRY).select("event_id", "tbl", "pk", "cid")


@query
def conflict_cells(spark, d):
    return resolve.conflicts(clog_events(spark, d)).select("pk", "cid", "col_version", "n_sites", "winner", "val", "last")


@query
def row_clock_max(spark, d):
    return clog_events(spark, d).groupBy("pk").agg(F.max("col_version").alias("max_version"))


@query
def global_db_version(spark, d):
    return D.global_version(clog_events(spark, d), clog_orders(spark, d), stored=7)


@query
def version_vector(spark, d):
    return D.version_vector(clog_events(spark, d))


@query
def peer_lag(spark, d):
    """Each peer is some versions behind what it was told, and one hasn't heard of a site."""
    log = clog_events(spark, d)
    peer = F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string"))
    site = F.when((peer == "p1") & (F.col("site_id") == "s2"), "s1").otherwise(F.col("site_id"))
    told = log.select(peer.alias("peer_id"), site.alias("site_id"), (F.col("db_version") - F.col("event_id") % 7).alias("db_version"))
    return D.peer_lag(D.version_vector(log), told.groupBy("peer_id", "site_id").agg(F.max("db_version").alias("db_version")))


@query
def catch_up(spark, d):
    known = spark.createDataFrame([("p0", 0), ("p1", 100), ("p2", None), ("p3", 1_000_000)], "peer_id string, db_version long")
    return D.catch_up(clog_events(spark, d), known).select("peer_id", "pk", "cid", "val", "site_id", "db_version")


def _stored_log(spark, d) -> VersionLog:
    """The events' log in ranges of 64 versions, appended in three parts."""
    log, store = written(clog_events(spark, d).drop("event_id")), VersionLog(spark, shared_folder(spark), width=64)
    for k in range(3):
        store.append(log.filter(F.col("db_version") % 3 == k))
    return store


@query
def stored_changes_since(spark, d):
    return _stored_log(spark, d).since(SINCE).select("pk", "cid", "val", "site_id", "col_version", *_long("seq"), "db_version")


@query
def stored_catch_up(spark, d):
    known = spark.createDataFrame([("p1", 100), ("p2", 130), ("p3", 1_000_000)], "peer_id string, db_version long")
    return _stored_log(spark, d).catch_up(known).select("peer_id", "pk", "cid", "val", "site_id", "db_version")


@query
def peer_offsets(spark, d):
    log = clog_events(spark, d).withColumn("peer_id", F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")))
    told = lambda late: log.groupBy("peer_id").agg(F.max(F.col("db_version") - F.col("event_id") % late).alias("db_version"))
    return D.advanced(told(7), told(5))


@query
def offsets_reset(spark, d):
    log = clog_events(spark, d).withColumn("peer_id", F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string")))
    known = log.groupBy("peer_id").agg(F.max("db_version").alias("db_version"))
    return D.reset(known, spark.createDataFrame([("p1",), ("p4",), ("p4",)], "peer_id string"))


@query
def delta_order(spark, d):
    return D.in_order(D.changes_since(clog_orders(spark, d), SINCE)).select("place", "pk", "cid", "site_id", *_long("seq"), "db_version")


@query
def next_counter(spark, d):
    return D.next_version(clog_events(spark, d), clog_orders(spark, d), stored=7)


@query
def restamp_on_receive(spark, d):
    return D.received(clog_events(spark, d), clog_orders(spark, d)).select("pk", "cid", "val", "site_id", "col_version", "db_version")


@query
def apply_with_deletes(spark, d):
    log = clog_events(spark, d).drop("event_id")
    return state.applied(log.filter(F.col("db_version") <= SINCE), D.changes_since(log, SINCE), ADD_WINS).select("pk", "cid", "val", "site_id", "col_version")


@query
def write_filters(spark, d):
    """Writes to the library's own tables, to unknown ones and without a key among the others."""
    e = F.col("event_id")
    tbl = F.when(e % 9 == 0, "_colmerge_clock").when(e % 9 == 1, "elsewhere").otherwise("user_state")
    pk = F.when(e % 5 == 0, "").when(e % 5 == 1, F.lit(None).cast("string")).otherwise(F.col("user_id").cast("string"))
    return stamping.syncable(table(spark, d, "events").select("event_id", tbl.alias("tbl"), pk.alias("pk")), REGISTRY)


@query
def topic_filter(spark, d):
    told = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", told.alias("topic"))
    lenient, strict = V.same_topic(F.col("topic"), "click"), V.same_topic(F.col("topic"), "click", lenient=False)
    return rows.select("event_id", lenient.alias("lenient"), strict.alias("strict")).filter("lenient or strict")


@query
def wire_rejects(spark, d):
    """Every third line is cut, every fifth has no key, every seventh a version that is no number, every eleventh none at all."""
    log = to_wire(clog_orders(spark, d).withColumn("pk", F.when(F.col("db_version") % 5 != 0, F.col("pk"))))
    log = log.select(F.explode(F.array("value")).alias("value"))  # a line is made once, though it is looked at for each kind of damage
    k = F.col("k")
    lines = log.select("value", F.get_json_object("value", "$.db_version").cast("long").alias("k")).select(F.when(k % 3 == 0, F.concat(F.lit("~"), F.substring("value", 1, 9))).when(k % 7 == 0, F.regexp_replace("value", '"col_version":[0-9]+', '"col_version":"x"')).when(k % 11 == 0, F.regexp_replace("value", '"col_version":[0-9]+', '"col_version":null')).otherwise(F.col("value")).alias("value"))
    return judged_lines(lines).groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


@query
def changeset_pack(spark, d):
    packed = D.pack(clog_events(spark, d), 10)
    first, last = F.element_at("changes", 1)["db_version"], F.element_at("changes", -1)["db_version"]
    return packed.select("site_id", "changeset", F.size("changes").cast("long").alias("n_changes"), first.alias("first_version"), last.alias("last_version"))


@query
def changeset_unpack(spark, d):
    return D.unpack(D.pack(clog_events(spark, d), 10)).select("site_id", "db_version", "pk", "cid", "val", "col_version")


@query
def wire_round_trip(spark, d):
    return from_wire(to_wire(clog_orders(spark, d))).select("pk", "cid", "val", "site_id", "col_version", *_long("seq"), "db_version")


@query
def frames_round_trip(spark, d):
    """The log as frames of up to 500 changes, in files that are cut at 64 KiB, and back."""
    from colmerge.sources.frames import frame_lines, read_frames, to_frames, write_frames

    out = shared_folder(spark)
    write_frames(to_frames(clog_orders(spark, d), 500), out, split=1 << 16)
    return from_wire(frame_lines(read_frames(spark, out))).select("pk", "cid", "val", "site_id", "col_version", *_long("seq"), "db_version")


@query
def notifications(spark, d):
    log = clog_events(spark, d).drop("event_id")
    return notify.notifications(log.filter(F.col("db_version") <= SINCE), D.changes_since(log, SINCE), DELETE_WINS).select("pk", "kind", "changed_columns")


@query
def notification_filter_row(spark, d):
    log = clog_events(spark, d).drop("event_id")
    events = notify.notifications(log.filter(F.col("db_version") <= SINCE), D.changes_since(log, SINCE), DELETE_WINS)
    return notify.only(events, "user_state", "7").select("pk", "kind", "changed_columns")


@query
def reactive_table(spark, d):
    return notify.fold_view(clog_events(spark, d).withColumnRenamed("event_id", "position")).select("pk", "cid", "val")


@query
def reactive_row(spark, d):
    events = notify.only(clog_events(spark, d), "user_state", "3").withColumnRenamed("event_id", "position")
    return notify.fold_view(events).select("pk", "cid", "val")


@query
def point_lookup(spark, d):
    return views.point_lookup(table(spark, d, "orders"), "o_orderkey", 42).select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def row_exists(spark, d):
    wanted = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("o_orderkey", F.col("o_orderkey") * 2)
    return views.existing(wanted, table(spark, d, "orders"), "o_orderkey")


@query
def row_count(spark, d):
    return views.row_count(table(spark, d, "orders"))


@query
def fanout(spark, d):
    sets = clog_events(spark, d).select("site_id", F.floor(F.col("db_version") / 10).cast("long").alias("changeset")).distinct()
    rows = [("p0", "s0", False, False), ("p1", "s1", False, False), ("p2", "s2", True, False), ("p3", "s3", False, True), ("p4", "s4", False, False)]
    connected = spark.createDataFrame(rows, "peer_id string, site_id string, infrastructure boolean, rejected boolean")
    return D.fan_out(sets, connected)


def _peer_events(spark, d):
    """Events as what peers tell: the peer, its identity (none for some) and version, the topic that it is on, and an address."""
    e = F.col("event_id")
    peer = F.concat(F.lit("peer"), (F.col("user_id") % 20).cast("string"))
    start = F.element_at(
        F.array(
            F.concat(F.lit("/ip4/10.0."), (e % 200).cast("string"), F.lit(".1")),
            F.concat(F.lit("/ip4/192.168.0."), (e % 250).cast("string")),
            F.concat(F.lit("/ip4/172."), (e % 40).cast("string"), F.lit(".0.1")),
            F.concat(F.lit("/ip4/"), (e % 240).cast("string"), F.lit(".8.8.8")),
            F.concat(F.lit("/ip6/"), F.element_at(F.array(*map(F.lit, ["fe80::1", "fd00::5", "2001:db8::2", "::1", "ff02::1"])), (e % 5 + 1).cast("int"))),
            F.lit("/dns4/example.org"),
        ),
        (e % 6 + 1).cast("int"),
    )
    rest = F.concat(F.lit("/tcp/"), (4000 + e % 7).cast("string"), F.when(e % 2 == 0, "/ws").otherwise(""), F.when(e % 5 == 0, "/p2p/relay/p2p-circuit").otherwise(""), F.lit("/p2p/"), peer)
    identity = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("id"), (F.col("user_id") % 7).cast("string")))
    return table(spark, d, "events").select(e.alias("position"), peer.alias("peer_id"), identity.alias("identity"), F.col("event_type").alias("topic"), F.concat(start, rest).alias("address"), F.col("value"), "ts")


@query
def peer_version_latest(spark, d):
    events = _peer_events(spark, d).withColumn("db_version", F.col("position") * 3)
    return peers.latest(events, ["peer_id"], ["position"], ["db_version", "position"])


@query
def peers_by_identity(spark, d):
    return peers.by_identity(_peer_events(spark, d))


def _verdicts(spark, d):
    """Purchases over 90 verify their peer, errors over 95 reject every third one."""
    outcome = F.when((F.col("topic") == "purchase") & (F.col("value") > 90), "verified").when((F.col("topic") == "error") & (F.col("value") > 95) & (F.substring("peer_id", 5, 9).cast("int") % 3 == 0), "rejected")
    return peers.verification(_peer_events(spark, d).select("peer_id", outcome.alias("outcome")))


@query
def group_peers(spark, d):
    everyone = _peer_events(spark, d).select("peer_id").distinct()
    infrastructure = spark.createDataFrame([("peer1",), ("peer2",)], "peer_id string")
    return peers.group_members(everyone, infrastructure, _verdicts(spark, d).filter("rejected").select("peer_id"), "peer0")


@query
def peer_verification(spark, d):
    return _verdicts(spark, d)


@query
def identity_announced(spark, d):
    """Some announcements clear the peer's identity."""
    told = _peer_events(spark, d).select("peer_id", "position", F.when(F.col("position") % 4 != 0, F.col("identity")).otherwise(F.lit("")).alias("identity"))
    return peers.announced(told, _verdicts(spark, d))


def _dials(spark, d):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return _peer_events(spark, d).select("peer_id", F.col("topic").alias("address"), seconds.alias("at"), "position", (F.col("value") < 40).alias("ok"))


@query
def addr_cache_fold(spark, d):
    return peers.address_cache(_dials(spark, d)).select("peer_id", "address", *_long("last_ok_at", "last_try_at", "fail_count"))


#: A time inside the events' range, and a small cap, so that both sides of the test have rows.
NOW, AGE, FAILURES = 1_704_240_000, 86_400, 3


@query
def addr_load_recent(spark, d):
    rows = peers.address_cache(_dials(spark, d))
    return rows.filter(peers.usable(NOW, AGE, FAILURES)).select("peer_id", "address", *_long("last_ok_at", "fail_count"))


@query
def addr_gc(spark, d):
    rows = peers.address_cache(_dials(spark, d))
    return rows.filter(~peers.usable(NOW, AGE, FAILURES)).select("peer_id", "address", *_long("last_ok_at", "fail_count"))


@query
def addr_classify(spark, d):
    a = F.col("address")
    peer = F.when(F.col("position") % 4 == 0, "other").otherwise(F.col("peer_id"))
    return _peer_events(spark, d).select("position", A.address_class(a).alias("class"), A.tcp_port(a).cast("long").alias("port"), A.last_peer(a).alias("last_peer"), A.with_peer(a, peer).alias("with_peer"))


@query
def addr_newest_first(spark, d):
    rows = peers.address_cache(_dials(spark, d))
    return peers.newest_first(rows.filter(peers.usable(NOW, AGE, FAILURES))).select("peer_id", "address", *_long("last_ok_at"), "place")


@query
def addr_rank(spark, d):
    return peers.offered_addresses(_peer_events(spark, d)).select("peer_id", "address", "tier", "place")


@query
def addr_best_per_peer(spark, d):
    return peers.best_address(_peer_events(spark, d))


@query
def addr_last8(spark, d):
    return peers.recent_addresses(_peer_events(spark, d)).select("peer_id", "position", "age")


@query
def addr_by_peer(spark, d):
    return peers.addresses_by_peer(_peer_events(spark, d)).select("peer_id", "n", F.array_join("addresses", ",").alias("addresses"))


@query
def addr_snapshot_replace(spark, d):
    snapshots = _peer_events(spark, d).select("peer_id", "position", F.array(F.col("address"), F.concat("address", F.lit("/x"))).alias("addresses"))
    return peers.replaced(snapshots)


@query
def peer_counts(spark, d):
    return _peer_events(spark, d).agg(F.countDistinct("peer_id").alias("peers"), F.countDistinct(F.when(F.col("identity").isNotNull(), F.col("peer_id"))).alias("known"), F.countDistinct("topic").alias("topics"))


@query
def presence_intro(spark, d):
    """Events of low value are departures, the others announcements."""
    events = _peer_events(spark, d)
    return peers.introductions(events.filter("value >= 30"), events.filter("value < 30"))


@query
def presence_members(spark, d):
    return peers.present(_peer_events(spark, d).withColumn("connected", F.col("position") % 3 != 0))


def _tokens(spark, d):
    e = _peer_events(spark, d)
    token = F.concat(F.lit("tok"), (F.col("position") % 50).cast("string"))
    known = e.select("topic", token.alias("token"), "position", F.when(F.col("position") % 2 == 0, "fcm").otherwise("apns").alias("platform"), "peer_id")
    return peers.live_tokens(known, spark.createDataFrame([("tok7",), ("tok13",)], "token string"))


@query
def token_registry(spark, d):
    return _tokens(spark, d)


@query
def token_fanout(spark, d):
    notified = spark.createDataFrame([("click", "peer1"), ("view", "peer3")], "topic string, sender string")
    return peers.fan_out_tokens(notified, _tokens(spark, d)).select("topic", "token", "platform", "peer_id")


@query
def network_status(spark, d):
    e = _peer_events(spark, d)
    told = e.groupBy("peer_id").agg(F.max("position").alias("told_version"))
    versions = peers.latest(e.filter("topic = 'signup'").withColumn("db_version", F.col("position") * 2), ["peer_id"], ["position"], ["db_version"])
    identities = peers.latest(e.filter("identity is not null"), ["peer_id"], ["position"], ["identity"])
    verified = e.filter("topic = 'purchase' and value > 90").select("peer_id").distinct()
    return peers.status(told, versions, identities, verified)


@query
def diagnostics_counters(spark, d):
    return metrics.counters(table(spark, d, "events"), ["signup", "view", "click", "purchase", "error"])


def _runs(spark, d):
    kind = F.when(F.col("value") > 90, "peer_synced").when(F.col("value") > 60, "peer_connected").otherwise("other")
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 20).cast("long").alias("run_id"), kind.alias("event_type"), F.col("event_id").alias("at"))


@query
def sync_outcome(spark, d):
    return metrics.sync_outcome(_runs(spark, d))


@query
def sync_outcome_in_time(spark, d):
    """With two events' time after the first sync, and twelve in all."""
    return metrics.sync_outcome(_runs(spark, d), grace=2, timeout=12)


@query
def latency_percentiles(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    return metrics.percentiles(table(spark, d, "events").withColumn("cents", cents), F.col("cents"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])


@query
def latency_rank_percentiles(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    return metrics.rank_percentiles(table(spark, d, "events").withColumn("cents", cents), "cents", {"p50": 50, "p95": 95}, ["event_type"])


@query
def literal_to_json(spark, d):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 6 == 0, "NULL").when(k % 6 == 1, F.concat(F.lit("'it''s "), "o_orderpriority", F.lit("'"))).when(k % 6 == 2, F.col("o_custkey").cast("string"))
        .when(k % 6 == 3, "TRUE").when(k % 6 == 4, F.concat(F.lit("-"), k.cast("string"), F.lit(".50"))).otherwise(F.concat(F.lit("x'"), F.lower(F.hex(k)), F.lit("'")))
    )
    return table(spark, d, "orders").select("o_orderkey", V.literal_to_json(text).alias("json"), V.bound_value(V.literal_to_json(text)).alias("bound"))


@query
def sql_write_classify(spark, d):
    k = F.col("o_orderkey")
    sql = (
        F.when(k % 4 == 0, F.concat(F.lit("INSERT INTO \"orders\" (id) VALUES ("), k.cast("string"), F.lit(") RETURNING id")))
        .when(k % 4 == 1, F.concat(F.lit("  update tasks SET done = 1 WHERE id = "), k.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("DELETE FROM `notes` WHERE id = "), k.cast("string")))
        .otherwise(F.lit("REPLACE INTO orders VALUES (1)"))
    )
    return table(spark, d, "orders").select("o_orderkey", V.write_kind(sql).alias("kind"), V.write_table(sql).alias("tbl"), F.length(V.without_returning(sql)).cast("long").alias("n"))


@query
def message_mac(spark, d):
    message = F.concat_ws(":", "o_orderkey", "o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", V.mac("passphrase", message).alias("mac"))


@query
def message_verified(spark, d):
    """Every third tag is of another message."""
    message = F.concat_ws(":", "o_orderkey", "o_orderstatus")
    tag = V.mac("passphrase", F.when(F.col("o_orderkey") % 3 == 0, F.concat(message, F.lit("!"))).otherwise(message))
    return table(spark, d, "orders").select("o_orderkey", V.verified("passphrase", message, tag).alias("verified"))


@query
def topics(spark, d):
    return table(spark, d, "events").select("event_type").distinct().select("event_type", V.topic("passphrase", F.col("event_type")).alias("topic"))


@query
def names_and_ids(spark, d):
    name = F.concat(F.lit("my-"), "event_type", F.lit("::*"))
    return table(spark, d, "events").select("event_id", V.hex_id(F.col("props").cast("binary")).alias("id"), V.module_prefix(name).alias("prefix"))


@query
def key_round_trip(spark, d):
    pk = F.concat("o_orderpriority", F.lit("|"), F.col("o_orderkey").cast("string"))
    key = V.split_key(V.cell_key(F.lit("orders"), pk, F.lit("status")))
    return table(spark, d, "orders").select("o_orderkey", key["tbl"].alias("tbl"), key["pk"].alias("pk"), key["cid"].alias("cid"))


@query
def push_debounce(spark, d):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return peers.debounce(table(spark, d, "events").select(F.col("event_type").alias("topic"), seconds.alias("at"), F.col("event_id").alias("position")), 3600)


@query
def soft_delete_view(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("deleted"), F.col("o_orderdate").alias("created_at"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)")
    return views.newest_first(views.without_soft_deleted(rows), seconds, "o_orderkey").select("place", "o_orderkey", "o_totalprice", "created_at")


@query
def rows_by_key(spark, d):
    return views.by_key(resolve.materialize(clog_events(spark, d), CELLS, ADD_WINS)).select("place", "pk", "signup")


@query
def bootstrap(spark, d):
    log = bootstrap_changelog(table(spark, d, "orders"), "o_orderkey", ORDER_CELLS, "orders", "a", F.col("o_orderkey"))
    return log.select("pk", "cid", "val", "col_version", *_long("seq"), "db_version")


@query
def gapless_numbering(spark, d):
    return numbered(table(spark, d, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("line"), "l_returnflag"), ["l_returnflag"], "line", "n")


@query
def state_as_of(spark, d):
    return state.as_of(clog_events(spark, d), SINCE).select("pk", "cid", "val", "site_id", "col_version")


@query
def passthrough_join_agg(spark, d):
    return views.passthrough(spark, d, SQL["passthrough_join_agg"], ["region", "nation", "customer", "orders", "lineitem"])


@query
def passthrough_rollup(spark, d):
    return views.passthrough(spark, d, SQL["passthrough_rollup"], ["lineitem"])


@query
def passthrough_window(spark, d):
    return views.passthrough(spark, d, SQL["passthrough_window"], ["orders"])


@query
def replay_fold(spark, d):
    """Batches of four events; a row is made when a batch has its sign-up, as views have a default."""
    users = TableMeta("user_state", "user_id", ("user_id", *CELLS), required=("signup", "view"), defaults={"view": "0"})
    log = clog_events(spark, d).withColumn("arrival", F.floor(F.col("event_id") / 4))
    return replay(log, Registry(users)).select("pk", "cid", "val", "col_version", "site_id")


@query
def meta_upsert(spark, d):
    meta = table(spark, d, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return meta_put(meta_put(meta, "ASIA", "changed"), "NOWHERE", "new")


@query
def database_paths(spark, d):
    k = F.col("o_orderkey").cast("string")
    url = F.when(F.col("o_orderkey") % 3 == 0, "sqlite::memory:").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("sqlite:///data/"), k, F.lit(".db?mode=rwc"))).otherwise(F.concat(F.lit("sqlite://"), k, F.lit(".db")))
    return table(spark, d, "orders").select("o_orderkey", V.database_path(url).alias("path"))


def _streamed(spark, d):
    """The events' file as a stream of changes with few versions and values, so that versions and values tie, and deletes."""
    from colmerge.streaming.live import EVENTS, read_files

    e, dead = F.col("event_id"), F.col("event_type") == "error"
    version = e % 5 + 1
    return read_files(spark, d, "events.parquet", EVENTS).select(
        F.lit("user_state").alias("tbl"), F.col("user_id").cast("string").alias("pk"), F.when(dead, TOMBSTONE).otherwise(F.col("event_type")).alias("cid"),
        F.when(~dead, F.floor(F.col("value") / 40).cast("long").cast("string")).alias("val"), F.concat(F.lit("s"), (e % 3).cast("string")).alias("site_id"),
        version.alias("col_version"), version.alias("cl"), F.lit(0).alias("seq"), e.alias("db_version"),
    )


@query
def stream_lww(spark, d):
    """The cells of living rows of the state that a stream folds, in one run over what is there."""
    from colmerge.streaming.live import stream_state

    out = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    run = stream_state(_streamed(spark, d)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start()
    run.awaitTermination()
    return resolve.converged(spark.read.parquet(f"{out}/state"), ADD_WINS).select("pk", "cid", "val", "site_id", "col_version")


@query
def stream_notifications(spark, d):
    """What a stream of changes tells on top of the state of the first versions: one event for each row that it changes; beside it, all that came."""
    from colmerge.streaming.live import apply_stream, told

    out, log = shared_folder(spark), written(clog_events(spark, d).drop("event_id"))
    log.filter(F.col("db_version") > SINCE).write.parquet(f"{out}/in")
    store = _log_of_levels(spark, log.filter(F.col("db_version") <= SINCE), f"{out}/store")
    apply_stream(spark.readStream.schema(log.schema).parquet(f"{out}/in"), store, f"{out}/told", f"{out}/offsets", DELETE_WINS, raw=f"{out}/raw")
    raw = told(store, f"{out}/raw").groupBy("pk").agg(F.count("*").alias("n_raw"))
    return told(store, f"{out}/told").join(raw, "pk").select("pk", "kind", "changed_columns", "n_raw")


def _log_of_levels(spark, log: DataFrame, path: str) -> StateLog:
    """A log of state that came in eleven batches, with levels so small that it has several."""
    store, log = StateLog(spark, path, ratio=3, least=16, bucket_rows=64), written(log)
    for k in range(11):
        store.commit(log.filter(F.col("db_version") % 11 == k))
        store.fold()
    return store


@query
def state_log(spark, d):
    """The state of a log that came in batches and was folded in part, against the whole log's."""
    store = _log_of_levels(spark, clog_events(spark, d), shared_folder(spark))
    return store.read().select("pk", "cid", "val", "site_id", "col_version")


@query
def stream_event_counts(spark, d):
    """The stream of events counted by kind and day, with a watermark."""
    from colmerge.streaming.live import EVENTS, read_files, windowed_counts

    out = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumnRenamed("starts", "day").write.mode("overwrite").parquet(f"{out}/counts")

    run = windowed_counts(read_files(spark, d, "events.parquet", EVENTS), "1 day", "1 day").writeStream.outputMode("complete").foreachBatch(keep)
    run.option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/counts")


def _by_slices(spark, rows: DataFrame, at: str, fold: Callable[[DataFrame], DataFrame], out: str, n: int = 3) -> DataFrame:
    """All that ``fold`` of a stream in append mode gives: rows come in slices of time, each in as many files as it is written by tasks and followed when it is there,
    and at last one row long after all others, which lets the watermark pass them."""
    bounds = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    width = (bounds["high"] - bounds["low"]).total_seconds() / n + 1
    seconds = F.unix_micros(at) / 1_000_000 - F.unix_micros(F.lit(bounds["low"])) / 1_000_000
    end = rows.limit(1).withColumn(at, F.lit(bounds["high"]) + F.expr("INTERVAL 900 DAYS")).withColumn("position", F.lit(-1).cast("long"))
    for part in [*(rows.filter(F.floor(seconds / width) == k) for k in range(n)), end]:
        part.write.mode("append").parquet(f"{out}/in")
        told = fold(spark.readStream.schema(rows.schema).parquet(f"{out}/in"))
        run = told.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{out}/rows")


@query
def stream_debounce(spark, d):
    """Debounced pushes of a stream, by the events' times."""
    from colmerge.streaming.live import debounced_by_time

    out = shared_folder(spark)
    at = F.timestamp_seconds(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    rows = table(spark, d, "events").select(F.col("event_type").alias("topic"), at.alias("at"), F.col("event_id").alias("position"))
    pushes = _by_slices(spark, rows, "at", lambda stream: debounced_by_time(stream, 3_600_000, "1 hour"), out)
    return pushes.filter("position >= 0").select("topic", (F.col("fired_at") / 1000).cast("long").alias("fired_at"), "edge", "position")


@query
def stream_sync_outcome(spark, d):
    """Outcomes of runs as a stream tells them, an event a second; from the second day on, as a stream begins with a watermark at time 0."""
    from colmerge.streaming.live import outcomes_by_time

    out = shared_folder(spark)
    rows = _runs(spark, d).select("run_id", "event_type", F.timestamp_seconds(F.col("at") + 86_400).alias("at"), F.col("at").cast("long").alias("position"))
    return _by_slices(spark, rows, "at", lambda stream: outcomes_by_time(stream, 2000, 12_000, "1 minute"), out)


@query
def stream_view_from_snapshot(spark, d):
    """A view that loads the cells of the first half of the events and follows the second."""
    from colmerge.streaming.live import reactive_view

    out = shared_folder(spark)
    events = written(clog_events(spark, d).select("tbl", "pk", "cid", "val", F.col("event_id").alias("position")))
    half = events.count() // 2
    first, rest = events.filter(F.col("position") < half), events.filter(F.col("position") >= half)
    last = first.groupBy("tbl", "pk", "cid").agg(F.max_by("val", "position").alias("val"), F.max("position").alias("position"))
    start = written(notify.fold_view(first).drop("val").join(last, ["tbl", "pk", "cid"]))
    for k in range(2):
        rest.filter(F.col("position") % 2 == k).write.mode("append").parquet(f"{out}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/view/batch={number}")

    view = reactive_view(spark.readStream.schema(events.schema).parquet(f"{out}/in"), start)
    view.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{out}/view")
    newest = told.groupBy("tbl", "pk").agg(F.max("batch").alias("batch"))
    followed = told.join(newest, ["tbl", "pk", "batch"]).filter(F.col("cid") != TOMBSTONE)
    return followed.select("pk", "cid", "val").unionByName(start.join(newest, ["tbl", "pk"], "left_anti").select("pk", "cid", "val"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in QUERIES}
