"""Peers: versions, identities, address cache, presence, push tokens, status. Event tables in, latest states out.

"Latest per key" is an aggregation of a struct led by the time, so a hot key is combined in the tasks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmerge.functions.addresses import address_score, last_peer, tier
from colmerge.operators.intervals import intervals_at
from colmerge.operators.ordering import numbered, scanned

#: Age in seconds and failures beyond which a cached address isn't used, and addresses that a peer keeps.
MAX_AGE, MAX_FAILURES, KEPT_ADDRESSES = 7 * 86_400, 10, 8
#: Cooldowns in a range of time in which pauses are looked for at once.
COOLDOWNS = 1024


def latest(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key."""
    return events.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("l")).select(*keys, *[f"l.{v}" for v in values])


def by_identity(peers: DataFrame) -> DataFrame:
    """(identity, n_peers, peers): peers of each identity, sorted; peers without one are left out."""
    known = peers.filter(F.col("identity").isNotNull()).select("identity", "peer_id").distinct()
    return known.groupBy("identity").agg(F.count("*").alias("n_peers"), F.array_join(F.array_sort(F.collect_list("peer_id")), ",").alias("peers"))


def group_members(peers: DataFrame, infrastructure: DataFrame, rejected: DataFrame, me: str) -> DataFrame:
    """Peers that are neither infrastructure, nor ever rejected, nor oneself."""
    return peers.filter(F.col("peer_id") != me).join(infrastructure, "peer_id", "left_anti").join(rejected, "peer_id", "left_anti")


def verification(events: DataFrame) -> DataFrame:
    """(peer_id, verified, rejected) of events (peer_id, outcome: verified or rejected, in any order): who was ever rejected stays so, and isn't verified."""
    told = events.groupBy("peer_id").agg(F.count_if(F.col("outcome") == "verified").alias("v"), F.count_if(F.col("outcome") == "rejected").alias("r"))
    return told.select("peer_id", ((F.col("v") > 0) & (F.col("r") == 0)).alias("verified"), (F.col("r") > 0).alias("rejected"))


def announced(announcements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(peer_id, identity): the last identity that each verified peer announced (peer_id, position, identity); an empty or null one clears it.

    ``verdicts`` as ``verification`` gives them: others are not listened to.
    """
    heard = announcements.join(verdicts.filter("verified").select("peer_id"), "peer_id", "left_semi")
    return latest(heard, ["peer_id"], ["position"], ["identity"]).filter("identity is not null and identity <> ''")


def address_cache(dials: DataFrame) -> DataFrame:
    """(peer_id, address, last_ok_at, last_try_at, fail_count) of dials (peer_id, address, at, position, ok).

    A success makes the entry and clears its failures; failures of an address that never succeeded make none.
    """
    keys = ["peer_id", "address"]
    ok = dials.filter("ok").groupBy(*keys).agg(F.max("position").alias("ok_position"), F.max("at").alias("last_ok_at"))
    rows = dials.join(ok, keys)
    return rows.groupBy(*keys, "last_ok_at").agg(F.max("at").alias("last_try_at"), F.count_if(~F.col("ok") & (F.col("position") > F.col("ok_position"))).alias("fail_count"))


def usable(now: Column | int, max_age: int = MAX_AGE, max_failures: int = MAX_FAILURES) -> Column:
    """Whether a cached address may be dialled at ``now``; those for which it is false are collected as garbage."""
    return (F.col("last_ok_at") >= F.lit(now) - max_age) & (F.col("fail_count") < max_failures)


def newest_first(cache: DataFrame) -> DataFrame:
    """Cached addresses with ``place``: each peer's by the time of the last success, newest first, then by address."""
    return numbered(cache.withColumn("__ago", -F.col("last_ok_at")), ["peer_id"], ["__ago", "address"], "place").drop("__ago")


def best_address(addresses: DataFrame) -> DataFrame:
    """(peer_id, address, score): each last peer's best address; of equal ones the first by ``position``."""
    scored = addresses.withColumn("peer_id", last_peer(F.col("address"))).filter(F.col("peer_id").isNotNull()).withColumn("score", address_score(F.col("address")))
    best = scored.groupBy("peer_id").agg(F.max_by(F.struct("address", "score"), F.struct("score", (-F.col("position")).alias("early"))).alias("b"))
    return best.select("peer_id", "b.address", "b.score")


def recent_addresses(addresses: DataFrame, kept: int = KEPT_ADDRESSES) -> DataFrame:
    """The last ``kept`` addresses of each peer, by position; the filter on the rank cuts groups before the shuffle."""
    recent = Window.partitionBy("peer_id").orderBy(F.desc("position"))
    return addresses.withColumn("age", F.row_number().over(recent).cast("long")).filter(F.col("age") <= kept)


def offered_addresses(addresses: DataFrame) -> DataFrame:
    """(peer_id, address, tier, place): distinct usable addresses of each peer, private first, then public, then through a relay."""
    first = addresses.withColumn("tier", tier(F.col("address")).cast("long")).filter("tier is not null").groupBy("peer_id", "address", "tier").agg(F.min("position").alias("position"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("peer_id").orderBy("tier", "position")).cast("long")).drop("position")


def addresses_by_peer(addresses: DataFrame) -> DataFrame:
    """(peer_id, n, addresses): distinct addresses that end in each peer, sorted."""
    named = addresses.select(last_peer(F.col("address")).alias("peer_id"), "address").filter("peer_id is not null").distinct()
    return named.groupBy("peer_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("address")).alias("addresses"))


def replaced(snapshots: DataFrame) -> DataFrame:
    """(peer_id, address) of each peer's last snapshot (peer_id, position, addresses): a snapshot replaces the one before."""
    return latest(snapshots, ["peer_id"], ["position"], ["addresses"]).select("peer_id", F.explode("addresses").alias("address"))


def sessions(announcements: DataFrame, departures: DataFrame) -> DataFrame:
    """(topic, member, joined, until): from a peer's first announcement (topic, peer_id, position) on a topic to its next departure (peer_id, position), from all topics; null: it stays.

    The next departure is a running value over a peer's events, latest first, in ranges.
    """
    told = announcements.select("topic", "peer_id", "position", F.lit(None).cast("long").alias("left"))
    left = departures.select(F.lit(None).cast("string").alias("topic"), "peer_id", "position", F.col("position").cast("long").alias("left"))
    events = told.unionByName(left).withColumn("latest", -F.col("position"))
    events = scanned(events, ["peer_id"], ["latest"], {"until": ("min", F.col("left"))}, before=True)
    joined = events.filter("left is null").groupBy("topic", F.col("peer_id").alias("member"), "until").agg(F.min("position").alias("joined"))
    return joined.select("topic", "member", "joined", "until")


def introductions(announcements: DataFrame, departures: DataFrame) -> DataFrame:
    """(topic, newcomer, position, member): whom each announcement meets: the others on its topic who came before and haven't left.

    An interval join of announcements and sessions; its rows are the messages that are sent.
    """
    there = sessions(announcements, departures).withColumn("after", F.col("joined") + 1)
    met = intervals_at(announcements.select("topic", F.col("peer_id").alias("newcomer"), "position"), there, ["topic"], "position", "after", "until")
    return met.filter("newcomer <> member").select("topic", "newcomer", "position", "member")


def present(events: DataFrame) -> DataFrame:
    """(topic, peer_id): members whose last event is a connection (topic, peer_id, position, connected)."""
    return latest(events, ["topic", "peer_id"], ["position"], ["connected"]).filter("connected").drop("connected")


def live_tokens(registrations: DataFrame, removals: DataFrame) -> DataFrame:
    """The last registration of each (topic, token), less tokens (token) that were found invalid, on every topic."""
    return latest(registrations, ["topic", "token"], ["position"], ["platform", "peer_id"]).join(removals, "token", "left_anti")


def fan_out_tokens(notified: DataFrame, tokens: DataFrame) -> DataFrame:
    """A push for each token of a notified topic, but for the sender's own."""
    return notified.join(tokens, "topic").filter(F.col("peer_id") != F.col("sender"))


def status(peers: DataFrame, versions: DataFrame, identities: DataFrame, verified: DataFrame) -> DataFrame:
    """One row per connected peer with version (the stored one, else the one it told), identity and whether it is verified."""
    joined = peers.join(versions.select("peer_id", F.col("db_version").alias("stored")), "peer_id", "left").join(identities, "peer_id", "left")
    joined = joined.join(verified.select("peer_id", F.lit(True).alias("verified")), "peer_id", "left")
    return joined.select("peer_id", F.coalesce("stored", "told_version").alias("db_version"), "identity", F.coalesce("verified", F.lit(False)).alias("verified"))


def with_sessions(events: DataFrame, pause: int) -> DataFrame:
    """Events (topic, at, position) with ``session``: the time of the last event before which nothing came for ``pause``, or of the topic's first.

    Pauses are found in ranges of time, whose last events are carried on as one row each, so no task sees a whole topic.
    """
    ranged = events.withColumn("range", F.floor(F.col("at") / (pause * COOLDOWNS)))
    inside, earlier = Window.partitionBy("topic", "range").orderBy("at", "position"), Window.partitionBy("topic").orderBy("range")
    ends = ranged.groupBy("topic", "range").agg(F.max("at").alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(earlier)).drop("end")
    ranged = ranged.withColumn("last", F.lag("at").over(inside)).join(ends, ["topic", "range"])
    last = F.coalesce("last", "before")
    ranged = ranged.withColumn("begins", F.when(last.isNull() | (F.col("at") - last >= pause), F.col("at"))).drop("last", "before")
    carried = ranged.groupBy("topic", "range").agg(F.max("begins").alias("carried"))
    carried = carried.withColumn("carried", F.max("carried").over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    so_far = F.max("begins").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("own", so_far).join(carried, ["topic", "range"]).select("topic", "at", "position", F.coalesce("own", "carried").alias("session"))


def debounce(events: DataFrame, cooldown: int) -> DataFrame:
    """(topic, fired_at, edge, position): pushes of events (topic, at, position) with one cooldown per topic.

    The first event fires at once. Within the cooldown the last one waits and fires at its end, which starts the next. After a pause of two cooldowns
    a topic is as new, so its events are cut there, and each session is folded by itself: a task streams its sessions in order and
    holds one waiting event. Only a topic that never pauses is one session.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until, waiting, out = None, None, None, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["topic", "fired_at", "edge", "position"])
            out.clear()
            return batch

        for batch in batches:
            for topic, at, position, session in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (topic, session) != now:
                    if waiting is not None:
                        out.append((now[0], until, "trailing", waiting))
                    now, until, waiting = (topic, session), None, None
                if until is not None and waiting is not None and until <= at:
                    out.append((topic, until, "trailing", waiting))
                    until, waiting = until + cooldown, None
                if until is None or at >= until:
                    out.append((topic, at, "leading", position))
                    until, waiting = at + cooldown, None
                else:
                    waiting = position
            yield emit()
        if waiting is not None:
            out.append((now[0], until, "trailing", waiting))
        yield emit()

    rows = with_sessions(events.select("topic", F.col("at").cast("long"), F.col("position").cast("long")), 2 * cooldown)
    return rows.repartition("topic", "session").sortWithinPartitions("topic", "session", "at", "position").mapInArrow(fold, "topic string, fired_at long, edge string, position long")
