"""Interval joins and presence against plain loops."""

import random

from colmerge.operators.intervals import intervals_at
from colmerge.operators.peers import introductions, sessions


def test_points_meet_the_intervals_that_hold_them(spark):
    rng = random.Random(1)
    for span in (1, 9, 5000, 10**12):
        points = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-span, span + 1)]), k) for k in range(60)]
        held = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(-span, span + 1)]), rng.choice([None, rng.randrange(-span, span + 1)]), k) for k in range(80)]
        got = intervals_at(spark.createDataFrame(points, "g string, at long, p int"), spark.createDataFrame(held, "g string, low long, high long, i int"), ["g"], "at", "low", "high").select("p", "i").collect()
        told = [(p, i) for g, at, p in points for h, low, high, i in held if None not in (g, at, low) and g == h and low <= at and (high is None or at < high)]
        assert sorted(map(tuple, got)) == sorted(told)
    none = spark.createDataFrame([], "g string, at long, p int")
    assert intervals_at(none, spark.createDataFrame(held, "g string, low long, high long, i int"), ["g"], "at", "low", "high").collect() == []


def test_newcomers_meet_those_who_came_and_have_not_left(spark):
    rng = random.Random(2)
    events = [(rng.choice("xy"), rng.choice("abcd"), k, rng.random() < 0.3) for k in range(300)]
    there, told, open_sessions = {"x": set(), "y": set()}, [], {}
    done = []
    for topic, peer, k, leaves in events:
        if leaves:
            for t in there:
                if peer in there[t]:
                    there[t].discard(peer)
                    done.append((t, peer, open_sessions.pop((t, peer)), k))
        else:
            told += [(topic, peer, k, other) for other in there[topic] if other != peer]
            there[topic].add(peer)
            open_sessions.setdefault((topic, peer), k)
    done += [(t, p, k, None) for (t, p), k in open_sessions.items()]
    table = spark.createDataFrame(events, "topic string, peer_id string, position long, leaves boolean")
    came, left = table.filter("not leaves"), table.filter("leaves")
    assert sorted(map(tuple, introductions(came, left).collect())) == sorted(told)
    assert sorted(map(tuple, sessions(came, left).collect()), key=str) == sorted(done, key=str)
