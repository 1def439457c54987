"""Stateful processors: replays cut in any way give the batch rule, the limit holds, and state goes when its time has passed."""

import random

from plotwise.operators.lake import replay_tickets, throttled
from plotwise.streaming.processors import live_tickets, supersede, throttle
from plotwise.streaming.runs import run_append, stream_of


def files_of(spark, path, kind, *chunks):
    """A folder of files, one after another."""
    for rows in chunks:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    return stream_of(spark, path, 1)


def test_stream_of_tickets_is_the_replay(spark, tmp_path):
    rnd = random.Random(11)
    kind = "dataset long, ticket long, action string, at_s long"
    events, used = [], set()
    for ticket in range(240):
        dataset, at = ticket % 2, 3 * (ticket // 4)
        for action, after in [("mint", 0)] + [(rnd.choice(("redeem", "cancel")), rnd.randrange(1, 45)) for _ in range(rnd.randrange(3))] + [("mint", rnd.randrange(40, 80))] * (ticket % 9 == 0):
            if ticket % 17 == 3 and action == "mint":
                continue  # never minted: nothing is kept or told of it
            if (dataset, at + after) not in used:
                used.add((dataset, at + after))
                events.append((dataset, ticket, action, at + after))
    expected = replay_tickets(spark.createDataFrame([(*e, k) for k, e in enumerate(events)], f"{kind}, k long"), "dataset", ["at_s"])
    expected = sorted((r.dataset, r.ticket, r.minted_s, r.state) for r in expected.collect() if r.state != "unknown")
    assert {state for *_, state in expected} == {"redeemed", "cancelled", "expired", "refused"}
    events.sort(key=lambda e: e[3] + rnd.randrange(50))  # out of order by less than the bound
    ends = [[(-1, -1, "end", 10**6 + k)] for k in range(2)]
    progress = []
    stream = files_of(spark, f"file://{tmp_path}/a", kind, events[:90], events[90:100], events[100:], *ends)
    found = run_append(live_tickets(stream, late="60 seconds", keep_s=300), "tickets", rocks=True, progress=progress).collect()
    assert sorted(map(tuple, found)) == expected
    rows = [p.stateOperators[0].numRowsTotal for p in progress]
    assert rows[-1] < max(rows) / 10  # tombstones too have gone


def test_tickets_left_by_an_earlier_run(spark, tmp_path):
    kind = "dataset long, ticket long, action string, at_s long"
    stream = files_of(spark, f"file://{tmp_path}/a", kind, [(1, 5, "redeem", 110), (1, 6, "redeem", 111), (1, 9, "mint", 112)], [(0, 0, "end", 10**6)], [(0, 0, "end", 10**6 + 1)])
    left = spark.createDataFrame([(1, 5, 100), (1, 6, 70), (2, 7, 90)] + [(1, 20 + k, 100) for k in range(7)], "dataset long, ticket long, minted_s long")
    found = {(r.dataset, r.ticket): r.state for r in run_append(live_tickets(stream, pending=left), "tickets", rocks=True).collect()}
    assert found == {(1, 5): "redeemed", (1, 6): "expired", (1, 9): "expired", (2, 7): "expired"} | {(1, 20 + k): "expired" for k in range(7)}


def test_throttle_forgets_users(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randrange(5) + 100 * (k // 100), k, 40 * k + rnd.randrange(30)) for k in range(400)]
    kind = "user_id long, event_id long, ms long"
    progress = []
    stream = files_of(spark, f"file://{tmp_path}/a", kind, *(rows[k : k + 100] for k in range(0, 400, 100)))
    found = run_append(throttle(stream), "throttle", rocks=True, progress=progress).collect()
    expected = throttled(spark.createDataFrame(rows, kind), "user_id", ["event_id"], "ms").collect()
    assert sorted((r.event_id, r.accepted) for r in found) == sorted((r.event_id, r.accepted) for r in expected)
    assert max(p.stateOperators[0].numRowsTotal for p in progress) < 25  # five users a file, a value and a timer each; without an end of life it would be twenty users


def test_generations_are_forgotten_after_their_time(spark, tmp_path):
    kind = "dataset string, event_id long, generation long, ms long"
    stream = files_of(spark, f"file://{tmp_path}/a", kind, [("a", 1, 5, 1000), ("a", 2, 4, 1001), ("b", 3, 1, 1002)], [("a", 4, 4, 2000)], [("b", 5, 0, 99_000)], [("a", 6, 3, 100_000)])
    found = run_append(supersede(stream, ttl_ms=10_000), "supersede", rocks=True).collect()
    assert sorted((r.dataset, r.event_id) for r in found) == [("a", 1), ("a", 6), ("b", 3)]
