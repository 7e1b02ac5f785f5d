"""Session claims against a loop over the markers in order."""

import random

import pytest

from ledgerline.operators import transactions

EVENTS = "case_id string, source_file string, log_position long, row_index int, thread_id long"
MARKERS = "case_id string, source_file string, start_position long, end_position long, gtid string, thread_id long, event_positions array<long>"


def loop(events, markers):
    claimed, claims, refused = {}, [], []
    for case, file, start, _, gtid, _, listed in markers:
        for e in events:
            if e[:2] == (case, file) and e[2] in listed:
                claimed[e[:4]] = min(claimed.get(e[:4], start), start)
    taken: set = set()
    for case, file, start, end, gtid, thread, listed in sorted(markers, key=lambda m: (m[0], m[1], m[2], m[4] is None, m[4] or "")):
        if listed:
            continue
        seen = [e for e in events if e[:2] == (case, file) and start <= e[2] <= end and e[:4] not in taken and claimed.get(e[:4], start) >= start]
        if seen and (thread is None or any(e[4] is None for e in seen)):
            refused.append((case, file, start, len(seen)))
            continue
        for e in seen:
            if e[4] == thread:
                taken.add(e[:4])
                claims.append((case, file, start, gtid, e[2], e[3]))
    return sorted(claims, key=repr), sorted(refused)


@pytest.mark.parametrize("seed", range(6))
def test_random_overlaps(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice("AB"), f"log.{rng.randint(1, 2)}", p, n, rng.choice([1, 1, 2, 3, 3, None if rng.random() < 0.2 else 2])) for p in range(0, 60_000, 700) for n in range(rng.randint(1, 2))]
    markers = []
    for n in range(50):
        start = rng.randint(0, 60_000)
        markers.append((rng.choice("AB"), f"log.{rng.randint(1, 2)}", start + n, start + rng.randint(0, rng.choice([900, 5000, 30_000])), rng.choice([f"u:{n}", None]), rng.choice([1, 2, 3, None if rng.random() < 0.2 else 1]), [p for p in range(0, 60_000, 700) if start <= p <= start + 1500] if rng.random() < 0.3 else []))
    e, m = spark.createDataFrame(events, EVENTS), spark.createDataFrame(markers, MARKERS)
    claims, refused = transactions.claim_by_session(e, m, transactions.claim_by_position(e, m))
    want = loop(events, markers)
    assert sorted(((r.case_id, r.source_file, r.start_position, r.gtid, r.log_position, r.row_index) for r in claims.collect()), key=repr) == want[0]
    assert sorted((r.case_id, r.source_file, r.start_position, r.refused) for r in refused.collect()) == want[1]
    assert want[0] and want[1]
    assert "Python" not in claims._jdf.queryExecution().executedPlan().toString()
