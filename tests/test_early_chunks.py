"""Events that come before their turn are stored many to a value, and handed on as if each were stored alone."""

from test_stateful_streams import LOG, at, gathered, put, stream

from tallyspark.streaming import stateful as S


def events(job, seqs, kind="t"):
    return [{"job": job, "seq": s, "type": f"{kind}{s}" if s % 5 else None, "at": at(s)} for s in seqs]


def test_early_events_are_stored_in_chunks(spark, tmp_path):
    batches = [
        events(1, range(300, 50, -1)) + events(1, [60]) + events(None, [2]),
        events(1, range(2, 50), "u") + events(1, [70, 299], "again"),  # the first that came of each stays
        events(1, [1, 1, 300], "v") + events(None, [1]),  # up to the gap at 50
        events(1, [50, 301], "w") + events(2, [1]),
    ]
    out, stored, waits = [], [], []
    for n, rows in enumerate(batches):
        put(tmp_path / "in", n, rows)
        out.append(gathered(S.in_order(stream(spark, tmp_path / "in", LOG)), tmp_path / "state"))
        state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "early").load()
        stored.append(state.filter("key.job = 1").count())
        waits.append(sorted(r.seq for r in S.waiting(spark, str(tmp_path / "state")).collect() if r.job == 1))
    assert stored == [3, 4, 3, 0]  # of 250, 298, 250 and no events
    assert waits == [[*range(51, 301)], [*range(2, 50), *range(51, 301)], [*range(51, 301)], []]
    assert [[(r.seq, r.type) for r in rows if r.job is None] for rows in out] == [[], [], [(1, "t1"), (2, "t2")], []]
    name = lambda s: {1: "v", 50: "w", 301: "w"}.get(s, "u" if s < 50 else "t")
    ones = [[(r.seq, r.type, int(r.at.timestamp()) % 86400) for r in rows if r.job == 1] for rows in out]
    want = lambda seqs: [(s, f"{name(s)}{s}" if s % 5 else None, s) for s in seqs]
    assert ones == [[], [], want(range(1, 50)), want(range(50, 302))]


def test_a_chunk_that_is_partly_due_keeps_the_rest(spark, tmp_path):
    out = []
    for n, rows in enumerate([events(1, range(2, 250, 2)), events(1, [1, 3, 5]), events(1, range(7, 250, 2))]):
        put(tmp_path / "in", n, rows)
        out.append([r.seq for r in gathered(S.in_order(stream(spark, tmp_path / "in", LOG)), tmp_path / "state")])
    assert out == [[], [*range(1, 7)], [*range(7, 250)]]
    assert S.waiting(spark, str(tmp_path / "state")).count() == 0
