"""Property tests: chunked ordered computations equal a sequential reference for any chunking."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ampfold.operators import signals as ops
from ampfold.plans import ordered

series = st.lists(
    st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-3, 3).map(float))),
    min_size=1, max_size=80,
)


def brute(rows):
    by = {}
    for t, (g, v) in enumerate(rows):
        by.setdefault(g, []).append((t, v))
    jumps, positions = {}, {}
    for g, seq in by.items():
        jumps[g] = sum(1 for (_, a), (_, b) in zip(seq, seq[1:]) if a is not None and b is not None and abs(b - a) > 0.1)
        for i, (t, _) in enumerate(seq):
            positions[(g, t)] = i
    return jumps, positions


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=series, chunks=st.integers(1, 9))
def test_chunked_jumps_and_positions(spark, rows, chunks):
    df = spark.createDataFrame([(g, t, v) for t, (g, v) in enumerate(rows)], "g int, t int, v double")
    exp_j, exp_p = brute(rows)
    got_j = {r["g"]: r["j"] for r in ordered.adjacent_sums(
        df, "g", "t", ["v"], {"j": ops.jump_term("v", 0.1)}, num_chunks=chunks).collect()}
    assert {g: int(v) for g, v in got_j.items()} == exp_j
    got_p = {(r["g"], r["t"]): r["pos"] for r in ordered.dense_positions(df, "g", "t", num_chunks=chunks).collect()}
    assert got_p == exp_p
