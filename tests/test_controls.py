"""Random controls on rows that the shared tables rarely hold."""

from routelens.operators import routing as R

POOL = ("v_cheap", "v_mid", "v_high")


def test_matched_random_with_no_available_action(spark):
    fields = ", ".join(f"available__{a} boolean, cal__{a} double, latency_ms__{a} double" for a in POOL)
    values = [(f"e{i}", *[x for j in range(3) for x in (up[j], 0.1 * j, 10.0 * j)]) for i, up in enumerate([(False,) * 3, (None,) * 3, (False, True, False)])]
    rows = spark.createDataFrame(values, f"episode_key string, {fields}")
    shares = R.one_row(spark.createDataFrame([(0.5, 0.0, 0.5)], ", ".join(f"{a} double" for a in POOL)), POOL)
    got = {r.episode_key: (r.sel, r.selected_action) for r in R.matched_random(rows, POOL, shares, 5).collect()}
    assert got == {"e0": (0, "v_cheap"), "e1": (0, "v_cheap"), "e2": (1, "v_mid")}
