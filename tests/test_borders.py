"""Values that lie on a border."""

import duckdb

from echograin.functions import geo
from echograin.operators import neighbourhoods as nb
from echograin.plans import catalog


def test_equal_shares_end_at_thirds(spark):
    # the running sums of three equal thirds miss 1/3 and 2/3 by their last bits
    rows = [(u, k, v) for u, v in enumerate((0.1, 0.7, 29.27, 1e-3)) for k in range(6)] + [(9, 0, 0.0), (9, 1, None)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, value double")
    got = {(r["user_id"], r["event_id"]): r["part"] for r in nb.equal_energy_split(df, ["user_id"], ["event_id"], "value", 3).collect()}
    assert got.pop((9, 0)) == got.pop((9, 1)) == 0  # no power, no share
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, event_id BIGINT, value DOUBLE, ts INT)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, 0)", [list(r) for r in rows if r[0] != 9])
    want = dict(con.execute(catalog.ORACLES["equal_energy_split"].replace("SELECT event_id, least", "SELECT user_id * 10 + event_id, least")).fetchall())
    assert {u * 10 + e: p for (u, e), p in got.items()} == want


def test_points_on_edges_are_not_within(spark):
    ring = [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0), (0.0, 0.0)]
    points = {(0.0, 10.0): False, (0.0, 40.0): False, (10.0, 0.0): False, (0.0, 0.0): False, (40.0, 0.0): False, (15.0, 25.0): False, (15.0, 24.99): True, (0.01, 10.0): True, (30.0, 30.0): False}
    df = spark.createDataFrame(list(points), "lon double, lat double")
    for r in (ring, ring[::-1], ring[:-1]):
        assert {(p["lon"], p["lat"]) for p in geo.points_within(df, r).collect()} == {p for p, within in points.items() if within}


def test_tile_select_on_the_edge(spark, tmp_path):
    # 125,650 lies at longitude 0; points on the slanted edge are decided as the sum of their numbers
    spark.range(125_000, 730_000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0] for r in con.execute(catalog.ORACLES["tile_select"]).fetchall()}
    assert {r[0] for r in catalog.QUERIES["tile_select"](spark, str(tmp_path)).collect()} == want and 125_650 not in want
