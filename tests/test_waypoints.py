from octroi.operators import options

DETAIL = (
    "origin_id bigint, destination_id bigint, vehicle_class int, vot_bucket bigint, chain array<bigint>, priced_gates array<bigint>,"
    " toll_gates_detail array<struct<from_gare_id:bigint,to_gare_id:bigint>>"
)


def test_waypoints_visit_priced_gates_only(spark):
    rows = [
        (1, 2, 1, 12, [5, 9, 7, 9, 4], [5, 9, 4], [(5, 9), (9, 4)]),
        (1, 3, 1, 12, [5, 6], [], []),
    ]
    hubs = spark.createDataFrame([(i, float(i), float(-i)) for i in (1, 2, 3)], "hub_id bigint, lat double, lon double")
    gates = spark.createDataFrame([(g, g / 10.0, g / 100.0) for g in range(4, 10)], "gare_id bigint, lat double, lon double")
    got = {r["destination_id"]: r for r in options.waypoint_legs(spark.createDataFrame(rows, DETAIL), hubs, gates).collect()}
    assert [tuple(p) for p in got[2]["waypoints"]] == [(1.0, -1.0), (0.5, 0.05), (0.9, 0.09), (0.4, 0.04), (2.0, -2.0)]
    assert got[2]["priced_legs"] == [1, 2]
    assert [tuple(p) for p in got[3]["waypoints"]] == [(1.0, -1.0), (3.0, -3.0)] and got[3]["priced_legs"] == []
    assert got[2]["route_id"] != got[3]["route_id"] and len(got[2]["route_id"]) == 16
