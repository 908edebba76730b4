"""The registered queries against their SQL, over whole small tables."""

import functools
import glob
import os

import duckdb
import pytest

FOLDER, LARGER_FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FAST = ["speed_history", "speed_history_year", "records", "recent_delta", "portfolio_summary", "share_summary", "weekly_volume", "effort_trends", "import_counters", "route_trends", "heatmap", "points_derived", "kilometre_splits", "best_efforts", "stops", "peak_speeds", "hr_summary", "hr_zones", "hr_sectors", "hr_selection", "cadence_summary", "terrain", "speed_sensor", "route_matches", "geo_functions", "route_cells", "renderings", "pedaling_overview", "hr_weekly_load", "hr_cadence_lock", "hr_drift", "route_list", "route_details", "route_of_track", "route_groups", "route_features", "hr_duration_curve", "hr_selection_sql", "constraint_report", "quarantined_rows", "lifecycle_states", "lifecycle_quarantine", "zone_revisions", "display_formats", "track_lookup", "marked_items", "route_status", "speed_chart", "sector_comparison", "focus_window"]
#: Those whose cases need more rows.
LARGER = ["hr_sectors", "loop_matches", "hr_route_pairs"]


@pytest.fixture(scope="module")
def duck():
    def of(folder):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for path in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        return con

    return functools.cache(of)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize(("name", "folder"), [(n, FOLDER) for n in FAST] + [(n, LARGER_FOLDER) for n in LARGER])
def test_query(spark, duck, name, folder):
    import __spark_entry__ as entry

    rows = entry.queries()[name](spark, folder)
    columns = sorted(rows.columns)
    want = duck(folder).execute(entry.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    mine = sorted(tuple(str(r[c]) for c in columns) for r in rows.collect())
    theirs = sorted(tuple(str(r[order.index(c)]) for c in columns) for r in want.fetchall())
    assert mine == theirs


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
