"""SQL of the registry on tables where it once stated another rule than its query."""

import duckdb

from registry import queries
from tidemark.operators import contracts, summaries


def test_domain_sql_counts_values_never_seen(spark):
    domain = ["context", "signal_candidate", "price_dislocation"]
    con = duckdb.connect()
    con.execute("CREATE TABLE comparison (metric_group VARCHAR)")
    for groups in ([], ["context", None], ["context", "unstable", "other"], [*domain, "context"]):
        con.execute("DELETE FROM comparison")
        for group in groups:
            con.execute("INSERT INTO comparison VALUES (?)", [group])
        table = spark.createDataFrame([(group,) for group in groups], "metric_group string")
        row = contracts.check(table, [contracts.expect_domain("metric_group", domain)]).first()
        assert con.execute(f"SELECT {queries.DOMAIN_OBSERVED} FROM comparison").fetchone() == (row["observed"],)


def test_status_counts_sql_of_no_and_some_events(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE chosen (event_id VARCHAR, direction VARCHAR)")
    controls = spark.createDataFrame([], "event_id string")
    for directions in ([], ["UP"], ["UP", "DOWN", "UP"]):
        con.execute("DELETE FROM chosen")
        rows = [(f"e{i}", i, direction) for i, direction in enumerate(directions)]
        for event_id, _, direction in rows:
            con.execute("INSERT INTO chosen VALUES (?, ?)", [event_id, direction])
        events = spark.createDataFrame(rows, "event_id string, event_rank int, direction string")
        made = summaries.status_counts(summaries.status_join(events, controls)).count()
        assert con.execute(f"SELECT {queries.STATUS_COUNTS} FROM chosen").fetchone() == (made,)


def test_distances_need_no_profiles_of_all_events(spark):
    from registry.queries import QUERIES
    from helpers import values
    from registry.settings import FINE
    from registry.workspace import Workspace
    from tidemark.operators.controls import event_activity
    from tidemark.sources.stages import write_stage

    written = []

    def stage(df, name, partition_by=()):
        written.append(name)
        return write_stage(df, name, partition_by=partition_by)

    w = Workspace(spark, "/root/testdata/sf0.001", stage)
    QUERIES["q_activity_join"].run(w).collect()
    assert "event_activity" in written and not any("profile" in name or "panel" in name for name in written)
    profiled = event_activity(w.own["entity"], FINE.activity_window)
    assert values(w.own_activity, *profiled.columns) == values(profiled, *profiled.columns)
