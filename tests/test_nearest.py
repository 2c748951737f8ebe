"""The nearest event of many at the same and close instants, against the SQL; no row meets all events around it."""

import duckdb

from pricelens import plans


def test_nearest_of_crowded_instants(spark, tmp_path):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    # Around the instants of matches, on both sides, at and beyond the tolerance, with several events at an instant.
    con.execute(f"""copy (select row_number() over (order by hash(o_orderkey, off, k))::bigint as event_id,
        make_timestamp((1704067200 + (o_orderkey * 977) % 2592000 + off) * 1000000) as ts, (c_nationkey + 25 * k)::bigint as user_id, 'view' as event_type, 1.0::double as value
        from orders join customer on o_custkey = c_custkey, (select unnest(case when o_orderkey % 3 = 0 then [-1801, 1801] when o_orderkey % 3 = 1 then [-1800, 1800, 1801] else [-700, 700, 0] end) as off) f,
        (select unnest(range(3)) as k) g where o_orderkey % 2 = 0) to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    got = plans.queries()["j6_nearest_within"](spark, str(tmp_path))
    want = con.execute(plans.oracle_sql()["j6_nearest_within"]).fetchall()
    assert want and sorted(map(tuple, got.select("match_id", "event_id").collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # orders with customers
