"""Events within a second of a day's, a round's or a start's border: instants count by their nearest second, as in SQL."""

import duckdb
import pytest

from pricelens import plans

# Starts of users 1 to 3 are 1704067200 + 86400 * (5 + user); rounds begin every 21600 s.
_EVENTS = """select (row_number() over (order by s, off, u))::bigint as event_id, make_timestamp(s * 1000000 + off) as ts, u::bigint as user_id,
    (['error', 'click', 'view'])[1 + u % 3] as event_type, u * 1.5::double as value
    from (select unnest(list_transform(range(-2, 3), lambda k: 1702598400 + 21600 * k) || list_transform(range(2, 50), lambda k: 1704067200 + 21600 * k)) as s) a,
    (select unnest([-1000000, -700000, -500001, -500000, -499999, -300000, 0, 300000, 499999, 500000, 500001]) as off) b,
    (select unnest(range(1, 4)) as u) c where s // 21600 % 2 = 0 or off >= 0"""


@pytest.fixture(scope="module")
def borders(tmp_path_factory):
    at = tmp_path_factory.mktemp("borders")
    duckdb.execute(f"copy ({_EVENTS}) to '{at}/events.parquet' (format parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["h5_head_publication", "t2_closing_seal", "t7_round_windows", "a35_slice_counter"])
def test_nearest_seconds(spark, borders, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{borders}/events.parquet')")
    got = plans.queries()[name](spark, borders)
    want = con.execute(f"select {', '.join(got.columns)} from ({plans.oracle_sql()[name]}) q").fetchall()
    assert want and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["t3_empty_rounds", "t7_round_windows"])
@pytest.mark.parametrize("past", [599.6, 600.0, 600.3])
def test_a_round_closes_with_the_watermark(spark, tmp_path, past, name):
    """The only written quote counts for the second round; the last event lies around the instant that closes that one."""
    first, last = 1704067200_000000, int((1704067200 + 43200 + past) * 1_000_000)
    duckdb.execute(f"""copy (select 1::bigint as event_id, make_timestamp({first}) as ts, 1::bigint as user_id, 'view' as event_type, 1.5::double as value
        union all select 3, make_timestamp({first} + 21599700000), 1, 'error', 3.5 union all select 4, make_timestamp({last}), 1, 'view', 2.5)
        to '{tmp_path}/events.parquet' (format parquet)""")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    got = plans.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({plans.oracle_sql()[name]}) q").fetchall())
