import duckdb

from medspan.plans.operator_queries import SPANS_SQL


def test_sql_of_spans_leaves_no_ties_to_chance():
    """Many equal spans an order: islands must not depend on how two windows order what is equal."""
    with duckdb.connect() as con:
        con.execute("CREATE TABLE lineitem AS SELECT i % 20000 AS l_orderkey, hash(i) % 12 * 4 AS l_partkey, hash(-i) % 3 AS l_suppkey FROM range(800000) r(i)")
        spans: dict[int, set] = {}
        for order, start, size in con.execute("SELECT DISTINCT l_orderkey, l_partkey % 40, 1 + l_suppkey % 9 FROM lineitem").fetchall():
            spans.setdefault(order, set()).add((start, start + size))
        expected = set()
        for order, own in spans.items():
            n = covered = reach = 0
            for i, (a, b) in enumerate(sorted(own)):
                n += i == 0 or a >= reach
                covered += max(0, b - max(a, reach if i else a))
                reach = max(reach, b) if i else b
            expected.add((order, n, covered))
        for threads in (1, 4, 8):
            con.execute(f"SET threads = {threads}")
            assert set(con.execute(SPANS_SQL).fetchall()) == expected
