"""Shares of a payer's outflow: every signal of the query at its level, on rows made here."""

from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from compare import difference
from tideglass.operators import signal_catalogue as sc

MARKS = {
    "related_party": [("FUND_DIVERSION_SUSPECTED", 10), ("RELATED_PARTY_DIVERSION_PATTERN", 15)],
    "distressed": [("FUND_SIPHONING_SUSPECTED", 25), ("SHELL_ENTITY_EXPOSURE_SUSPECTED", 35)],
    "outside": [("OUTSIDE_AGREED_ROUTING_ANOMALY", 90), ("END_USE_MISMATCH_SUSPECTED", 95)],
}
# Every payer is in nation 0; nations 0 and 1 share a region. Supplier: key, nation, balance.
SUPPLIERS = {"plain": (1, 1, 10.0), "related_party": (2, 0, 10.0), "distressed": (3, 1, -10.0), "outside": (4, 2, 10.0)}
# One payer for each mark and share in percent around the levels.
PAYERS = dict(enumerate([(mark, s) for mark in MARKS for s in (0, 9, 10, 14, 15, 24, 25, 34, 35, 89, 90, 94, 95, 100)], 1))
EXPECTED = sorted((i, signal) for i, (mark, share) in PAYERS.items() for signal, level in MARKS[mark] if share >= level)


def test_operator_gives_every_signal(spark):
    rows = [(i, float(part), *(marked and m == mark for m in MARKS)) for i, (mark, s) in PAYERS.items() for marked, part in ((True, s), (False, 100 - s))]
    rows.append((900, None, True, True, True))  # nothing known to be paid
    flows = spark.createDataFrame(rows, "payer_id long, amount double, related_party boolean, distressed boolean, outside boolean")
    assert sorted(map(tuple, sc.flow_patterns(flows).collect())) == EXPECTED


def test_query_and_its_sql_give_every_signal(spark, tmp_path):
    lines = [(i, n, SUPPLIERS[kind][0], float(part)) for i, (mark, s) in PAYERS.items() for n, (kind, part) in enumerate(((mark, s), ("plain", 100 - s)), 1)]
    order, number, supplier, price = map(list, zip(*lines))
    s_key, s_nation, s_balance = map(list, zip(*SUPPLIERS.values()))
    tables = {
        "nation": {"n_nationkey": [0, 1, 2], "n_regionkey": [0, 0, 1]},
        "supplier": {"s_suppkey": s_key, "s_nationkey": s_nation, "s_acctbal": s_balance},
        "customer": {"c_custkey": list(PAYERS), "c_nationkey": [0] * len(PAYERS)},
        "orders": {"o_orderkey": list(PAYERS), "o_custkey": list(PAYERS)},
        "lineitem": {"l_orderkey": order, "l_linenumber": number, "l_partkey": number, "l_suppkey": supplier, "l_shipdate": [datetime(2020, 1, 1)] * len(lines), "l_extendedprice": price},
    }
    con = duckdb.connect()
    for name, columns in tables.items():
        path = f"{tmp_path}/{name}.parquet"
        pq.write_table(pa.table(columns), path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    df = entry.queries()["signal_flow_patterns"](spark, str(tmp_path))
    assert sorted((r["payer_id"], r["signal_type"]) for r in df.collect()) == EXPECTED
    assert difference(df, con, entry.oracle_sql()["signal_flow_patterns"]) is None
