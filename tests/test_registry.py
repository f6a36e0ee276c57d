import __spark_entry__


def test_registry(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert not {n for n in q if not n.startswith("op") and n != "pipeline"} - set(o)
    assert __spark_entry__.entry(spark).count() > 0


def test_registered_queries_match_their_sql(spark, sf):
    import duckdb
    from memlake.plans import queries as plans

    con = duckdb.connect()
    for t in "events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cell = lambda v: "" if v is None else str(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)
    wrong = []
    for name, run in plans.QUERIES.items():
        df = run(spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
        res = con.execute(plans.ORACLE[name])
        names = [x[0] for x in res.description]
        if sorted(names) != cols or got != sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in res.fetchall()):
            wrong.append(name)
    assert not wrong
