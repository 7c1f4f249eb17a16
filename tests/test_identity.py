import random

from pyspark.sql import functions as F

from bidstream.operators import identity


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_components_of_random_graphs(spark):
    rng = random.Random(0)
    for n, m in ((30, 15), (200, 190), (50, 200)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = {r["node"]: r["component"] for r in identity.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == union_find(pairs)


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(300)]
    got = identity.components(spark.createDataFrame(pairs, "a long, b long"))
    assert got.where("component != 0").count() == 0 and got.count() == 301


def test_exact_keys(spark):
    df = spark.sql("select 'p' as o, array('r1', 'r1', 'r2') as refs, cast(null as array<string>) as urls, 'L' as lot union all select '', array(), array('u'), null")
    got = [r[0] for r in df.select(identity.exact_keys(F.col("o"), F.col("refs"), F.col("urls"), F.col("lot"))).collect()]
    assert got == [["ocid:p|lot:L", "ref:r1|lot:L", "ref:r2|lot:L"], ["url:u|lot:"]]


def test_amounts_move_as_a_unit(spark):
    rows = [(1, 1, "a", 5.0, "EUR"), (1, 2, "unknown", None, "USD"), (1, 3, None, None, None)]
    df = spark.createDataFrame(rows, "k long, at long, status string, amount double, currency string")
    r, = identity.merged_revisions(df, ["k"], ["at"], ["status"], [["amount", "currency"]]).collect()
    assert (r["status"], r["amount"], r["currency"], r["revisions"]) == ("a", None, "USD", 3)
