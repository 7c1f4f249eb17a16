import random

from pyspark.sql import functions as F

from bidstream.operators import duplicates, reconcile
from tests.test_identity import union_find

ROW = "id long, at long, source string, ocid string, keys array<string>, title string, amount double, currency string"
EMPTY = (None, "", "unknown")


def revisions(rng, n):
    rows = []
    for i in range(n):
        sparse = rng.random() < 0.3
        keys = [f"k{rng.randrange(n)}" for _ in range(rng.randint(0, 3))]
        rows.append((i, rng.randrange(40), rng.choice(["a", "b", "whole"]), "", keys, rng.choice([None, "", "unknown"]) if sparse else rng.choice("xyz"),
                     None if rng.random() < 0.5 else float(rng.randrange(5)), rng.choice([None, "EUR", "USD"])))
    return rows


def folded(rows):
    """Records by a plain fold, one revision after the other."""
    pairs = [(("row", r[0]), ("key", k)) for r in rows for k in r[4]] + [(("row", r[0]), ("row", r[0])) for r in rows]
    root = union_find(pairs)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        groups.setdefault(root["row", r[0]], []).append(r)
    out = []
    for group in groups.values():
        now, log = {"title": None, "amount": None, "currency": None}, []
        for nth, r in enumerate(group):
            whole, was = r[2] == "whole", dict(now)
            if whole or r[5] not in EMPTY:
                now["title"] = r[5]
            if whole or r[6] is not None or r[7] not in EMPTY:
                now |= {"amount": r[6], "currency": r[7]}
            fields = [k for k in now if now[k] != was[k]]
            if nth and fields:
                log.append((r[1], ",".join(fields)))
        out.append((min(r[0] for r in group), now["title"], now["amount"], now["currency"], group[0][1], group[-1][1], len(group), len(log), sorted(log)[-30:]))
    return sorted(out)


def test_records_are_those_of_a_fold(spark):
    rng = random.Random(4)
    for n in (40, 90):
        rows = revisions(rng, n)
        found = reconcile.with_records(spark.createDataFrame(rows, ROW))
        history = reconcile.revised(found, "record", ["at", "id"], ["title", "amount", "currency"], [["amount", "currency"]], ("whole",))
        out = reconcile.records(history, "record", ["at", "id"], "at", ["title", "amount", "currency"]).collect()
        got = sorted((r["record"], r["title"], r["amount"], r["currency"], r["first_seen"], r["last_seen"], r["versions"], r["changes"], [tuple(x) for x in r["log"] or []]) for r in out)
        assert got == folded(rows)


def test_procedures_of_one_source_stay_apart(spark):
    rows = [(1, 1, "s", "p", ["k"]), (2, 2, "s", "q", ["k", "m"]), (3, 3, "t", "", ["m"]), (4, 4, "t", "", ["z", "k"]), (5, 5, "u", "p", ["j"]), (6, 6, "v", "w", ["j"]), (7, 7, "t", "", [])]
    df = spark.createDataFrame(rows, "id long, at long, source string, ocid string, keys array<string>")
    got = {r["id"]: r["record"] for r in reconcile.with_records(df).collect()}
    # 1 and 2 have numbers of their own, 3 goes to 2 and 4 to the earlier 1; two sources may number one procedure each
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 5, 7: 7}


def ratio(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, d in enumerate(y, 1):
            row[j], last = (last + 1 if c == d else max(row[j], row[j - 1])), row[j]
    return 200 * row[-1] / (len(x) + len(y)) if x or y else 100


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        day, amount = rng.randrange(4), rng.choice([0.5, 1.2, 90.0, 100.0, 101.9, 103.0, 5e6, 5.09e6])
        buyer = rng.choice(["City of Xanadu and its wide region", "City of Xanadu and its wide regions", "Town of Y"])
        title = rng.choice(["Repair of the old bridge", "Repair of the old bridges", "School meals"])
        rows.append((i, rng.choice("ab"), buyer if rng.random() < 0.95 else "", title, f"2026-01-0{day + 1} {rng.choice(['00', '12'])}:00:00" if rng.random() < 0.95 else None,
                     amount if rng.random() < 0.95 else None, rng.choice(["EUR", "EUR", "USD", None]), rng.choice([None, None, "1"]), rng.choice(["", "p", "q"]), rng.choice(["2026-01-01", "2026-02-10", "2026-03-01", None])))
    rows += [(200 + i, *rows[3][1:]) for i in range(30)]
    schema = "id long, source string, buyer string, title string, deadline string, amount double, currency string, lot string, ocid string, published string"
    df = spark.createDataFrame(rows, schema).withColumns({"deadline": F.col("deadline").cast("timestamp"), "published": F.col("published").cast("date")})
    from datetime import datetime

    def near(x, y):
        if not x[2] or not y[2] or None in (x[4], y[4], x[5], y[5]) or x[7] != y[7] or x[6] != y[6]:
            return False
        if x[1] == y[1] and x[8] and y[8] and x[8] != y[8]:
            return False
        if x[9] and y[9] and abs((datetime.fromisoformat(x[9]) - datetime.fromisoformat(y[9])).days) > 45:
            return False
        if abs((datetime.fromisoformat(x[4]) - datetime.fromisoformat(y[4])).total_seconds()) > 86400 or abs(x[5] - y[5]) > max(1, 0.02 * x[5]):
            return False
        return ratio(x[2], y[2]) >= 95 and ratio(x[3], y[3]) >= 94

    same = {}
    for r in rows:
        same.setdefault(r[1:], []).append(r[0])
    pairs = [(r[0], r[0]) for r in rows] + [(ids[0], i) for ids in same.values() for i in ids] + [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y)]
    root = union_find(pairs)
    got = {r["id"]: r["group"] for r in duplicates.duplicate_groups(df).collect()}
    assert got == {r[0]: root[r[0]] for r in rows} and len(set(got.values())) < len(rows) - 40


def test_duplicates_of_short_names_meet_by_name(spark):
    rng = random.Random(9)
    names = ["Town of Yam", "Town of Yams", "Town of Yms", "Tow", "Tows", "n" * 9, "n" * 10, "n" * 11, "City of Xanadu East", "City of Xanadu Eastx", "City of Xanadu Eastxy", "City of Xanadu Easty", "Ŷ" * 18 + "a", "Ŷ" * 20]
    rows = [(i, "ab"[i % 2], rng.choice(names), "Works", f"2026-01-0{rng.randrange(1, 8)} 00:00:00", rng.choice([-5.0, 0.5, 1.4, 100.0, 101.9, 5e6]), "EUR", None, "", "2026-01-01") for i in range(300)]
    schema = "id long, source string, buyer string, title string, deadline string, amount double, currency string, lot string, ocid string, published string"
    df = spark.createDataFrame(rows, schema).withColumns({"deadline": F.col("deadline").cast("timestamp"), "published": F.col("published").cast("date")})
    known = duplicates.classes(df)
    firsts = {}
    for r in rows:
        firsts.setdefault(r[1:], r)
    kept = list(firsts.values())
    near = lambda x, y: abs(int(x[4][9]) - int(y[4][9])) <= 1 and abs(x[5] - y[5]) <= max(1, 0.02 * x[5]) and ratio(x[2], y[2]) >= 95
    want = {(x[0], y[0]) for x in kept for y in kept if x[0] < y[0] and near(x, y)}
    got = [(r["a"], r["b"]) for r in duplicates.duplicate_pairs(known).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_names_are_matched_without_their_pairs(spark):
    # names that differ in a digit are all much alike, and none by one letter more; each has itself and its longer form only
    buyers = spark.range(3000).selectExpr("explode(array(printf('Customer#%09d', id), printf('Customer#%09dx', id))) AS buyer")
    got = duplicates._alike_names(buyers)
    assert got.count() == 9000 and got.where("other NOT IN (buyer, concat(buyer, 'x'))").count() == 0
