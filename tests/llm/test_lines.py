import hashlib

import duckdb
from pyspark.sql import functions as F

from bidstream.llm import lines
from tests.llm.conftest import SCHEMA


def by_force(rows):
    """Rows as the query has them, by comparing the lines from every place on with those from every earlier place on."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    texts = [(r[1] or "").split("\n") for r in order]
    places: dict[str, list[tuple[int, int]]] = {}
    out = []
    for d, t in enumerate(texts):
        longest: list[int] = []
        for i, line in enumerate(t):
            most = 0
            for e, j in places.get(line, []):
                n = 0
                while i + n < len(t) and j + n < len(texts[e]) and t[i + n] == texts[e][j + n]:
                    n += 1
                most = max(most, n)
            longest.append(most)
            places.setdefault(line, []).append((d, i))
        runs = [(i, i + n) for i, n in enumerate(longest) if n and (i == 0 or i + n > i - 1 + longest[i - 1])]
        gone = set()
        going = [(a, b) for a, b in runs if len("".join("".join(t[a:b]).split())) >= lines.MIN_CHARS]
        for a, b in going:
            gone |= set(range(a, b))
        kept = "\n".join(x for i, x in enumerate(t) if i not in gone)
        out.append((order[d][0], len(t), len(gone), len(going), max(longest), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def planted(rows):
    block = "\n".join(f"line {i} of a block that stands in more than one place" for i in range(13))
    some = block.split("\n")
    texts = [block, f"before\n{block}\nafter", f"{block}\n{block}", "a\nb\nc", "x\na\nb\ny", "b\nc", "a", "\n\n\n", "\n\n", block[:200], "c\n" * 70]
    texts += ["\n".join(some[3:8]), "\n".join(["new", *some[5:12], "", "}", "", "}"]), "}\n\n}\n", "\n".join(some[2:5] + some[9:11]), "\n".join(f"- {i}" for i in range(40)), "z\n" + "\n".join(f"- {i}" for i in range(3, 33))]
    more = [(500 + i, t, "en", "a", 0, "s", "b", "k") for i, t in enumerate(texts)]
    # of one id there are rows of equal texts only: in which order unequal ones come is a matter of hashes
    return [r for r in rows if r[0] != 2] + more + [more[1], more[1], more[3], (None, block, None, None, 0, None, None, None)]


def test_against_all_runs(spark, rows, tmp_path):
    rows = planted(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = lines.op2_lines(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=repr) == by_force(rows)


def test_sql_gives_the_same(rows):
    rows = [(i, r[1]) for i, r in enumerate(planted(rows))]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(lines.OP2_SQL).fetchall(), key=repr) == by_force(rows)


def test_texts_of_one_id(spark):
    """They come in the order of a hash; the copy that comes first stays, whichever it is."""
    line = "a line that is long enough to count as a repeated one"
    docs = spark.createDataFrame([(2, f"{line}\nx", None, None, 0, None, None, None), (2, f"y\n{line}", None, None, 0, None, None, None)], SCHEMA)
    texts = sorted(r["text"] for r in lines.dedup_lines(docs).collect())
    assert texts in (["x", f"y\n{line}"], [f"{line}\nx", "y"])


def test_ranks_follow_the_suffixes(spark):
    """Ranks of each level order the places as the ids of their runs' lines do."""
    rows = [(i, "\n".join(t), None, None, 0, None, None, None) for i, t in enumerate(["abcabx", "abcaby", "cabxz", "bcabca"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = {(r["ord_"], r["pos"]): (r["n1"], r["n2"]) for r in lines.line_ids(docs).collect()}
    levels = lines.suffix_levels(docs)
    assert len(levels) == 4 and levels[2].count() == 8 and levels[3].count() == 0
    for k, level in enumerate(levels):
        found = level.collect()
        run = {(r["ord_"], r["pos"]): [ids[r["ord_"], r["pos"] + i] for i in range(1 << k)] for r in found}
        rank = {(r["ord_"], r["pos"]): r["rank"] for r in found}
        assert all((rank[a] < rank[b]) == (run[a] < run[b]) for a in rank for b in rank)


def test_columns_stay_and_nulls_stay_null(spark, docs, rows, no_docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    out = lines.dedup_lines(docs).cache()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns[:-4] == docs.columns and out.count() == len(rows)
    assert out.where("text is null").count() == sum(r[1] is None for r in rows)
    assert {(r["size"], r["nth"], r["key"]) for r in out.collect()} <= {("s", "b", "k"), (None, None, None)}
    assert out.where(F.col("lines_removed") > F.col("lines_n")).count() == 0
    assert lines.dedup_lines(no_docs).count() == 0
