import hashlib
import random
import zlib

import pytest

from docfathom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, position int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def collapse(nodes):
    """The root, and for each node its siblings as (left, right) up to the root."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            run = nodes[i - i % 16 : i - i % 16 + 16]
            steps[j].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], steps


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    inner = {s: collapse([leaf(r) for r in by[s]]) for s in order}
    root, outer = collapse([inner[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = inner[s][1][i] + outer[k]
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], lowered(r[4]))) if odd else leaf(r)
            for a, b in steps:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), inner[s][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)
    out = merkle.manifest(df).selectExpr("doc_id", "leaf", "subroot", "root", "sha2(proof, 256)", "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def row(i, source, text="Some Text", lang="en"):
    return (i, source, lang, None if text is None else len(text), text)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 256, 257, 4097])
def test_sizes(spark, n):
    rows = [row(i, "a", f"Text {i}") for i in range(n)]
    assert got(spark, rows) == brute(rows)


def test_many_sources(spark):
    rng = random.Random(1)
    rows = [row(rng.randrange(5000), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(300)] + [None, "", "é", "Z", "z"]), "T" * (i % 7)) for i in range(3000)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [row(3, "a"), row(3, "a"), row(3, "a", "Other"), row(None, "a"), row(None, None, None, None), row(None, "a"), row(5, None, ""), row(7, "", "É" * 200_000 + "A"), row(-9, "a", "A\x00B\nC")]
    rows += [row(12, "same", "Equal")] * 700
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df).count() == 0


def test_tampering_shows(spark):
    rows = [row(i, f"s{i % 3}", "No capitals" if i % 2 else "none") for i in range(200)]
    out = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA), carry=("position",)).collect()}
    assert {i for i, r in out.items() if not r.verified} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0 and i % 2}
    assert all(r.carry0 == 7 for r in out.values())


def test_sql(spark):
    import duckdb

    from docfathom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_merkle_manifest"])
    columns = [c[0] for c in want.description]
    out = queries.QUERIES["op11_merkle_manifest"](spark, sf).select(*columns)
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())
