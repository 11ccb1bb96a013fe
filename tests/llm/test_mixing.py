import pytest

from weirlog.llm import mixing

from weirlog.scratch import Scratch

from cases import documents, empty


@pytest.mark.parametrize(
    ("sizes", "want"),
    [
        ([("a", 60), ("b", 60), ("c", 60)], {"a": 30, "b": 60, "c": 90}),
        ([("a", 100), ("b", 10), ("c", 10)], {"a": 60, "b": 30, "c": 30}),
        ([("a", 0), (None, 10)], {"a": 0, None: 10}),
        ([(None, 6), ("b", 1), ("a", 1)], {"a": 8 / 6, "b": 16 / 6, None: 4}),
        ([("a", 1), ("b", 100), ("c", 1), ("d", 1)], {"a": 3, "b": 94, "c": 3, "d": 3}),
        ([], {}),
    ],
)
def test_targets(spark, sizes, want):
    found = mixing.targets(spark.createDataFrame(sizes, "source string, n long"), Scratch(spark)).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in found} == want
    assert all(r["passes"] == (min(3, r["target"] * (1 + 1e-12) // r["n"]) if r["n"] else 0) for r in found if r["n"])


def test_repeated_rows_come_near_their_target(spark):
    """Equal rows share a hash; a third of all rows is one of them."""
    rows = [(1, " ".join(["w"] * 12), "hot")] * 3000 + [(10 + i, " ".join(["v"] * (1 + i % 40)), f"s{i % 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    for size, target in {(r["source_size"], r["target"]) for r in found}:
        mine = [r for r in found if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in mine) - target) <= max(r["size"] for r in mine) / 2


def test_equal_documents_with_other_columns(spark):
    """The same ones of them are taken however the rows lie."""
    rows = [(1, "a b c", "hot", i) for i in range(50)] + [(2, " ".join("x" * 200), "more", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    one, two = (sorted(r["n"] for r in mixing.mixed(docs.repartition(k)).collect()) for k in (1, 6))
    assert one == two and len(set(one)) > 1


def test_mix_comes_near_every_target(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), mine in by.items():
        assert abs(sum(r["taken"] for r in mine) - target) <= max(r["size"] for r in mine)
        assert sum(r["size"] for r in mine) == size
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixed_repeats_rows(spark):
    docs = documents(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["times"] for r in mixing.mix(docs).collect())


def test_empty_table(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_small_table_as_sql(spark, duck, tmp_path):
    docs = documents(spark, extra=False)
    docs.write.parquet(f"{tmp_path}/d")
    duck.sql(f"CREATE OR REPLACE TEMP VIEW small AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = duck.sql(mixing.SQL.replace("FROM documents)", "FROM small)")).fetchall()
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
