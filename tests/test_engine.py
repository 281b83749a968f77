import io
from contextlib import redirect_stdout
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from lamina.functions.aggregates import avg, count, count_distinct, max_, sum_
from lamina.functions.predicates import all_of, any_of, at, contains, eq, lt, not_
from lamina.functions.scalars import url_host
from lamina.operators import aggregate, first_seen, group_by, order, page, scan, top_k, where
from lamina.plans import fixtures, hits
from lamina.schema import HITS, bind, schema, tags
from lamina.sources import export_csv, ingest, read_csv, read_table, write_table

PEOPLE = schema([("Name", "String"), ("Age", "Int64"), ("City", "String")])
SF = "/root/testdata/sf0.001"


@pytest.fixture
def people(spark, tmp_path):
    def load(*rows):
        path = tmp_path / "people.csv"
        path.write_text("\n".join(["Name,Age,City", *rows]))
        return read_csv(spark, str(path), PEOPLE)

    return load


def test_csv_round_trip(spark, tmp_path, people):
    rows = people("Ada,41,Turin", '"x ""y"", z",7,', ",1,Oslo")
    done = ingest(spark, str(tmp_path / "people.csv"), str(tmp_path / "t"), PEOPLE, cluster=["Age"])
    assert done.rows == 3 and done.files >= 1 and done.bytes_read == (tmp_path / "people.csv").stat().st_size and done.bytes_written > 0 and done.rate > 0
    back = read_table(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect())) == [("", 1, "Oslo"), ("Ada", 41, "Turin"), ('x "y", z', 7, "")]
    export_csv(back.coalesce(1), str(tmp_path / "out"))
    again = read_csv(spark, str(tmp_path / "out"), PEOPLE)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_csv_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Name,Age,City\n"two\nlines, ""quoted""",5,"end\n"\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "q.csv"), PEOPLE, multi_line=True).collect()] == [('two\nlines, "quoted"', 5, "end\n")]


def test_csv_bad_cells(spark, tmp_path, people):
    with pytest.raises(Exception, match="forty"):
        people("Ada,41,Turin", "Bo,forty,Oslo").collect()
    with pytest.raises(Exception):
        people("Ada,41").collect()
    kinds = schema([("d", "Double"), ("e", "Date"), ("t", "Timestamp")])
    (tmp_path / "k.csv").write_text("2.25,2020-02-29,2020-02-29 01:02:03\r\nn/a,2020-2-9,soon\r\n")
    got = read_csv(spark, str(tmp_path / "k.csv"), kinds, header=False).collect()
    assert [str(x) for x in got[0]] == ["2.25", "2020-02-29", "2020-02-29 01:02:03"]
    assert [str(x) for x in got[1]] == ["0.0", "1970-01-01", "1970-01-01 00:00:00"]


def test_schema():
    assert len(HITS) == 105 and tags(PEOPLE)[1] == ("Age", "Int64")
    with pytest.raises(ValueError):
        schema([("a", "Int16"), ("a", "Int16")])
    with pytest.raises(ValueError):
        bind(["a"], ["Int16", "Int32"])
    assert tags(StructType([StructField("v", ArrayType(FloatType()))])) == [("v", "array<float>")]


def test_unit_fixtures(people):
    rows = people("Ada,41,Turin", "Bo,17,Oslo", "Bo,63,Turin")
    assert [tuple(r) for r in where(rows, all_of(eq("Name", "Bo"), lt("Age", 50))).collect()] == [("Bo", 17, "Oslo")]
    assert tuple(aggregate(rows, s=sum_("Age"), m=max_("Age"), u=count_distinct("Age")).first()) == (121, 63, 3)
    assert [tuple(r) for r in first_seen(rows, ["City"], by="Age", c=count()).collect()] == [("Oslo", 1), ("Turin", 2)]
    groups = first_seen(people("Ada,3,Turin", "Bo,5,Turin", "Cy,7,Oslo", "Di,2,Oslo"), ["City"], s=sum_("Age"))
    assert [tuple(r) for r in groups.collect()] == [("Turin", 8), ("Oslo", 9)]
    rows = people("Ada,9,Turin", "Bo,12,Rome", "Cy,10,Cork", "Di,11,Oslo")
    ranked = [r.Age for r in order(rows, "Age", desc=True).collect()]
    assert ranked == [12, 11, 10, 9]
    assert [r.Age for r in top_k(rows, 3, "Age").collect()] == ranked[:3]
    assert [r.Age for r in page(rows, 1, 2, "Age").collect()] == ranked[1:3]
    assert top_k(rows, 0, "Age").count() == 0


def test_no_rows(people):
    none = where(people("Ada,41,Turin"), lt("Age", 0))
    assert tuple(aggregate(none, c=count(), s=sum_("Age"), a=avg("Age")).first()) == (0, None, None)
    assert group_by(none, ["City"], c=count()).count() == 0


def test_having_of_an_odd_name(people):
    odd = group_by(people("Ada,41,Turin"), ["City"], **{"a.b`c": count()})
    assert where(odd, eq(at(1, odd.columns), 1)).count() == 1


def test_row_groups_are_skipped(spark, tmp_path):
    """Of a clustered table the reader takes the row groups alone that a filter can match."""
    rows = read_table(spark, f"{SF}/lineitem.parquet")
    write_table(rows.coalesce(1).sortWithinPartitions("l_orderkey"), str(tmp_path / "t"), group_bytes=1 << 15)
    files = list((tmp_path / "t").glob("*.parquet"))
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > 5
    found = read_table(spark, str(tmp_path / "t")).where(lt("l_orderkey", 20)).select("l_orderkey")
    assert found.count() == rows.where("l_orderkey < 20").count()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    read = plan.metrics().apply("numOutputRows").value()
    assert 0 < read < rows.count() / 4


def test_encodings(spark, tmp_path):
    """Integers as packed differences, strings by a dictionary or with shared prefixes, doubles plain."""
    names = spark.range(20_000).select((F.col("id") * 7).alias("n"), F.format_string("customer-%09d", "id").alias("s"), F.concat(F.lit("k"), F.col("id") % 5).alias("few"), (F.col("id") / 7).alias("x")).coalesce(1)
    write_table(names, str(tmp_path / "t"), delta=True)
    columns = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0)
    kinds = {columns.column(k).path_in_schema: set(columns.column(k).encodings) for k in range(4)}
    assert "DELTA_BINARY_PACKED" in kinds["n"] and "DELTA_BYTE_ARRAY" in kinds["s"] and "RLE_DICTIONARY" in kinds["few"] and kinds["x"] & {"PLAIN", "BYTE_STREAM_SPLIT"}
    assert read_table(spark, str(tmp_path / "t")).exceptAll(names).count() == 0


def test_identities(spark):
    rows = read_table(spark, f"{SF}/lineitem.parquet")
    p, q = eq("l_linenumber", 3), lt("l_quantity", 10)
    n = rows.count()
    assert where(rows, p).count() + where(rows, not_(p)).count() == n
    assert where(rows, any_of(p, q)).count() == where(rows, p).count() + where(rows, q).count() - where(rows, all_of(p, q)).count()
    assert group_by(rows, ["l_suppkey"], c=count()).agg(F.sum("c")).first()[0] == n


@pytest.mark.parametrize(("url", "host"), [("http://www.a.b/c", "a.b"), ("https://a.b", "a.b"), ("www.a", "a"), ("http://https://x/", "https:"), ("", ""), ("/x", ""), ("HTTP://a/", "HTTP:")])
def test_url_host(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(url_host("u")).first()[0] == host


def _plan(rows):
    out = io.StringIO()
    with redirect_stdout(out):
        rows.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    found = _plan(scan(spark, f"{SF}/lineitem.parquet", ["l_orderkey"], all_of(eq("l_linenumber", 3), contains("l_returnflag", "A"))))
    assert "EqualTo(l_linenumber,3)" in found and "StringContains(l_returnflag,A)" in found and "l_comment" not in found
    groups = group_by(read_table(spark, f"{SF}/lineitem.parquet"), ["l_suppkey"], c=count())
    found = _plan(page(groups, 5, 10, "c", then=("l_suppkey",)))
    assert "TakeOrderedAndProject" in found and "partial_count" in found


@pytest.mark.parametrize("name", [*fixtures.QUERIES, *hits.QUERIES])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = ({**fixtures.QUERIES, **hits.QUERIES}[name])(spark, SF)
    cursor = con.execute({**fixtures.ORACLE, **hits.ORACLE}[name])
    columns = [c[0] for c in cursor.description]
    tidy = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, ([tidy(r[c]) for c in columns] for r in got.collect()))) == sorted(map(repr, ([tidy(v) for v in r] for r in cursor.fetchall())))
