"""Work that grows with the documents is done once, over columns and in small pieces."""

import xml.etree.ElementTree as ET
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import SF
from treeline.engine import Engine
from treeline.operators import publish, shred
from treeline.schema.types import parsed
from treeline.schema.xsd import compile_schema
from treeline.sources import fixtures

BOOK = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="lib"><xs:complexType><xs:sequence>
<xs:element name="book" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="title" type="xs:string"/><xs:element name="year" type="xs:int" minOccurs="0"/>
<xs:element name="author" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="rank" type="xs:int"/></xs:extension></xs:simpleContent></xs:complexType></xs:element><xs:any minOccurs="0"/></xs:sequence>
<xs:attribute name="id" type="xs:int" use="required"/><xs:anyAttribute/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""
TREE = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="n"><xs:complexType><xs:sequence>
<xs:element name="leaf" minOccurs="0" maxOccurs="unbounded" type="xs:string"/><xs:element ref="n" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="k" type="xs:int"/></xs:complexType></xs:element></xs:schema>"""
BOOKS = [
    '<lib><book id="1" x="q"><title>One &amp; all</title><year>1999</year><author rank="1">A</author><author>B</author></book><book><title>no id</title><author>C</author></book><book id="2"><title>Two<b>!</b></title><author> </author></book></lib>',
    '<lib><book id="3"><title></title></book><book id="4"><title>t</title><note><deep>d</deep></note><title>u</title></book></lib>', "<other/>", "<lib/>",
    '<lib xmlns="urn:x" xmlns:y="urn:y"><book y:id="5"><title xml:lang="en">in a namespace</title><y:author>D</y:author></book></lib>', '<lib><book id="6"><title><![CDATA[<x>]]></title><author rank="">E</author></book></lib>',
]
TREES = ['<n k="1"><leaf>a</leaf><n k="2"><leaf>b</leaf><n k="3"/><leaf>c</leaf></n><n><leaf>d</leaf></n></n>', "<n/>"]


@pytest.mark.parametrize("schema,docs", [(BOOK, BOOKS), (TREE, TREES)])
@pytest.mark.parametrize("order", [False, True])
def test_columns_of_many_documents_are_the_rows_of_each(schema, docs, order):
    """F10 and the other queries that shred: rows of whole pieces are those of the walk node by node."""
    model = compile_schema(schema)
    wanted = {t: [f.name for f in model.tables[t].fields] for t in model.reachable(model.root)}
    walker = shred.Walker(model, wanted, order)
    found = [(f"d{k}", ET.fromstring(x), shred.is_plain(x)) for k, x in enumerate(docs)]
    got = walker.columns(found)
    alone = [walker.rows(d, root) for d, root, _ in found]
    for t in wanted:
        cells, counts = got[t]
        assert counts == [len(rows[t]) for rows in alone]
        rows = list(zip(*cells))
        for k, one in enumerate(alone):
            mine = rows[sum(counts[:k]) : sum(counts[: k + 1])]
            if not order:
                assert sorted(map(repr, mine)) == sorted(repr(tuple(r)) for r in one[t])
                continue
            # Places may be other numbers, but say the same of what is before what.
            assert [r[:-2] for r in sorted(mine, key=lambda r: r[-2])] == [tuple(r[:-2]) for r in sorted(one[t], key=lambda r: r[-2])]
            for a in mine:
                for b in mine:
                    assert (a[-2] < b[-2]) == (a[-1] < b[-2] or a[-1] >= b[-1] and a[-2] < b[-2])


def test_spans_of_different_tables_hold_each_other(spark):
    """what lies before a node ends before it begins, also where tables are told apart."""
    model = compile_schema(BOOK)
    walker = shred.Walker(model, {"book": ["id"], "author": ["content"]}, True)
    got = walker.columns([("a", ET.fromstring(BOOKS[0]), True)])
    books, authors = (list(zip(*got[t][0])) for t in ("book", "author"))
    inside = [(b[0], a[0]) for b in books for a in authors if b[1] < a[1] and a[2] <= b[2]]
    assert sorted(inside, key=str) == [("1", "A"), ("1", "B"), ("2", None)]
    assert [a[0] for a in authors if a[2] < next(b[1] for b in books if b[0] == "2")] == ["A", "B"]


def test_few_trees_and_rows_are_held_at_a_time(monkeypatch):
    """a batch from the JVM is parsed and leaves in pieces."""
    monkeypatch.setattr(shred, "CHUNK", 200)
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(40)]), pa.array(["<n>" + "x" * 90 + "</n>"] * 40)], names=["document_id", "xml"])
    sizes = [len(found) for found in shred.trees([batch], "raise")]
    assert sum(sizes) == 40 and max(sizes) <= 3
    monkeypatch.setattr(shred, "BATCH", 1000)
    assert sum(b.num_rows for b in shred.gathered([batch.slice(k, 4) for k in range(0, 40, 4)])) == 40


def test_batches_to_workers_are_small(spark):
    """F11."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    shred.shred(spark.createDataFrame([("a", TREES[0])], "document_id string, xml string"), compile_schema(TREE), "n", ["k"])
    assert spark.conf.get(name) == "8m"


@pytest.mark.parametrize("name", ["pub1_round_trip", "syn5_index_update", "snk3_append", "snk5_delete_cascade", "xsd13_orphans", "snk4_upsert", "srt1_document_order"])
def test_documents_are_made_and_parsed_once(spark, monkeypatch, name):
    """F1, F2, F3, F4, F8, F9, F11: each document is made once in a query."""
    made = spark.sparkContext.accumulator(0)

    def counted(text):
        made.add(1)
        return text

    seen = F.udf(counted, "string").asNondeterministic()
    real = fixtures.documents
    monkeypatch.setattr(fixtures, "documents", lambda *a: real(*a).withColumn("xml", seen("xml")))
    __spark_entry__.queries()[name](spark, SF).collect()
    assert made.value == fixtures.table(spark, SF, "part" if name.startswith("syn5") else "customer").count()


def test_line_items_are_brought_together_as_values(spark):
    """F5, F7, F12 to F19: what is shuffled by order has no XML yet."""
    plan = fixtures.geo(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression [l_orderkey") :]
    assert "<lineitem" in plan and "<lineitem" not in below


@pytest.mark.parametrize("name,key", [("catalog", "p_partkey"), ("log", "event_id")])
def test_rows_of_small_files_are_spread(spark, name, key):
    """documents of a table whose file is one task's are made by many."""
    assert f"RepartitionByExpression [{key}" in fixtures.MAKERS[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_existence_needs_no_other_columns(spark, monkeypatch):
    """a question whether there are nodes takes only keys and what the path compares."""
    asked = []
    real = shred.raw_rows
    monkeypatch.setattr(shred, "raw_rows", lambda docs, model, table, columns, *a: asked.append(set(columns)) or real(docs, model, table, columns, *a))
    e = Engine.of_documents(fixtures.documents(spark, SF, "geo"), fixtures.model("geo"))
    assert e.exists("/geo/customer/order[@totalprice > 100000]").first()[0] is True
    assert e.exists("/geo/customer/order[@totalprice < 0]").first()[0] is False
    assert asked == [{"document_id", "order_id", "totalprice"}] * 2


def test_json_of_values_is_that_of_to_json(spark):
    """values are written without a generator of JSON for each."""
    texts = ["a", "", 'q"', "b\\", "t\tn\n", "é/\x7f ", "\x01", None]
    rows = [(t, k, Decimal(k) / 100, k % 2 == 0, datetime(1999 + k, 1, 2, 3, 4, 5, k)) for k, t in enumerate(texts)] + [(None,) * 5, ("x", -5, Decimal("-0.05"), True, datetime(1, 1, 1))]
    df = spark.createDataFrame(rows, "s string, i bigint, d decimal(18,2), b boolean, m timestamp_ntz")
    want = df.select(*[F.to_json(F.struct(F.col(f.name).alias("v")), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}) for f in df.schema]).collect()
    got = df.select(*[publish.json_value(F.col(f.name), f.dataType) for f in df.schema]).collect()
    assert [[f'{{"v":{x}}}' if x is not None else "{}" for x in r] for r in got] == [list(r) for r in want]


@pytest.mark.parametrize("nulls", [False, True])
def test_rows_without_others_below_are_whole_objects(spark, nulls):
    """F6."""
    docs = spark.createDataFrame([("a", BOOKS[0])], "document_id string, xml string")
    e = Engine.of_documents(docs, compile_schema(BOOK))
    authors = [r["json"] for r in publish.to_json(e, "author", style=publish.JsonStyle(nulls=nulls)).collect()]
    assert sorted(authors) == sorted(['{"author":{"$":"A","@rank":1}}', '{"author":{"$":"B"%s}}' % (',"@rank":null' if nulls else "")] + ['{"author":{%s}}' % ('"$":null,"@rank":null' if nulls else "")])


def test_whole_numbers_of_the_range_of_their_type(spark):
    """a range that is the Spark type's own needs no second number."""
    df = spark.createDataFrame([("9223372036854775807",), ("9223372036854775808",), (" -7 ",), ("+3",), ("1.0",), ("1e3",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(parsed(F.col("t"), "long")).collect()] == [9223372036854775807, None, -7, 3, None, None, None, None]
    assert "decimal" not in df.select(parsed(F.col("t"), "long"))._jdf.queryExecution().optimizedPlan().toString()


def test_moments_with_and_without_zone(spark):
    df = spark.createDataFrame([("2001-02-03T04:05:06",), ("2001-02-03T04:05:06.5",), ("2001-02-03T04:05:06Z",), ("2001-02-03T04:05:06+01:00",), ("-2001-02-03T04:05:06",)], "t string")
    got = [r[0] for r in df.select(parsed(F.col("t"), "dateTime").cast("string")).collect()]
    assert got[:4] == ["2001-02-03 04:05:06", "2001-02-03 04:05:06.5", "2001-02-03 04:05:06", "2001-02-03 03:05:06"]



def test_text_of_amounts_is_that_of_decimals(spark):
    """F5, F7, F12 to F19: hundredths are written without decimals, others as before."""
    values = [0.0, -0.0, 0.01, 0.015, 1.005, 2.675, -3.5, 99999.99, 1e12 + 0.25, 1e14, 1e15, 0.29, 0.57, 1.1, None, 0.999, 0.995, 5e-324, 9999999999999.99, *(k / 100 for k in range(0, 10000, 7))]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert df.where(~fixtures.money("x").eqNullSafe(F.col("x").cast("decimal(18,2)").cast("string"))).count() == 0
    assert dict(df.select(fixtures.money("x")).dtypes).popitem()[1] == "string"


def test_first_rows_leave_at_once():
    """a search that ends with the first row does not wait for a whole batch."""
    part = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["k"])
    taken = []
    assert next(shred.gathered(taken.append(1) or part for _ in range(100))).num_rows == 2 and len(taken) == 1


def test_lists_of_arrow_arrays_are_those_of_arrow():
    """nodes are read without a scalar for each value, also from slices and with nulls."""
    arrays = [
        pa.array([1, None, -(1 << 63), (1 << 63) - 1, 0]), pa.array([3, 2, 1, 0, 5], pa.int32()), pa.array(["a", None, "é", "", "z"]), pa.array([None] * 5, pa.string()),
        pa.array([["a", None], [], ["b"], ["c", "d"], [None]]), pa.array([["a"], None, [], ["b"], []]), pa.array([[{"place": 1, "text": "x"}], None, [], None, []]), pa.array([], pa.list_(pa.string())),
    ]
    for a in arrays:
        for x in (a, a[1:], a[1:3], a[:0]):
            assert publish._list(x) == x.to_pylist()
