"""XPath, shredding, publishing, validation and synchronisation on small documents."""

import math

import pytest
from pyspark.sql import functions as F

from treeline.engine import Engine
from treeline.functions import text, xpath
from treeline.functions.keys import key_column, node_key
from treeline.operators import fulltext, publish, split, sync, validate
from treeline.operators.shred import Filters, shred, shred_all
from treeline.schema.xsd import compile_schema
from treeline.sources import documents, sinks
from treeline.xpath.parser import XPathError, parse

BOOK = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="lib"><xs:complexType><xs:sequence>
<xs:element name="book" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="title" type="xs:string"/><xs:element name="year" type="xs:int" minOccurs="0"/>
<xs:element name="author" type="xs:string" minOccurs="0" maxOccurs="unbounded"/><xs:any minOccurs="0"/></xs:sequence><xs:attribute name="id" type="xs:int" use="required"/><xs:anyAttribute/></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""
DOCS = [
    ("a", '<lib><book id="1" x="q"><title>One &amp; all</title><year>1999</year><author>A</author><author>B</author></book><book id="2"><title>Two</title><author>B</author></book></lib>'),
    ("b", '<lib><book id="3"><title> spaced  out </title><year>x</year><note><deep>d</deep></note></book><book><title>no id</title></book></lib>'),
    ("d", None), ("e", ""), ("f", "<other/>"),
]


@pytest.fixture(scope="module")
def model():
    return compile_schema(BOOK)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "document_id string, xml string")


@pytest.fixture(scope="module")
def engine(docs, model):
    return Engine.of_documents(docs, model)


def values(df):
    return sorted((r[0] for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "path,want",
    [
        ("/lib/book/@id", [1, 2, 3]),
        ("/lib/book[author='B']/@id", [1, 2]),
        ("/lib/book[not(year)]/@id", [2, 3]),
        ("/lib/book[author][2]/@id", [2]),
        ("/lib/book/author[last()]/text()", ["B", "B"]),
        ("//book[count(author) = 2]/title", ["One & all"]),
        ("//book[@id = 1 or @id = 3]/@id", [1, 3]),
        ("//book[year > 1990]/@x", ["q"]),
        ("//book[normalize-space(title) = 'spaced out']/@id", [3]),
        ("//author[. = 'A']/../@id", [1]),
        ("book/@id", [1, 2, 3]),
        ("/lib/book[title = author]/@id", []),
        ("/lib/book[@id = $k]/@id", [2]),
    ],
)
def test_paths(engine, path, want):
    got = values(engine.xpath(path, {"k": 2}))
    assert [str(x) for x in got] == [str(x) for x in want]


@pytest.mark.parametrize("path", ["/lib/none", "/lib/book[", "namespace::x", "/lib/book/comment()", "//book[id('x')]", "foo(1)", "/lib/book[year = 'abc']", "//book[$none]", "", "/lib/book['a"])
def test_errors(engine, path):
    with pytest.raises(XPathError):
        engine.xpath(path)


def test_strict_mode_refuses_aggregates_in_predicates(engine):
    with pytest.raises(XPathError):
        engine.xpath("//book[count(author) = 2]/title", strict=True)


def test_operator_precedence():
    assert repr(parse("1 or 2 and 3 = 4 + 5 * -6")).count("Binary") == 5
    assert parse("a/b | c").parts and parse("1 - -1").op == "-"


def test_stored_tables_answer_as_documents_do(spark, docs, model, engine, tmp_path):
    stored = Engine.of_tables(spark, shred_all(docs, model, str(tmp_path / "t")), model)
    for path in ("/lib/book[author='B']/@id", "//book[count(author) > 1]/title", "/lib/book[2]/@id"):
        assert values(stored.xpath(path)) == values(engine.xpath(path))


def test_required_values_and_bad_ones(docs, model):
    rows = shred(docs, model, "book", ["document_id", "id", "title", "year"]).collect()
    assert sorted((r[0], r[1]) for r in rows) == [("a", 1), ("a", 2), ("b", 3)]
    assert {r[1]: r[3] for r in rows} == {1: 1999, 2: None, 3: None}


def test_malformed_documents_are_errors_unless_dropped(spark, model):
    bad = spark.createDataFrame([("c", "<lib>"), ("d", '<lib><book id="4"><title>t</title></book></lib>')], "document_id string, xml string")
    with pytest.raises(Exception, match="document c is not well-formed"):
        shred(bad, model, "book", ["id"]).collect()
    assert [r[0] for r in shred(bad, model, "book", ["id"], filters=Filters(malformed="drop")).collect()] == [4]
    assert [tuple(r) for r in validate.invalid_documents(bad, model).select("document_id").collect()] == [("c",)]


def test_children_beyond_their_greatest_number_are_kept_and_reported(spark):
    few = compile_schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="t"><xs:complexType><xs:sequence><xs:element name="c" maxOccurs="2" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    df = spark.createDataFrame([("a", "<t><c>1</c><c>2</c><c>3</c></t>")], "document_id string, xml string")
    assert sorted(str(r["content"]) for r in shred(df, few, "c").collect()) == ["1", "2", "3"]
    assert [r["error"] for r in validate.invalid_documents(df, few).collect()] == ["/t/c: too many"]


def test_filters(docs, model):
    f = Filters(drop_values={"book.title": "^Two$"}, fill={"book.year": "7"})
    assert {r[0]: (r[1], r[2]) for r in shred(docs, model, "book", ["id", "title", "year"], filters=f).collect()} == {1: ("One & all", 7), 2: (None, 7), 3: (" spaced  out ", 7)}


def test_keys_are_the_same_in_both_forms(spark):
    paths = ["a/b[1]", "", "é", *(f"p/{k}" for k in range(200))]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for algorithm in ("sha1", "md5", "sha256"):
        for size in ("long", "int", "native", "debug"):
            got = [r[0] for r in df.select(key_column(F.col("p"), algorithm, size)).collect()]
            assert [bytes(x) if size == "native" else x for x in got] == [node_key(p, algorithm, size) for p in paths]


def test_publishing(engine, spark):
    made = {r["document_id"]: r["xml"] for r in publish.to_xml(engine).collect()}
    assert made["a"] == DOCS[0][1].replace("</title><year>", "</title><year>")
    assert publish.to_xml(engine, style=publish.XmlStyle(declaration=True)).where("xml like '<?xml%'").count() == 2
    keys = engine.xpath("/lib/book[@id=2]").select("book_id")
    assert [r["xml"] for r in publish.to_xml(engine, "book", keys).collect()] == ['<book id="2"><title>Two</title><author>B</author></book>']
    assert publish.to_json(engine, "book").count() == 3
    with pytest.raises(ValueError):
        publish.to_json(engine, dialect="other")


def test_validation(spark, docs, model):
    got = {(r[0], r[1]) for r in validate.invalid_values(docs, model, "book").select("document_id", "column").collect()}
    assert got == {("b", "year")}
    errors = {r[0]: r[1] for r in validate.invalid_documents(docs, model).collect()}
    assert errors["f"] == "document element other" and "missing" in errors["b"] and "a" not in errors
    pages = spark.createDataFrame([("<a/>",), ("<a>",), (None,), ("",)], "x string")
    assert [r[0] for r in pages.select(validate.well_formed("x")).collect()] == [True, False, None, False]


def test_synchronising_twice_changes_nothing(spark, docs, model):
    rows = lambda d: {"book": shred(d, model, "book", ["document_id", "id"])}
    good = docs.where("document_id in ('a', 'b')")
    tables, state = sync.synchronize({"book": rows(good.limit(0))["book"]}, sync.checksums(good.limit(0)), good, rows)
    assert tables["book"].count() == 3 and state.count() == 2
    again, after = sync.synchronize(tables, state, good, rows)
    assert again["book"].count() == 3 and {tuple(r) for r in after.collect()} == {tuple(r) for r in state.collect()}
    assert {r["status"] for r in sync.classify(state, sync.checksums(good)).collect()} == {"same"}
    gone, _ = sync.synchronize(tables, state, good.where("document_id = 'b'"), rows)
    assert values(gone["book"].select("id")) == [3]


def test_split_keeps_heads_and_skips_broken_documents(spark):
    df = spark.createDataFrame([("x", '<l v="1"><h>head</h><b id="1">p</b><b id="2"/></l>'), ("y", "<l>"), ("z", None)], "document_id string, xml string")
    with pytest.raises(Exception, match="document y is not well-formed"):
        split.split_documents(df, "/l/b", "/l/b/@id").collect()
    assert sorted(map(tuple, split.split_documents(df, "/l/b", "/l/b/@id", malformed="drop").collect())) == [("1", "x", '<l v="1"><h>head</h><b id="1">p</b></l>'), ("2", "x", '<l v="1"><h>head</h><b id="2" /></l>')]


def test_delimited_files_keep_signs_and_nulls(spark, tmp_path):
    rows = [("a\tb", "line\nend\\n", 1, bytearray(b"\x00\xff")), (None, "", None, None), ('"q", x', "\\N", -5, bytearray(b"")), ("\r", "é", 0, None)]
    schema = "a string, b string, c int, d binary"
    df = spark.createDataFrame(rows, schema)
    sinks.write_delimited(df, str(tmp_path / "t"))
    got = {(r[0], r[1], r[2], bytes(r[3]) if r[3] is not None else None) for r in documents.read_delimited(spark, str(tmp_path / "t"), schema).collect()}
    assert got == {(a, b, c, bytes(d) if d is not None else None) for a, b, c, d in rows}


def test_files_plain_and_packed(spark, tmp_path):
    import gzip
    import zipfile

    (tmp_path / "x-One.xml").write_text("<a>é</a>", encoding="utf-8")
    (tmp_path / "x-Two.xml.gz").write_bytes(gzip.compress('<?xml version="1.0" encoding="iso-8859-1"?><a>é</a>'.encode("iso-8859-1")))
    with zipfile.ZipFile(tmp_path / "x-Three.xml.zip", "w") as z:
        z.writestr("in.xml", "<a>z</a>")
    (tmp_path / "other.txt").write_text("no")
    got = {r["document_id"]: r["xml"] for r in documents.read_documents(spark, str(tmp_path), prefix="x-", case="lower").collect()}
    assert got == {"one": "<a>é</a>", "two": "<a>é</a>", "three": "<a>z</a>"}
    assert documents.list_files(str(tmp_path), pattern="One|Two") == [str(tmp_path / "x-One.xml"), str(tmp_path / "x-Two.xml.gz")]
    (tmp_path / "dic").write_text("word 3\nother,4\nsole\n\n")
    assert sorted(map(tuple, documents.read_dictionary(spark, str(tmp_path / "dic")).collect())) == [("other", 4), ("sole", 1), ("word", 3)]


@pytest.mark.parametrize("x,want", [(2.5, 3.0), (-2.5, -2.0), (0.49, 0.0), (math.inf, math.inf)])
def test_round(spark, x, want):
    assert spark.range(1).select(xpath.half_up(F.lit(x))).first()[0] == want


@pytest.mark.parametrize("start,length,want", [(2.0, 3.0, "234"), (1.5, 2.6, "234"), (0.0, 3.0, "12"), (math.nan, 3.0, ""), (1.0, math.nan, ""), (-42.0, math.inf, "12345"), (2.0, None, "2345"), (9.0, 2.0, "")])
def test_substring(spark, start, length, want):
    c = xpath.substring(F.lit("12345"), F.lit(start), F.lit(length) if length is not None else None)
    assert spark.range(1).select(c).first()[0] == want


def test_strings_and_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(xpath.string_of_number(F.lit(v))) for v in (1.0, -0.5, math.nan, math.inf)] == ["1", "-0.5", "NaN", "Infinity"]
    assert one(xpath.number_of_string(F.lit(" -1.5 "))) == -1.5 and math.isnan(one(xpath.number_of_string(F.lit("1e3"))))
    assert one(xpath.divide(F.lit(1.0), F.lit(0.0))) == math.inf and math.isnan(one(xpath.divide(F.lit(0.0), F.lit(0.0)))) and one(xpath.modulo(F.lit(-5.0), F.lit(2.0))) == -1.0
    assert one(F.array_join(text.trigrams(F.lit("ab")), " ")) == "__a _ab ab_ b__"
    for x in ("a\\tb\t\\", "\ue000", "\\\\n\n", "\\", "", "\\N"):
        assert one(text.unescape_tsv(text.escape_tsv(F.lit(x)))) == x


def test_full_text_updates_and_search(spark):
    v = spark.createDataFrame([("1", "f", "Red fox red"), ("2", "f", "blue fox"), ("3", "f", None)], "document_id string, field string, value string")
    post = fulltext.postings(v)
    assert {tuple(r) for r in fulltext.search(post, ["fox", "red"]).collect()} == {("1", 3)}
    left = fulltext.update_postings(post, spark.createDataFrame([("1",)], "document_id string"), post.limit(0))
    assert fulltext.search(left, ["fox"]).collect()[0][0] == "2"
    assert fulltext.capped_content(v.where("value is not null"), limit=3).where("length(content) <= 3").count() == 2


def test_split_reads_large_documents_piece_by_piece(spark):
    units = "".join(f'<g><h>{k}</h><b id="{k}"><x>é &amp; {k}</x></b><b id="{k}b"/></g>' for k in range(3000))
    df = spark.createDataFrame([("big", f'<l xmlns="urn:l" v="&quot;1">{units}</l>')], "document_id string, xml string")
    got = {r["document_id"]: r["xml"] for r in split.split_documents(df, "/l/g/b", "/l/g/b/@id").collect()}
    assert len(got) == 6000
    import xml.etree.ElementTree as ET

    one = ET.fromstring(got["2999b"])
    assert [x.tag for x in one.iter()] == [f"{{urn:l}}{n}" for n in ("l", "g", "h", "b")] and one.get("v") == '"1'
    assert ET.fromstring(got["7"]).find(".//{urn:l}x").text == "é & 7"


def test_round_robin_shards_are_even(spark):
    df = spark.range(1000).select(F.format_string("%05d", "id").alias("document_id")).repartition(7)
    got = {r["document_id"]: r["shard"] for r in split.shard_round_robin(df, 3).collect()}
    assert all(got[f"{k:05d}"] == k % 3 for k in range(1000))


def test_documents_as_files_keep_their_lines(spark, tmp_path):
    texts = {"a": "<x>\n one\r\n</x>", "b/c": "<y/>"}
    sinks.write_documents(spark.createDataFrame(list(texts.items()), "document_id string, xml string"), str(tmp_path / "f"))
    files = [p for p in (tmp_path / "f").rglob("*.txt")]
    assert sorted(p.read_bytes().decode().removesuffix("\n") for p in files) == sorted(texts.values())


def test_index_store_is_updated_by_documents(spark, tmp_path):
    v = lambda rows: spark.createDataFrame(rows, "document_id string, field string, value string")
    store = fulltext.PostingsStore(spark, str(tmp_path / "ix"))
    assert store.read().count() == 0
    store.update(v([("1", "f", "red fox"), ("2", "f", "blue fox")]))
    store.update(v([("2", "f", "green")]), gone=spark.createDataFrame([("1",)], "document_id string"))
    assert {(r["term"], r["document_id"]) for r in store.read().collect()} == {("green", "2")}
    assert [r["document_id"] for r in store.documents().collect()] == ["2"]
    store.compact()
    assert {(r["term"], r["document_id"]) for r in store.read().collect()} == {("green", "2")}


def test_existence(engine):
    assert [engine.exists(p).first()[0] for p in ("//book[@id=2]", "//book[@id=99]")] == [True, False]


def test_layout_of_json_and_xml(engine):
    import json

    flat = {r["key"]: r["json"] for r in publish.to_json(engine, "book").collect()}
    wide = {r["key"]: r["json"] for r in publish.to_json(engine, "book", style=publish.JsonStyle(indent=2)).collect()}
    assert all(json.loads(flat[k]) == json.loads(wide[k]) and "\n  " in wide[k] and ": " in wide[k] for k in flat)
    assert json.loads(publish.laid_out('{"a":[1.50,"x,{\\"y"],"b":{},"c":[]}', 1, " ", "\n")) == {"a": [1.5, 'x,{"y'], "b": {}, "c": []}
    assert "1.50" in publish.laid_out('{"a":[1.50]}', 1, " ", "\n")
    made = {r["document_id"]: r["xml"] for r in publish.to_xml(engine, style=publish.XmlStyle(indent=1)).collect()}["a"]
    assert made.startswith('<lib>\n <book id="1" x="q">\n  <title>One &amp; all</title>\n') and made.endswith("\n</lib>")
    with pytest.raises(ValueError):
        publish.to_xml(engine, "book", style=publish.XmlStyle(fragments=False))
