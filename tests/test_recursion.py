"""Recursive schemas, order of children and lexical forms, against a parser's view of the same documents."""

import random
import xml.etree.ElementTree as ET

import pytest

from treeline.engine import Engine
from treeline.operators import publish
from treeline.operators.shred import shred_all
from treeline.schema.xsd import compile_schema
from treeline.xpath.parser import XPathError

SECTIONS = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:complexType name="section"><xs:sequence><xs:element name="title" type="xs:string"/><xs:element name="p" type="xs:string" minOccurs="0" maxOccurs="unbounded"/><xs:element name="section" type="section" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="id" type="xs:int"/></xs:complexType>
<xs:element name="doc"><xs:complexType><xs:sequence><xs:element name="p" type="xs:string" minOccurs="0" maxOccurs="unbounded"/><xs:element name="section" type="section" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="k" type="xs:string"/></xs:complexType></xs:element></xs:schema>"""
MIXED = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="t"><xs:complexType><xs:sequence>
<xs:element name="a" type="xs:string" minOccurs="0"/><xs:element name="c" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:attribute name="x" type="xs:int"/></xs:complexType></xs:element><xs:element name="b" type="xs:dateTime" minOccurs="0"/>
<xs:choice minOccurs="0" maxOccurs="unbounded"><xs:element name="d" type="xs:date"/><xs:element name="e" type="xs:decimal"/></xs:choice></xs:sequence></xs:complexType></xs:element></xs:schema>"""


def section(r, depth, ids):
    ids.append(len(ids))
    me = ids[-1]
    inner = "".join(f"<p>{r.choice('xyz')}</p>" for _ in range(r.randint(0, 2)))
    inner += "".join(section(r, depth - 1, ids) for _ in range(r.randint(0, 2) if depth else 0))
    return f'<section id="{me}"><title>{r.choice("abc")}</title>{inner}</section>'


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = {}
    for d in range(6):
        ids = []
        out[str(d)] = f'<doc k="{d}"><p>x</p>' + "".join(section(r, 5, ids) for _ in range(2)) + "</doc>"
    return out


@pytest.fixture(scope="module")
def engine(spark, texts):
    return Engine.of_documents(spark.createDataFrame(list(texts.items()), "document_id string, xml string"), compile_schema(SECTIONS))


def nodes(texts, question):
    return sorted(x for d, t in texts.items() for x in question(ET.fromstring(t), d))


PATHS = {
    "//section/@id": lambda t, d: [s.get("id") for s in t.iter("section")],
    "/doc/section/section/section/section/@id": lambda t, d: [s.get("id") for s in t.findall("section/section/section/section")],
    "//p": lambda t, d: [p.text for p in t.iter("p")],
    "//section//p": lambda t, d: [p.text for s in t.iter("section") for p in s.findall("p")],
    "//section/section/title": lambda t, d: [s.find("title").text for q in t.iter("section") for s in q.findall("section")],
    "//section[title='a']//section/@id": lambda t, d: sorted({s.get("id") for q in t.iter("section") if q.find("title").text == "a" for s in q.iter("section") if s is not q}),
    "//section[.//p='z']/@id": lambda t, d: [q.get("id") for q in t.iter("section") if any(p.text == "z" for p in q.iter("p"))],
    "//section[not(.//section)]/@id": lambda t, d: [q.get("id") for q in t.iter("section") if q.find("section") is None],
    "//section[count(section) = 2]/@id": lambda t, d: [q.get("id") for q in t.iter("section") if len(q.findall("section")) == 2],
    "//p[.='z']/parent::section/@id": lambda t, d: [q.get("id") for q in t.iter("section") if any(p.text == "z" for p in q.findall("p"))],
    "//p[.='z']/ancestor::section/@id": lambda t, d: [q.get("id") for q in t.iter("section") if any(p.text == "z" for p in q.iter("p"))],
    "//section[2]/@id": lambda t, d: [s[1].get("id") for s in (q.findall("section") for q in t.iter()) if len(s) > 1],
    "//section[../@id = 1]/@id": lambda t, d: [s.get("id") for q in t.iter("section") if q.get("id") == "1" for s in q.findall("section")],
    "//section[2]//p": lambda t, d: [p.text for p in sorted({p for q in t.iter() for s in q.findall("section")[1:2] for p in s.iter("p")}, key=id)],
    "/doc[@k='2']//section/@id": lambda t, d: [s.get("id") for s in t.iter("section")] if d == "2" else [],
}


@pytest.mark.parametrize("path", PATHS)
def test_nodes_at_any_depth(engine, texts, path):
    df = engine.xpath(path)
    assert sorted(str(r[df.columns[-1]]) for r in df.collect()) == nodes(texts, PATHS[path])


def test_count_at_any_depth(engine, texts):
    got = {r["document_id"]: r["count"] for r in engine.xpath("count(//section)", keys=True).collect()}
    assert got == {d: len(list(ET.fromstring(t).iter("section"))) for d, t in texts.items()}


def test_parent_in_a_predicate_of_any_depth_is_an_error(engine):
    with pytest.raises(XPathError):
        engine.xpath("/doc/descendant::section[../@id = 1]/@id")


def test_recursive_documents_are_published_whole(spark, engine, texts, tmp_path):
    assert {r["document_id"]: r["xml"] for r in publish.to_xml(engine).collect()} == texts
    docs = spark.createDataFrame(list(texts.items()), "document_id string, xml string")
    stored = Engine.of_tables(spark, shred_all(docs, engine.model, str(tmp_path / "t")), engine.model)
    assert {r["document_id"]: r["xml"] for r in publish.to_xml(stored).collect()} == texts
    import json

    def count(x):
        return sum(1 + count(s) for s in x.get("section", []))

    for r in publish.to_json(engine).collect():
        assert count(json.loads(r["json"])["doc"]) == len(list(ET.fromstring(texts[r["document_id"]]).iter("section")))


ORDERED = {
    "1": "<t><a>1</a><c/><c x=\"2\"/><b>2015-10-21T01:02:03.5+01:00</b></t>",
    "2": "<t><c x=\"1\"/><b>2015-10-21T01:02:03</b><d>2015-10-21+01:00</d><e>1.50</e><d>2016-01-01</d><e>2</e></t>",
    "3": "<t/>",
}


def test_children_come_in_the_order_of_the_schema(spark, tmp_path):
    docs = spark.createDataFrame(list(ORDERED.items()), "document_id string, xml string")
    model = compile_schema(MIXED)
    e = Engine.of_documents(docs, model)
    assert {r["document_id"]: r["xml"] for r in publish.to_xml(e).collect()} == ORDERED
    assert [str(r[0]) for r in e.xpath("/t[d='2015-10-21+01:00']/b").collect()] == ["2015-10-21 01:02:03"]
    stored = Engine.of_tables(spark, shred_all(docs, model, str(tmp_path / "t")), model)
    made = {r["document_id"]: r["xml"] for r in publish.to_xml(stored).collect()}
    # Typed tables have moments, not how they were written.
    assert made["1"] == "<t><a>1</a><c/><c x=\"2\"/><b>2015-10-21T00:02:03.5</b></t>" and made["2"] == "<t><c x=\"1\"/><b>2015-10-21T01:02:03</b><d>2015-10-21</d><e>1.5</e><d>2016-01-01</d><e>2</e></t>"


def test_long_labels_of_enumerations(spark):
    label = "x" * 100
    model = compile_schema(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="t"><xs:complexType><xs:attribute name="a"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="{label}"/></xs:restriction></xs:simpleType></xs:attribute></xs:complexType></xs:element></xs:schema>')
    docs = spark.createDataFrame([("1", f'<t a="{label}"/>'), ("2", f'<t a="{label[:63]}"/>')], "document_id string, xml string")
    from treeline.operators import validate

    assert [r["document_id"] for r in validate.invalid_values(docs, model, "t").collect()] == ["2"]
