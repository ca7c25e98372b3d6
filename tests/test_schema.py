"""The schema compiler, exports and types."""

import json

import pytest

from treeline.engine import Engine
from treeline.operators import publish, validate
from treeline.schema import ddl, jsonschema
from treeline.schema.model import SchemaModel
from treeline.schema.types import common_type, spark_type
from treeline.schema.xsd import SchemaError, compile_schema, diagnose, widest
from treeline.sources import fixtures

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'


def xsd(body, attributes=""):
    return f"<xs:schema {XS} {attributes}>{body}</xs:schema>"


GROUPS = xsd(
    """<xs:element name="r"><xs:complexType><xs:sequence><xs:group ref="g"/><xs:element ref="head" maxOccurs="unbounded"/></xs:sequence><xs:attributeGroup ref="ag"/></xs:complexType></xs:element>
    <xs:attributeGroup name="ag"><xs:attribute name="x" type="xs:int" use="required"/><xs:attributeGroup ref="more"/></xs:attributeGroup>
    <xs:attributeGroup name="more"><xs:attribute name="y" type="xs:date" default="2000-01-01"/></xs:attributeGroup>
    <xs:group name="g"><xs:choice><xs:element name="a" type="xs:string"/><xs:element name="b" type="xs:int"/></xs:choice></xs:group>
    <xs:element name="head" abstract="true" type="xs:string"/><xs:element name="one" substitutionGroup="head" type="xs:string"/><xs:element name="two" substitutionGroup="head" type="xs:string"/>"""
)


def test_groups_substitution_and_choice():
    m = compile_schema(GROUPS, "r")
    t = m.tables["r"]
    assert [(f.xml_name, f.required) for f in t.content] == [("a", False), ("b", False), ("x", True), ("y", False)]
    assert t.field("y").default == "2000-01-01" and t.field("x").xs_type == "int"
    assert {e.xml_name for e in m.children("r")} == {"one", "two"} and all(e.repeated for e in m.children("r"))


def test_simple_types_lists_unions_facets():
    m = compile_schema(
        xsd(
            """<xs:simpleType name="p"><xs:restriction base="xs:int"><xs:minInclusive value="1"/><xs:maxInclusive value="9"/></xs:restriction></xs:simpleType>
            <xs:simpleType name="q"><xs:restriction base="p"><xs:maxInclusive value="5"/></xs:restriction></xs:simpleType>
            <xs:simpleType name="u"><xs:union memberTypes="xs:int xs:double"/></xs:simpleType><xs:simpleType name="l"><xs:list itemType="xs:int"/></xs:simpleType>
            <xs:simpleType name="e"><xs:restriction base="xs:string"><xs:enumeration value="x"/><xs:enumeration value="y"/></xs:restriction></xs:simpleType>
            <xs:element name="r"><xs:complexType><xs:attribute name="q" type="q"/><xs:attribute name="u" type="u"/><xs:attribute name="l" type="l"/><xs:attribute name="e" type="e"/>
            <xs:attribute name="d"><xs:simpleType><xs:restriction base="xs:decimal"><xs:totalDigits value="8"/><xs:fractionDigits value="3"/></xs:restriction></xs:simpleType></xs:attribute></xs:complexType></xs:element>"""
        )
    )
    t = m.tables["r"]
    assert t.field("q").facets == {"minInclusive": "1", "maxInclusive": "5"}
    assert t.field("u").xs_type == "double" and t.field("l").is_list and t.field("e").enums == ["x", "y"]
    assert m.enumerations == {"enum_r_e": ["x", "y"]}
    assert {f.name: f.type(m.options) for f in t.content} == {"q": "int", "u": "double", "l": "string", "e": "string", "d": "decimal(8,3)"}


def test_extension_restriction_and_simple_content():
    m = compile_schema(
        xsd(
            """<xs:complexType name="base"><xs:sequence><xs:element name="a" type="xs:int"/></xs:sequence><xs:attribute name="k" type="xs:string"/></xs:complexType>
            <xs:complexType name="more"><xs:complexContent><xs:extension base="base"><xs:sequence><xs:element name="b" type="xs:date"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
            <xs:complexType name="less"><xs:complexContent><xs:restriction base="base"><xs:sequence/></xs:restriction></xs:complexContent></xs:complexType>
            <xs:complexType name="text"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="unit" type="xs:string"/></xs:extension></xs:simpleContent></xs:complexType>
            <xs:element name="r"><xs:complexType><xs:sequence><xs:element name="m" type="more"/><xs:element name="l" type="less"/><xs:element name="t" type="text"/></xs:sequence></xs:complexType></xs:element>"""
        )
    )
    names = lambda t: [f.xml_name for f in m.tables[t].content]
    assert sorted(names("m")) == ["a", "b", "k"] and names("l") == ["k"] and sorted(names("t")) == ["", "unit"]
    assert m.tables["t"].field("content").xs_type == "decimal"


def test_one_name_with_two_types_is_one_table_and_recursion_ends():
    m = compile_schema(
        xsd(
            """<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="n" type="node"/><xs:element name="x"><xs:complexType><xs:sequence><xs:element name="n"><xs:complexType><xs:attribute name="z" type="xs:int" use="required"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element>
            <xs:complexType name="node"><xs:sequence><xs:element name="n" type="node" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="v" type="xs:int" use="required"/></xs:complexType>"""
        )
    )
    t = m.tables["n"]
    assert t.collided and {f.xml_name for f in t.content} == {"v", "z"} and not any(f.required for f in t.content)
    assert {e.parent for e in m.parents("n")} == {"r", "x", "n"}
    assert SchemaModel.from_json(m.to_json()) == m


def test_includes_are_followed_once(tmp_path):
    (tmp_path / "a.xsd").write_text(xsd('<xs:include schemaLocation="b.xsd"/><xs:element name="r" type="t"/>'))
    (tmp_path / "b.xsd").write_text(xsd('<xs:include schemaLocation="a.xsd"/><xs:complexType name="t"><xs:attribute name="k" type="xs:int"/></xs:complexType>'))
    assert compile_schema(str(tmp_path / "a.xsd")).tables["r"].field("k").xs_type == "int"


def test_errors():
    for bad in ("<a", "<a/>", xsd(""), xsd('<xs:element name="r"><xs:complexType><xs:sequence><xs:element ref="none"/></xs:sequence></xs:complexType></xs:element>'), xsd('<xs:element name="r"><xs:complexType><xs:attribute name="k" type="nope"/></xs:complexType></xs:element>')):
        with pytest.raises(SchemaError):
            compile_schema(bad)
        assert diagnose(bad)
    assert diagnose(fixtures.GEO) == []


def test_keys_and_classes_of_tables():
    m = fixtures.model("geo")
    assert [t.name for t in m.ordered()][-1] == "geo" or m.refs("geo") == 0
    assert m.flags("customer")["list_holder"] and m.flags("geo")["bridge"] and not m.flags("lineitem")["list_holder"]
    assert m.identities[0].table == "order" and m.identities[0].columns == ["key"]
    s = fixtures.model("shared")
    assert [e.column for e in s.parents("contact")] == ["buyer_id", "seller_id"]


def test_widest_facets_and_common_types():
    assert widest([{"maxInclusive": "5", "minInclusive": "2"}, {"maxInclusive": "50", "minInclusive": "-3"}]) == {"maxInclusive": "50", "minInclusive": "-3"}
    assert widest([{"maxLength": "5"}, {}]) == {}
    assert common_type(["byte", "long"]) == "long" and common_type(["int", "date"]) == "string" and common_type(["unsignedByte", "int"]) == "integer"
    assert spark_type("unsignedLong") == "decimal(20,0)" and spark_type("integer", integer="decimal") == "decimal(38,0)" and spark_type("gYear") == "date"


def test_statements_parse(spark):
    parser = spark._jsparkSession.sessionState().sqlParser()
    for name in fixtures.SCHEMAS:
        m = fixtures.model(name)
        for t in m.tables:
            parser.parsePlan(ddl.create_table(m, t))
            if view := ddl.shared_view(m, t):
                parser.parsePlan(view)
        assert ddl.ddl(m, drop=True).count("CREATE TABLE") == len(m.tables)
    assert "CREATE VIEW `contact_of`" in ddl.ddl(fixtures.model("shared"))
    spark.sql("DROP TABLE IF EXISTS part")
    assert "RLIKE" in ddl.create_table(fixtures.model("catalog"), "part") and ddl.statistics(fixtures.model("geo"))["tables"] == 5


def test_json_schemas():
    m = fixtures.model("catalog")
    for dialect in ("object", "column", "relational"):
        for draft in jsonschema.DRAFTS:
            assert json.loads(jsonschema.json_schema_text(m, dialect=dialect, draft=draft))["$schema"] == jsonschema.DRAFTS[draft]
    part = jsonschema.json_schema(m)["$defs"]["part"]
    assert part["properties"]["size"] == {"type": "integer", "minimum": 1, "maximum": 25}
    assert part["properties"]["brand"]["pattern"] == "^(?:Brand#[1-3][0-9]*)$"
    assert part["properties"]["tag"]["type"] == "array" and "@key" in part["required"]
    assert jsonschema.json_schema(m, "column")["$defs"]["part"]["properties"]["size"]["type"] == "array"
    strict = compile_schema(xsd('<xs:element name="r"><xs:complexType><xs:attribute name="k" fixed="7"><xs:simpleType><xs:restriction base="xs:int"><xs:maxExclusive value="9"/></xs:restriction></xs:simpleType></xs:attribute></xs:complexType></xs:element>'))
    old = jsonschema.json_schema(strict, draft="draft-04")["definitions"]["r"]["properties"]["@k"]
    new = jsonschema.json_schema(strict)["$defs"]["r"]["properties"]["@k"]
    assert old["maximum"] == 9 and old["exclusiveMaximum"] is True and old["enum"] == ["7"]
    assert new["exclusiveMaximum"] == 9 and new["const"] == "7"


SHOP = f"""<xs:schema {XS}><xs:complexType name="money"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="cur" type="xs:string" use="required"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:element name="shop"><xs:complexType><xs:sequence><xs:element name="price" type="money"/><xs:element name="old" type="money" minOccurs="0" maxOccurs="2"/><xs:element name="note" type="xs:string" minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


def test_single_simple_content_inline(spark):
    docs = spark.createDataFrame([("1", '<shop><price cur="EUR">1.50</price><old cur="DM">3</old><note>n</note></shop>'), ("2", '<shop><price cur="USD">2</price></shop>')], "document_id string, xml string")
    m = compile_schema(SHOP, inline_simple=True)
    assert set(m.tables) == {"shop", "old"} and [f.name for f in m.tables["shop"].content] == ["price", "price_cur", "note"]
    e = Engine.of_documents(docs, m)
    assert sorted(r[0] for r in e.xpath("/shop/price/@cur").collect()) == ["EUR", "USD"]
    assert [r[0] for r in e.xpath("/shop[price/@cur='EUR']/note").collect()] == ["n"]
    assert [float(r[0]) for r in e.xpath("/shop[price > 1.7]/price").collect()] == [2.0]
    assert {r["document_id"]: r["xml"] for r in publish.to_xml(e).collect()} == {r[0]: r[1] for r in docs.collect()}


CONTENT = f"""<xs:schema {XS}><xs:element name="t"><xs:complexType><xs:sequence><xs:element name="a" type="xs:string"/><xs:choice minOccurs="0" maxOccurs="3"><xs:element name="b" type="xs:int"/><xs:element name="c" type="xs:int" maxOccurs="2"/></xs:choice><xs:element name="u"><xs:complexType><xs:all><xs:element name="x" type="xs:int"/><xs:element name="y" type="xs:int" minOccurs="0"/></xs:all></xs:complexType></xs:element><xs:any minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


@pytest.mark.parametrize(
    "xml,error",
    [
        ("<t><a/><u><x/></u></t>", None),
        ("<t><a/><b>1</b><c>1</c><c>2</c><b/><u><y/><x/></u><z/><z/></t>", None),
        ("<t><a/><u><x/><y/></u></t>", None),
        ("<t><u><x/></u><a/></t>", "/t: order of children"),
        ("<t><a/><b/><b/><b/><b/><u><x/></u></t>", "/t/b: too many"),
        ("<t><a/><u><y/></u></t>", "/t/u/x: missing"),
        ("<t><a/><b/></t>", "/t/u: missing"),
    ],
)
def test_order_of_children(xml, error):
    got = validate.structural_errors(compile_schema(CONTENT), xml)
    assert (error in got) if error else not got


def test_redefined_and_overridden_types(tmp_path):
    (tmp_path / "base.xsd").write_text(f'<xs:schema {XS}><xs:complexType name="p"><xs:sequence><xs:element name="a" type="xs:string"/></xs:sequence></xs:complexType><xs:simpleType name="s"><xs:restriction base="xs:string"/></xs:simpleType></xs:schema>')
    body = '<xs:element name="r" type="p"/>'
    (tmp_path / "re.xsd").write_text(f'<xs:schema {XS}><xs:redefine schemaLocation="base.xsd"><xs:complexType name="p"><xs:complexContent><xs:extension base="p"><xs:sequence><xs:element name="b" type="s"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType></xs:redefine>{body}</xs:schema>')
    (tmp_path / "ov.xsd").write_text(f'<xs:schema {XS}><xs:override schemaLocation="base.xsd"><xs:complexType name="p"><xs:sequence><xs:element name="z" type="s"/></xs:sequence></xs:complexType></xs:override>{body}</xs:schema>')
    assert [f.name for f in compile_schema(str(tmp_path / "re.xsd")).tables["r"].content] == ["a", "b"]
    assert [f.name for f in compile_schema(str(tmp_path / "ov.xsd")).tables["r"].content] == ["z"]


def test_blocked_substitution():
    def schema(block):
        return f"""<xs:schema {XS}><xs:complexType name="b" {block}><xs:sequence/></xs:complexType><xs:complexType name="d"><xs:complexContent><xs:extension base="b"><xs:attribute name="k" type="xs:int"/></xs:extension></xs:complexContent></xs:complexType>
        <xs:element name="h" type="b"/><xs:element name="m" type="d" substitutionGroup="h"/><xs:element name="r"><xs:complexType><xs:sequence><xs:element ref="h"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""

    assert set(compile_schema(schema(""), root="r").tables) == {"r", "h", "m"}
    assert set(compile_schema(schema('block="extension"'), root="r").tables) == {"r", "h"}


def test_one_name_in_two_namespaces(tmp_path):
    (tmp_path / "b.xsd").write_text(f'<xs:schema {XS} targetNamespace="urn:b"><xs:complexType name="p"><xs:sequence><xs:element name="y" type="xs:int"/></xs:sequence></xs:complexType><xs:simpleType name="s"><xs:restriction base="xs:int"/></xs:simpleType></xs:schema>')
    (tmp_path / "a.xsd").write_text(
        f'<xs:schema {XS} xmlns:a="urn:a" xmlns:b="urn:b" targetNamespace="urn:a"><xs:import namespace="urn:b" schemaLocation="b.xsd"/><xs:complexType name="p"><xs:sequence><xs:element name="x" type="a:s"/><xs:element name="z" type="b:s"/></xs:sequence></xs:complexType>'
        '<xs:simpleType name="s"><xs:restriction base="xs:date"/></xs:simpleType><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="one" type="a:p"/><xs:element name="two" type="b:p"/></xs:sequence></xs:complexType></xs:element></xs:schema>'
    )
    m = compile_schema(str(tmp_path / "a.xsd"))
    assert [(f.name, f.xs_type) for f in m.tables["one"].content] == [("x", "date"), ("z", "int")]
    assert [(f.name, f.xs_type) for f in m.tables["two"].content] == [("y", "int")]


def test_closure_of_includes_with_a_cycle(tmp_path):
    (tmp_path / "one.xsd").write_text(f'<xs:schema {XS}><xs:include schemaLocation="two.xsd"/><xs:element name="r" type="t"/></xs:schema>')
    (tmp_path / "two.xsd").write_text(f'<xs:schema {XS}><xs:include schemaLocation="one.xsd"/><xs:include schemaLocation="gone.xsd"/><xs:complexType name="t"><xs:attribute name="k" type="xs:int"/></xs:complexType></xs:schema>')
    assert [f.name for f in compile_schema(str(tmp_path / "one.xsd")).tables["r"].content] == ["k"]
    assert diagnose(str(tmp_path / "one.xsd")) == ["include not found: gone.xsd"]


def test_databases_by_namespace():
    from treeline.plans.catalogue_more import BOOK

    m = compile_schema(BOOK)
    text = ddl.ddl(m, "main", by_namespace=True)
    assert "CREATE DATABASE IF NOT EXISTS `b`;" in text and "CREATE TABLE `b`.`supplier`" in text and "`main`" not in text
    assert "CREATE TABLE `main`.`supplier`" in ddl.ddl(m, "main")


@pytest.mark.parametrize("allowed,fine,bad", [("##other", '<o:x xmlns:o="urn:o"/>', "<x/>"), ("##local", "<x/>", '<o:x xmlns:o="urn:o"/>'), ("urn:o urn:p", '<o:x xmlns:o="urn:p"/>', '<o:x xmlns:o="urn:q"/>'), ("##any", "<x/>", None)])
def test_namespaces_of_wildcards(allowed, fine, bad):
    m = compile_schema(f'<xs:schema {XS}><xs:element name="t"><xs:complexType><xs:sequence><xs:any namespace="{allowed}" maxOccurs="2"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    assert validate.structural_errors(m, f"<t>{fine}</t>") == []
    assert bad is None or validate.structural_errors(m, f"<t>{bad}</t>") == ["/t/x: namespace"]
