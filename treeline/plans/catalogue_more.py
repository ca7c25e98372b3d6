"""Further registered queries: schemas of many constructs, recursion, order and lexical forms, stores and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline import workspace
from treeline.engine import Engine
from treeline.functions import text as text_functions
from treeline.operators import fulltext, publish, split, sync, validate
from treeline.operators.shred import Filters, shred_all
from treeline.plans.catalogue import DF, NUMBERED, TERMS, M2, O, _engine, _path, _query, _values
from treeline.schema.xsd import compile_schema
from treeline.sources import documents as readers
from treeline.sources import fixtures, sinks

_XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'
_models: dict = {}

#: Groups, extension, lists, unions and substitution, in a namespace; documents of suppliers.
BOOK = f"""<xs:schema {_XS} xmlns="urn:book" xmlns:b="urn:book" targetNamespace="urn:book" elementFormDefault="qualified">
 <xs:attributeGroup name="named"><xs:attribute name="key" type="xs:long" use="required"/><xs:attribute name="name" type="xs:string"/></xs:attributeGroup>
 <xs:simpleType name="codes"><xs:list itemType="xs:int"/></xs:simpleType><xs:simpleType name="mark"><xs:union memberTypes="xs:int xs:boolean"/></xs:simpleType>
 <xs:group name="worth"><xs:sequence><xs:element name="balance" type="xs:double"/><xs:element name="codes" type="codes" minOccurs="0"/></xs:sequence></xs:group>
 <xs:complexType name="party"><xs:sequence><xs:group ref="worth"/></xs:sequence><xs:attributeGroup ref="named"/></xs:complexType>
 <xs:complexType name="supplierType"><xs:complexContent><xs:extension base="party"><xs:sequence><xs:element name="mark" type="mark"/><xs:element ref="place" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="rank" type="xs:int"/></xs:extension></xs:complexContent></xs:complexType>
 <xs:element name="place" type="xs:int" abstract="true"/><xs:element name="home" type="xs:int" substitutionGroup="place"/><xs:element name="abroad" type="xs:int" substitutionGroup="place"/>
 <xs:element name="book"><xs:complexType><xs:sequence><xs:element name="supplier" type="supplierType" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""
#: A table below itself; documents of parts, as deep as their size has it.
NEST = f"""<xs:schema {_XS}><xs:complexType name="n"><xs:sequence><xs:element name="n" type="n" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="k" type="xs:int"/></xs:complexType>
 <xs:element name="t"><xs:complexType><xs:sequence><xs:element name="n" type="n" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""
#: Children before, between and after elements, and a repeated choice; zoned moments and dates.
MIX = f"""<xs:schema {_XS}><xs:element name="t"><xs:complexType><xs:sequence><xs:element name="a" type="xs:string" minOccurs="0"/><xs:element name="c" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:attribute name="x" type="xs:string"/></xs:complexType></xs:element>
 <xs:element name="b" type="xs:dateTime" minOccurs="0"/><xs:choice minOccurs="0" maxOccurs="unbounded"><xs:element name="d" type="xs:date"/><xs:element name="e" type="xs:decimal"/></xs:choice></xs:sequence></xs:complexType></xs:element></xs:schema>"""
#: One element name with two types.
MERGED = f"""<xs:schema {_XS}><xs:element name="t"><xs:complexType><xs:sequence>
 <xs:element name="a"><xs:complexType><xs:sequence><xs:element name="v"><xs:complexType><xs:attribute name="x" type="xs:int"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element>
 <xs:element name="b"><xs:complexType><xs:sequence><xs:element name="v"><xs:complexType><xs:attribute name="x" type="xs:string"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""
#: A single child of simple content, which may be columns.
PRICE = f"""<xs:schema {_XS}><xs:complexType name="money"><xs:simpleContent><xs:extension base="xs:double"><xs:attribute name="cur" type="xs:string"/></xs:extension></xs:simpleContent></xs:complexType>
 <xs:element name="item"><xs:complexType><xs:sequence><xs:element name="name" type="xs:string"/><xs:element name="price" type="money"/></xs:sequence><xs:attribute name="key" type="xs:long"/></xs:complexType></xs:element></xs:schema>"""
#: Two tables that only hold others.
BRIDGES = f"""<xs:schema {_XS}><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="outer"><xs:complexType><xs:sequence><xs:element name="inner"><xs:complexType><xs:sequence>
 <xs:element name="leaf" maxOccurs="unbounded"><xs:complexType><xs:attribute name="v" type="xs:string"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""
#: Two document elements.
ROOTS = f"""<xs:schema {_XS}><xs:element name="even"><xs:complexType><xs:attribute name="size" type="xs:int"/></xs:complexType></xs:element><xs:element name="odd"><xs:complexType><xs:attribute name="size" type="xs:int"/></xs:complexType></xs:element></xs:schema>"""
#: Names that are words of SQL, have signs of it, or differ by case alone.
NAMES = f"""<xs:schema {_XS}><xs:element name="Select"><xs:complexType><xs:sequence><xs:element name="From-Where" type="xs:string"/><xs:element name="from-where" type="xs:int"/></xs:sequence><xs:attribute name="Order" type="xs:long"/><xs:attribute name="a.b" type="xs:string"/></xs:complexType></xs:element></xs:schema>"""
TEXTS = {"roots": ROOTS, "names": NAMES, "book": BOOK, "nest": NEST, "mix": MIX, "merged": MERGED, "price": PRICE, "bridges": BRIDGES}


def _model(name: str, **options):
    key = (name, *options.items())
    if key not in _models:
        _models[key] = compile_schema(TEXTS[name], **options)
    return _models[key]


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _docs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    part = fixtures.table(spark, sf_dir, "part")
    lit = F.lit
    if name == "book":
        s = fixtures.table(spark, sf_dir, "supplier")
        codes = F.concat(_s("s_nationkey"), F.when(F.col("s_suppkey") % 4 == 0, " six").otherwise(" 6"))
        mark = F.when(F.col("s_suppkey") % 3 == 0, "true").when(F.col("s_suppkey") % 3 == 1, "7").otherwise("maybe")
        xml = F.concat(
            lit('<book xmlns="urn:book"><supplier'), fixtures.attr("key", F.col("s_suppkey")), fixtures.attr("name", F.col("s_name")), fixtures.attr("rank", F.col("s_nationkey")), lit("><balance>"), _s("s_acctbal"), lit("</balance><codes>"), codes,
            lit("</codes><mark>"), mark, lit("</mark><home>"), _s("s_nationkey"), lit("</home><abroad>"), (F.col("s_nationkey") + 100).cast("string"), lit("</abroad></supplier></book>"),
        )
        return s.select(_s("s_suppkey").alias("document_id"), xml.alias("xml"))
    key = _s("p_partkey")
    if name == "nest":
        steps = F.sequence(lit(1), F.col("p_size") % 7 + 1)
        xml = F.concat(lit("<t>"), F.array_join(F.transform(steps, lambda k: F.concat(lit('<n k="'), k.cast("string"), F.when(k == F.col("p_size") % 7 + 1, '"/>').otherwise('">'))), ""), F.repeat(lit("</n>"), F.col("p_size") % 7), lit("</t>"))
    elif name == "mix":
        day, zone = F.concat(lit("2015-10-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")), F.when(F.col("p_size") % 2 == 0, "+01:00").otherwise("")
        xml = F.concat(lit("<t><a>"), text_functions.xml_escape(F.col("p_brand")), lit("</a>"), F.array_join(F.transform(F.split("p_type", " "), lambda w: F.concat(lit('<c x="'), text_functions.xml_escape(w), lit('"/>'))), ""), lit("<b>"), day, lit("T01:02:03.5"), zone, lit("</b><e>1.50</e><d>"), day, zone, lit("</d><e>"), _s("p_size"), lit("</e></t>"))
    elif name == "roots":
        xml = F.concat(F.when(F.col("p_size") % 2 == 0, "<even").otherwise("<odd"), fixtures.attr("size", F.col("p_size")), lit("/>"))
    elif name == "names":
        xml = F.concat(lit("<Select"), fixtures.attr("Order", F.col("p_partkey")), fixtures.attr("a.b", F.col("p_brand")), lit("><From-Where>"), text_functions.xml_escape(F.col("p_name")), lit("</From-Where><from-where>"), _s("p_size"), lit("</from-where></Select>"))
    elif name == "merged":
        xml = F.concat(lit('<t><a><v x="'), _s("p_size"), lit('"/></a><b><v x="'), text_functions.xml_escape(F.col("p_brand")), lit('"/></b></t>'))
    elif name == "price":
        xml = F.concat(lit("<item"), fixtures.attr("key", F.col("p_partkey")), lit("><name>"), text_functions.xml_escape(F.col("p_name")), lit('</name><price cur="'), F.when(F.col("p_size") % 2 == 0, "EUR").otherwise("USD"), lit('">'), _s("p_retailprice"), lit("</price></item>"))
    else:
        xml = F.concat(lit("<r><outer><inner>"), F.array_join(F.transform(F.split("p_type", " "), lambda w: F.concat(lit('<leaf v="'), text_functions.xml_escape(w), lit('"/>'))), ""), lit("</inner></outer></r>"))
    return part.select(key.alias("document_id"), xml.alias("xml"))


def _of(spark: SparkSession, sf_dir: str, name: str, **options) -> Engine:
    return Engine.of_documents(_docs(spark, sf_dir, name), _model(name, **options))


def _raised(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """The expression, and whether it is refused."""
    from treeline.xpath.parser import XPathError

    try:
        _engine(spark, sf_dir, "catalog").xpath(expression)
    except XPathError:
        return spark.createDataFrame([(expression, True)], "expression string, refused boolean")
    return spark.createDataFrame([(expression, False)], "expression string, refused boolean")


def _ask(name: str, fixture: str, expression: str, sql: str, *, model_options: dict | None = None, **options) -> None:
    _query(name, sql)(lambda spark, sf_dir: _of(spark, sf_dir, fixture, **(model_options or {})).xpath(expression, **options))


# Schemas ---------------------------------------------------------------------------------------------------------------

_ask("xsd3_groups", "book", "/book/supplier/balance", "SELECT s_acctbal AS balance FROM supplier")
_ask("xsd3_attribute_groups", "book", "/book/supplier[@name='Supplier#000000001']/@key", "SELECT s_suppkey AS key FROM supplier WHERE s_name = 'Supplier#000000001'")
_ask("xsd6_extension", "book", "//supplier[balance > 5000]/@rank", "SELECT s_nationkey AS rank FROM supplier WHERE s_acctbal > 5000")
_ask("xsd8_substitution", "book", "//home/text() | //abroad/text()", "SELECT '/book/supplier/home/text()' AS path, s_nationkey::VARCHAR AS value FROM supplier UNION ALL SELECT '/book/supplier/abroad/text()', (s_nationkey + 100)::VARCHAR FROM supplier")
_ask("xsd11_list", "book", "/book/supplier/codes", "SELECT s_nationkey || CASE WHEN s_suppkey % 4 = 0 THEN ' six' ELSE ' 6' END AS codes FROM supplier")
_ask("xsd14_merged_types", "merged", "//v/@x", "SELECT '/t/a/v/@x' AS path, p_size::VARCHAR AS value FROM part UNION ALL SELECT '/t/b/v/@x', p_brand FROM part")
_ask("xsd16_inline_attribute", "price", "/item[price/@cur='EUR']/price", "SELECT p_retailprice AS price FROM part WHERE p_size % 2 = 0", model_options={"inline_simple": True})
_ask("xsd16_inline_condition", "price", "/item[price > 1200]/price/@cur", "SELECT CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END AS price_cur FROM part WHERE p_retailprice > 1200", model_options={"inline_simple": True})
_ask("prj2_namespace_uri", "book", "namespace-uri(//supplier)", "SELECT 'urn:book' AS \"namespace-uri\"")
_ask("prj2_prefixed_name", "book", "name(//supplier)", "SELECT 'b:supplier' AS name")
_ask("prj2_prefixed_steps", "book", "/b:book/b:supplier/@key", "SELECT s_suppkey AS key FROM supplier")

_ask("xsd1_document_element", "roots", "/odd/@size", "SELECT p_size AS size FROM part WHERE p_size % 2 = 1", model_options={"root": "odd"})
_ask("xsd7_repeated_choice", "mix", "/t/e/text()", "SELECT content::DECIMAL(38,18)::VARCHAR AS content FROM (SELECT unnest([1.5, p_size]) AS content FROM part)")
_ask("xsd20_quoted_names", "names", "/Select[from-where > 20]/From-Where", "SELECT p_name AS \"From_Where\" FROM part WHERE p_size > 20")
_ask("xsd20_signs_in_names", "names", "/Select/@a.b", "SELECT p_brand AS a_b FROM part")
for _n, _e in (("fn04_id", "//part[id('x')]"), ("ax9_namespace", "/catalog/namespace::x"), ("nt4_comment", "/catalog/part/comment()"), ("nt4_processing_instruction", "/catalog/part/processing-instruction()")):
    _query(_n, f"SELECT '{_e.replace(chr(39), chr(39) * 2)}' AS expression, true AS refused")(lambda spark, sf_dir, e=_e: _raised(spark, sf_dir, e))

# Axes in predicates ----------------------------------------------------------------------------------------------------

_path("ax7_following_in_predicate", "geo", "/geo/customer/order[following-sibling::order/@status='P']/@key", "SELECT o_orderkey AS key FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey < (SELECT max(p.o_orderkey) FROM orders p WHERE p.o_custkey = orders.o_custkey AND p.o_orderstatus = 'P')")
_path("ax7_preceding_in_predicate", "geo", "/geo/customer/order[not(preceding-sibling::order)]/@key", f"SELECT o_orderkey AS key FROM {NUMBERED} WHERE i = 1")
_path("ax8_preceding_in_predicate", "geo", "/geo/customer/order[preceding::lineitem/@quantity > 49]/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_orderkey > (SELECT min(l_orderkey) FROM lineitem JOIN orders p ON l_orderkey = p.o_orderkey WHERE p.o_custkey = orders.o_custkey AND l_quantity > 49)")


@_query("xsd19_database_of_namespace", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier")
def _by_namespace(spark, sf_dir):
    """A table made in the database of its namespace, filled and read."""
    from treeline.schema import ddl

    e, folder = _of(spark, sf_dir, "book"), workspace.new_folder(spark, "database")
    name = ddl.database_of(e.model, "supplier", by_namespace=True) + "_" + folder.rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    spark.sql(ddl.create_table(e.model, "supplier", name))
    e.table("supplier").write.insertInto(f"{name}.supplier")
    return spark.table(f"{name}.supplier").select("key", "name", "balance")


# Recursion -------------------------------------------------------------------------------------------------------------

DEPTH = "(SELECT p_partkey, p_size % 7 + 1 AS depth, unnest(range(1, p_size % 7 + 2))::INT AS k FROM part)"
_ask("ax3_any_depth", "nest", "//n/@k", f"SELECT k FROM {DEPTH}")
_ask("ax1_deep_steps", "nest", "/t/n/n/n/n/n/@k", f"SELECT k FROM {DEPTH} WHERE k = 5")
_ask("ax3_below_at_any_depth", "nest", "//n[@k=3]//n/@k", f"SELECT k FROM {DEPTH} WHERE k > 3")
_ask("ax5_ancestors_at_any_depth", "nest", "//n[@k=5]/ancestor::n/@k", f"SELECT k FROM {DEPTH} WHERE k < 5 AND depth >= 5")
_ask("flt4_deepest", "nest", "//n[not(n)]/@k", f"SELECT k FROM {DEPTH} WHERE k = depth")
_ask("agg1_any_depth", "nest", "count(//n)", "SELECT p_partkey::VARCHAR AS document_id, (p_size % 7 + 1)::BIGINT AS count FROM part", keys=True)


# Publishing ------------------------------------------------------------------------------------------------------------


def _same(spark, sf_dir, name: str, stored: bool, **options) -> DataFrame:
    """Documents shredded and published again, against what they were."""
    docs, e = _docs(spark, sf_dir, name), _of(spark, sf_dir, name, **options)
    if stored:
        e = Engine.of_tables(spark, shred_all(docs, e.model, workspace.new_folder(spark, "tables")), e.model)
    made = publish.to_xml(e).select(F.col("document_id").alias("d"), F.col("xml").alias("made"))
    return docs.join(made, F.col("document_id") == F.col("d"), "left").select("document_id", F.coalesce(F.col("made") == F.col("xml"), F.lit(False)).alias("same"))


_PARTS = "SELECT p_partkey::VARCHAR AS document_id, true AS same FROM part"
_query("pub1_schema_order_and_zones", _PARTS)(lambda spark, sf_dir: _same(spark, sf_dir, "mix", False))
_query("pub1_recursive", _PARTS)(lambda spark, sf_dir: _same(spark, sf_dir, "nest", False))
_query("pub1_recursive_from_tables", _PARTS)(lambda spark, sf_dir: _same(spark, sf_dir, "nest", True))
_query("pub2_bridges", _PARTS)(lambda spark, sf_dir: _same(spark, sf_dir, "bridges", True))
_query("pub1_inline", _PARTS)(lambda spark, sf_dir: _same(spark, sf_dir, "price", False, inline_simple=True))
_query("pub1_namespace", "SELECT s_suppkey::VARCHAR AS document_id, true AS same FROM supplier")(lambda spark, sf_dir: _same(spark, sf_dir, "book", False))
_ask("flt1_zoned_date", "mix", "/t[d='2015-10-21+01:00']/a", "SELECT p_brand AS a FROM part WHERE p_size % 28 + 1 = 21")


@_query("pub1_moments_from_tables", "SELECT p_partkey::VARCHAR AS document_id, '<b>' || strftime(TIMESTAMP '2015-10-01 01:02:03.5' + to_days(p_size % 28) - CASE WHEN p_size % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S') || '.5</b>' AS b FROM part")
def _moments(spark, sf_dir):
    e = _of(spark, sf_dir, "mix")
    stored = Engine.of_tables(spark, shred_all(_docs(spark, sf_dir, "mix"), e.model, workspace.new_folder(spark, "tables")), e.model)
    return publish.to_xml(stored).select("document_id", F.regexp_extract("xml", "<b>[^<]*</b>", 0).alias("b"))


@_query("pub9_indented_xml", "SELECT p_partkey::VARCHAR AS document_id, '<item key=\"' || p_partkey || '\">' || chr(10) || '  <name>' || p_name || '</name>' || chr(10) || '  <price cur=\"' || CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END || '\">' AS head FROM part")
def _indented(spark, sf_dir):
    made = publish.to_xml(_of(spark, sf_dir, "price"), style=publish.XmlStyle(indent=2))
    return made.select("document_id", F.regexp_extract("xml", '^([\\s\\S]*cur="[A-Z]*">)', 1).alias("head"))


@_query("pub9_indented_json", "SELECT p_partkey::VARCHAR AS document_id, '{' || chr(10) || ' \"t\": {' || chr(10) || '  \"a\": {' || chr(10) || '   \"v\": {' || chr(10) || '    \"@x\": \"' || p_size || '\"' || chr(10) || '   }' || chr(10) || '  },' AS head FROM part")
def _indented_json(spark, sf_dir):
    made = publish.to_json(_of(spark, sf_dir, "merged"), style=publish.JsonStyle(indent=1))
    return made.select("document_id", F.regexp_extract("json", "^([^,]*,)", 1).alias("head"))


# Validation ------------------------------------------------------------------------------------------------------------


@_query("val2_members", "SELECT s_suppkey::VARCHAR AS document_id, 'mark' AS \"column\", 'maybe' AS value, 'type' AS reason FROM supplier WHERE s_suppkey % 3 = 2 UNION ALL SELECT s_suppkey::VARCHAR, 'codes', s_nationkey || ' six', 'type' FROM supplier WHERE s_suppkey % 4 = 0")
def _members(spark, sf_dir):
    return validate.invalid_values(_docs(spark, sf_dir, "book"), _model("book"), "supplier")


@_query("val3_all_errors", "SELECT s_suppkey::VARCHAR AS document_id, 'supplier.mark: type' AS error FROM supplier WHERE s_suppkey % 3 = 2 UNION ALL SELECT s_suppkey::VARCHAR, 'supplier.codes: type' FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey::VARCHAR, '/book/supplier: order of children' FROM supplier WHERE s_suppkey % 5 = 0")
def _all_errors(spark, sf_dir):
    """Documents of suppliers, of which every fifth has its last two children before the mark."""
    docs = _docs(spark, sf_dir, "book")
    turned = F.regexp_replace("xml", "(<mark>.*</mark>)(<home>.*</abroad>)", "$2$1")
    return validate.document_errors(docs.select("document_id", F.when(F.col("document_id").cast("bigint") % 5 == 0, turned).otherwise(F.col("xml")).alias("xml")), _model("book"))


@_query("val3_order_of_children", "SELECT p_partkey::VARCHAR AS document_id, '/item: order of children' AS error FROM part WHERE p_size > 25")
def _order_of_children(spark, sf_dir):
    turned = F.when(F.col("p_size") > 25, F.regexp_replace("xml", "(<name>.*</name>)(<price.*</price>)", "$2$1")).otherwise(F.col("xml"))
    docs = _docs(spark, sf_dir, "price").join(fixtures.table(spark, sf_dir, "part").select(_s("p_partkey").alias("k"), "p_size"), F.col("document_id") == F.col("k"))
    return validate.invalid_documents(docs.select("document_id", turned.alias("xml")), _model("price"))


def _broken(spark, sf_dir) -> DataFrame:
    """Documents of which those of parts of even size lack their end."""
    sizes = fixtures.table(spark, sf_dir, "part").select(_s("p_partkey").alias("k"), "p_size")
    docs = _docs(spark, sf_dir, "price").join(sizes, F.col("document_id") == F.col("k"))
    return docs.select("document_id", F.when(F.col("p_size") % 2 == 0, F.regexp_replace("xml", "</item>$", "")).otherwise(F.col("xml")).alias("xml"))


@_query("val4_well_formed", "SELECT p_partkey::VARCHAR AS document_id, p_size % 2 <> 0 AS well_formed FROM part")
def _well_formed(spark, sf_dir):
    return _broken(spark, sf_dir).select("document_id", validate.well_formed("xml").alias("well_formed"))


@_query("val3_valid_documents", "SELECT p_partkey::VARCHAR AS document_id FROM part WHERE p_size % 2 <> 0")
def _valid(spark, sf_dir):
    return validate.valid_documents(_broken(spark, sf_dir), _model("price")).select("document_id")


@_query("val4_malformed_dropped", "SELECT p_partkey AS key FROM part WHERE p_size % 2 <> 0")
def _dropped(spark, sf_dir):
    return Engine.of_documents(_broken(spark, sf_dir), _model("price"), Filters(malformed="drop")).xpath("/item/@key")


@_query("val6_tables_against_model", "SELECT * FROM (VALUES ('key: missing'), ('totalprice: string for decimal(18,2)')) AS t(difference)")
def _differences(spark, sf_dir):
    """A table that lacks a column and has another of the wrong type."""
    e = _engine(spark, sf_dir, "geo")
    rows = e.table("order").drop("key").withColumn("totalprice", _s("totalprice"))
    return spark.createDataFrame([(x,) for x in validate.schema_differences(rows, e.model, "order", strict=True)], "difference string")


# Sources, sinks and stores ---------------------------------------------------------------------------------------------


@_query("src3_listing", "SELECT n_name AS name FROM nation WHERE n_nationkey BETWEEN 10 AND 19")
def _listing(spark, sf_dir):
    """Files chosen by an expression for their whole paths."""
    n = fixtures.table(spark, sf_dir, "nation")
    folder = workspace.new_folder(spark, "files")
    sinks.write_documents(n.select(_s("n_nationkey").alias("document_id"), F.concat(F.lit("<n>"), text_functions.xml_escape(F.col("n_name")), F.lit("</n>")).alias("xml")), folder)
    found = readers.read_documents(spark, folder, extension=".txt", pattern=r"document_id=1\d/")
    return found.select(F.regexp_extract("xml", "<n>(.*)</n>", 1).alias("name"))


@_query("snk12_documents_as_files", "SELECT n_nationkey::VARCHAR AS document_id, '<n>' || chr(10) || '  ' || n_name || chr(10) || '</n>' AS xml FROM nation")
def _as_files(spark, sf_dir):
    n = fixtures.table(spark, sf_dir, "nation")
    folder = workspace.new_folder(spark, "files")
    sinks.write_documents(n.select(_s("n_nationkey").alias("document_id"), F.concat(F.lit("<n>\n  "), text_functions.xml_escape(F.col("n_name")), F.lit("\n</n>")).alias("xml")), folder)
    found = readers.read_documents(spark, folder, extension=".txt")
    return found.select(F.regexp_extract("path", "document_id=([^/]+)", 1).alias("document_id"), F.regexp_replace("xml", "\n$", "").alias("xml"))


@_query("src8_xmlpipe2", "SELECT p_partkey::VARCHAR AS id, p_brand AS brand, CASE WHEN p_name < p_type THEN p_name ELSE p_type END AS first FROM part")
def _xmlpipe2(spark, sf_dir):
    """A stream of search documents, written and read back."""
    e = _engine(spark, sf_dir, "catalog")
    made = fulltext.search_documents(_values(spark, sf_dir), fulltext.field_values(e, fulltext.chosen_fields(e.model, ("part.brand",))))
    folder = workspace.new_folder(spark, "pipe")
    sinks.write_docset(made, folder, fulltext.search_schema(fulltext.chosen_fields(e.model, ("part.brand",))))
    found = readers.read_search_documents(spark, folder, "content string, part__brand string")
    return found.select("id", F.col("part__brand").alias("brand"), F.get(F.split("content", "\n"), F.lit(0)).alias("first"))


@_query("src9_dictionary", f"SELECT term AS word, freq::BIGINT AS freq FROM {DF}")
def _dictionary(spark, sf_dir):
    folder = workspace.new_folder(spark, "dictionary")
    fulltext.term_frequencies(_values(spark, sf_dir)).select(F.concat_ws(" ", "term", _s("freq"))).write.text(folder)
    return readers.read_dictionary(spark, folder)


@_query("snk9_tabular_with_header", f"SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM {O}")
def _tabular(spark, sf_dir):
    folder = workspace.new_folder(spark, "tabular")
    sinks.write_delimited(_engine(spark, sf_dir, "geo").table("order", ["key", "status", "priority"]), folder, tab=True, header=True)
    return spark.read.option("sep", "\t").option("header", "true").csv(folder)


@_query("snk1_created_tables", f"SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice::{M2} AS totalprice, o_orderdate::TIMESTAMP AS date FROM {O}")
def _created(spark, sf_dir):
    """Tables made by the model's statements, filled and read."""
    from treeline.schema import ddl

    e, folder = _engine(spark, sf_dir, "geo"), workspace.new_folder(spark, "database")
    name = "treeline_" + folder.rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    spark.sql(ddl.create_table(e.model, "order", name))
    e.table("order").write.insertInto(f"{name}.`order`")
    return spark.table(f"{name}.`order`").select("key", "status", "totalprice", "date")


@_query("src7_index_reader", f"SELECT term, field, document_id, count(*) AS tf FROM {TERMS} GROUP BY ALL")
def _index_reader(spark, sf_dir):
    store = fulltext.PostingsStore(spark, workspace.new_folder(spark, "index"))
    store.update(_values(spark, sf_dir))
    return store.read().select("term", "field", "document_id", "tf")


@_query("syn5_index_update", f"SELECT t.term, t.document_id, count(*) AS tf FROM {TERMS} t JOIN part ON t.document_id = p_partkey::VARCHAR WHERE p_size % 3 <> 0 AND (p_size % 3 = 1 OR t.field = 'part.name') GROUP BY ALL")
def _index_update(spark, sf_dir):
    """An index from which a third of the documents leave and in which another third are read anew, by name alone."""
    values = workspace.stored(_values(spark, sf_dir).join(fixtures.table(spark, sf_dir, "part").select(_s("p_partkey").alias("document_id"), (F.col("p_size") % 3).alias("kind")), "document_id"))
    store = fulltext.PostingsStore(spark, workspace.new_folder(spark, "index"))
    store.update(values.drop("kind"))
    store.update(values.where("kind = 2 and field = 'part.name'").drop("kind"), gone=values.where("kind = 0").select("document_id"))
    store.compact()
    return store.read().groupBy("term", "document_id").agg(F.sum("tf").alias("tf"))


_WORD = "(SELECT regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+')[1] FROM part ORDER BY p_partkey LIMIT 1)"


@_query("fts_search", f"SELECT document_id, count(*)::BIGINT AS score FROM {TERMS} WHERE term IN ({_WORD.format('p_type')}, {_WORD.format('p_name')}) GROUP BY 1 HAVING count(DISTINCT term) = 2")
def _search(spark, sf_dir):
    """Documents with the first word of the type and of the name of the first part."""
    p = fixtures.table(spark, sf_dir, "part").orderBy("p_partkey").first()
    words = [text_functions.first_word(p["p_type"]).upper(), text_functions.first_word(p["p_name"])]
    return fulltext.search(fulltext.postings(_values(spark, sf_dir)), words)


# Probes, order, shards, synchronising ----------------------------------------------------------------------------------


@_query("jn6_existence", f"SELECT 1 AS question, count(*) > 0 AS found FROM {O} WHERE o_totalprice > 100000 UNION ALL SELECT 2, count(*) > 0 FROM {O} WHERE o_totalprice < 0")
def _existence(spark, sf_dir):
    e = _engine(spark, sf_dir, "geo")
    asked = ("/geo/customer/order[@totalprice > 100000]", "/geo/customer/order[@totalprice < 0]")
    parts = [e.exists(x).select(F.lit(k).alias("question"), "found") for k, x in enumerate(asked, 1)]
    return parts[0].unionAll(parts[1])


@_query("agg4_row_counts", f"SELECT 'geo' AS name, count(*) >= 1024 AS large FROM customer UNION ALL SELECT 'customer', count(*) >= 1024 FROM customer UNION ALL SELECT 'nation', count(*) >= 1024 FROM customer UNION ALL SELECT 'order', count(*) >= 1024 FROM {O} UNION ALL SELECT 'lineitem', count(*) >= 1024 FROM lineitem")
def _large_tables(spark, sf_dir):
    """Which tables have so many rows that an index pays; counting ends there."""
    e = _engine(spark, sf_dir, "geo")
    names = e.model.reachable(e.model.root)
    rows, _ = e.tables({t: [e.model.tables[t].primary] for t in names})
    out = None
    for t in names:
        n = rows[t].limit(1024).agg((F.count("*") >= 1024).alias("large")).select(F.lit(t).alias("name"), "large")
        out = n if out is None else out.unionAll(n)
    return out


@_query("srt1_document_order", f"SELECT o_custkey::VARCHAR AS document_id, i::INT AS serial_id, o_orderkey AS key, row_number() OVER (ORDER BY o_custkey::VARCHAR, i) AS place FROM {NUMBERED}")
def _ordered(spark, sf_dir):
    """Rows with their place in the order of documents and within them."""
    return split.ranked(_engine(spark, sf_dir, "geo").table("order", ["document_id", "serial_id", "key"]), ["document_id", "serial_id"], "place")


@_query("spl2_shards", "SELECT p_partkey::VARCHAR AS document_id, ((row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1) % 4)::INT AS shard FROM part")
def _shards(spark, sf_dir):
    return split.shard_round_robin(fixtures.documents(spark, sf_dir, "catalog").select("document_id"), 4)


@_query("spl2_shards_by_key", "SELECT 4::BIGINT AS shards, count(*) AS documents, 0::BIGINT AS moved FROM part")
def _shards_by_key(spark, sf_dir):
    """A document has one shard however often it comes, and all shards are used."""
    docs = fixtures.documents(spark, sf_dir, "catalog").select("document_id")
    both = split.shard(docs.unionAll(docs.repartition(3)), 4).groupBy("document_id").agg(F.countDistinct("shard").alias("n"), F.min("shard").alias("shard"))
    return both.agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("documents"), F.count_if(F.col("n") > 1).alias("moved"))


@_query("flt8_chosen_tables", f"SELECT 'order' AS name, count(*) AS n FROM {O} UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def _chosen(spark, sf_dir):
    tables = shred_all(fixtures.documents(spark, sf_dir, "geo"), fixtures.model("geo"), workspace.new_folder(spark, "tables"), Filters(keep_tables=("order",)))
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@_query("syn3_rescue", "SELECT p_partkey::VARCHAR AS document_id, 'same' AS plain, CASE WHEN p_size % 2 = 0 THEN 'updated' ELSE 'same' END AS rescued FROM part")
def _rescue(spark, sf_dir):
    """Documents of an unchanged time, half of which have other content: only a rescue looks at it."""
    p = fixtures.table(spark, sf_dir, "part")
    old = p.select(_s("p_partkey").alias("document_id"), F.md5("p_name").alias("digest"), F.lit(0).alias("modified"))
    now = p.select(_s("p_partkey").alias("document_id"), F.md5(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "!").otherwise(""))).alias("digest"), F.lit(0).alias("modified"))
    plain, rescued = sync.classify(old, now), sync.classify(old, now, rescue=True)
    return plain.select("document_id", F.col("status").alias("plain")).join(rescued.select("document_id", F.col("status").alias("rescued")), "document_id")


@_query("nt6_paths", "SELECT path, nodes FROM (SELECT unnest(['/catalog', '/catalog/part', '/catalog/part/tag']) AS path), (SELECT count(*) AS nodes FROM part)")
def _paths(spark, sf_dir):
    """Paths of tables, with how many documents have a node there."""
    e = _engine(spark, sf_dir, "catalog")
    paths = e.model.paths()
    rows, _ = e.tables({t: ["document_id"] for t in paths})
    out = None
    for t, own in paths.items():
        n = rows[t].distinct().agg(F.count("*").alias("nodes")).select(F.lit(own[0]).alias("path"), "nodes")
        out = n if out is None else out.unionAll(n)
    return out


@_query("lim1_first_orders", f"SELECT o_custkey::VARCHAR AS document_id, o_orderkey AS key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {O}) WHERE r <= 3")
def _first_orders(spark, sf_dir):
    """The three largest orders of each document."""
    rows = _engine(spark, sf_dir, "geo").table("order", ["document_id", "key", "totalprice"])
    w = Window.partitionBy("document_id").orderBy(F.desc("totalprice"), "key")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 3").select("document_id", "key")
