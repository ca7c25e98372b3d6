"""Schemas and documents made from the driver's tables; the documents are built by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.functions.text import xml_escape
from treeline.schema.model import SchemaModel
from treeline.schema.xsd import compile_schema

GEO = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
 <xs:simpleType name="status"><xs:restriction base="xs:string"><xs:enumeration value="F"/><xs:enumeration value="O"/><xs:enumeration value="P"/></xs:restriction></xs:simpleType>
 <xs:simpleType name="money"><xs:restriction base="xs:decimal"><xs:totalDigits value="18"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>
 <xs:complexType name="itemType"><xs:sequence>
   <xs:element name="part" type="xs:long"/><xs:element name="supplier" type="xs:long"/></xs:sequence>
  <xs:attribute name="linenumber" type="xs:int" use="required"/><xs:attribute name="quantity" type="money"/><xs:attribute name="extendedprice" type="money"/>
  <xs:attribute name="discount" type="money"/><xs:attribute name="tax" type="money"/><xs:attribute name="returnflag" type="xs:string"/>
  <xs:attribute name="linestatus" type="xs:string"/><xs:attribute name="shipdate" type="xs:dateTime"/></xs:complexType>
 <xs:element name="geo"><xs:complexType><xs:sequence><xs:element name="customer" maxOccurs="unbounded"><xs:complexType><xs:sequence>
   <xs:element name="nation"><xs:complexType><xs:attribute name="key" type="xs:int"/><xs:attribute name="name" type="xs:string"/><xs:attribute name="region" type="xs:string"/></xs:complexType></xs:element>
   <xs:element name="order" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="lineitem" type="itemType" minOccurs="0" maxOccurs="unbounded"/></xs:sequence>
    <xs:attribute name="key" type="xs:long" use="required"/><xs:attribute name="status" type="status"/><xs:attribute name="totalprice" type="money"/>
    <xs:attribute name="date" type="xs:dateTime"/><xs:attribute name="priority" type="xs:string"/></xs:complexType></xs:element></xs:sequence>
   <xs:attribute name="key" type="xs:long" use="required"/><xs:attribute name="name" type="xs:string"/><xs:attribute name="segment" type="xs:string"/><xs:attribute name="acctbal" type="money"/>
  </xs:complexType></xs:element></xs:sequence></xs:complexType>
  <xs:key name="order_key"><xs:selector xpath="customer/order"/><xs:field xpath="@key"/></xs:key>
 </xs:element></xs:schema>"""

CATALOG = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
 <xs:simpleType name="brand"><xs:restriction base="xs:string"><xs:pattern value="Brand#[1-3][0-9]*"/></xs:restriction></xs:simpleType>
 <xs:simpleType name="small"><xs:restriction base="xs:int"><xs:minInclusive value="1"/><xs:maxInclusive value="25"/></xs:restriction></xs:simpleType>
 <xs:element name="catalog"><xs:complexType><xs:sequence><xs:element name="part" maxOccurs="unbounded"><xs:complexType><xs:sequence>
   <xs:element name="name" type="xs:string"/><xs:element name="brand" type="brand"/><xs:element name="type" type="xs:string"/><xs:element name="size" type="small"/>
   <xs:element name="price" type="xs:double"/><xs:element name="note" type="xs:string" minOccurs="0" default="none"/><xs:element name="tag" type="xs:token" minOccurs="0" maxOccurs="unbounded"/></xs:sequence>
  <xs:attribute name="key" type="xs:long" use="required"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""

CORPUS = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="corpus"><xs:complexType><xs:sequence>
 <xs:element name="doc" maxOccurs="unbounded"><xs:complexType><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="id" type="xs:long"/><xs:attribute name="lang" type="xs:string"/><xs:attribute name="source" type="xs:string"/></xs:extension></xs:simpleContent></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""

DIALOG = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="dialog"><xs:complexType><xs:sequence>
 <xs:element name="turn" maxOccurs="unbounded"><xs:complexType><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="role" type="xs:string"/><xs:attribute name="n" type="xs:long"/></xs:extension></xs:simpleContent></xs:complexType></xs:element>
</xs:sequence><xs:attribute name="conv" type="xs:long"/></xs:complexType></xs:element></xs:schema>"""

LOG = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="log"><xs:complexType><xs:sequence>
 <xs:element name="event" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="value" type="xs:double"/><xs:any minOccurs="0" maxOccurs="unbounded" processContents="lax"/></xs:sequence>
  <xs:attribute name="id" type="xs:long"/><xs:attribute name="type" type="xs:string"/><xs:anyAttribute/></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""

SHARED = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
 <xs:complexType name="contact"><xs:sequence><xs:element name="place" type="xs:int"/></xs:sequence><xs:attribute name="balance" type="xs:double"/></xs:complexType>
 <xs:complexType name="party"><xs:sequence><xs:element name="contact" type="contact"/></xs:sequence><xs:attribute name="key" type="xs:long"/><xs:attribute name="name" type="xs:string"/></xs:complexType>
 <xs:element name="trade"><xs:complexType><xs:sequence><xs:element name="buyer" type="party" minOccurs="0" maxOccurs="unbounded"/><xs:element name="seller" type="party" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""

SCHEMAS = {"geo": GEO, "catalog": CATALOG, "corpus": CORPUS, "dialog": DIALOG, "log": LOG, "shared": SHARED}
_models: dict[tuple, SchemaModel] = {}


def model(name: str, **options) -> SchemaModel:
    key = (name, *sorted(options.items()))
    if key not in _models:
        _models[key] = compile_schema(SCHEMAS[name], **options)
    return _models[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(name: str, value: Column) -> Column:
    """An attribute whose value has nothing to escape: a number or a moment."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"')), F.lit(""))


def attr(name: str, value: Column) -> Column:
    return plain(name, xml_escape(value.cast("string")))


def money(c: str) -> Column:
    """Text of the number as decimal(18,2). One that is so many hundredths, and no less than 0, is written from these: it is
    what they give when divided, and has too few digits for any other decimal to be the same number."""
    x = F.col(c).cast("double")
    hundredths = F.rint(x * 100)
    n = hundredths.cast("bigint")
    text = F.concat(((n - n % 100) / 100).cast("bigint").cast("string"), F.lit("."), F.substring((n % 100 + 100).cast("string"), 2, 2))
    return F.when((hundredths >= 0) & (hundredths < 1e15) & (hundredths / 100 == x), text).otherwise(F.col(c).cast("decimal(18,2)").cast("string"))


def moment(c: str) -> Column:
    """The moment in the session's zone without parts of seconds."""
    text = F.col(c).cast("timestamp_ntz").cast("string")
    return F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T"))


def joined(items: Column) -> Column:
    """Text of (order..., xml) structs in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(items)), lambda x: x["xml"]), "")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer, with its nation, orders and line items. Line items become text after they were brought
    together, as their values are shorter than their XML."""
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    line = F.concat(
        F.lit("<lineitem"), plain("linenumber", F.col("l_linenumber")), plain("quantity", money("l_quantity")), plain("extendedprice", money("l_extendedprice")), plain("discount", money("l_discount")), plain("tax", money("l_tax")),
        attr("returnflag", F.col("l_returnflag")), attr("linestatus", F.col("l_linestatus")), plain("shipdate", moment("l_shipdate")),
        F.lit("><part>"), F.col("l_partkey").cast("string"), F.lit("</part><supplier>"), F.col("l_suppkey").cast("string"), F.lit("</supplier></lineitem>"),
    )
    lines = li.select("l_orderkey", F.struct(*LINE_ORDER, line.alias("xml")).alias("x")).groupBy("l_orderkey").agg(joined(F.col("x")).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = F.concat(F.lit("<order"), plain("key", F.col("o_orderkey")), attr("status", F.col("o_orderstatus")), plain("totalprice", money("o_totalprice")), plain("date", moment("o_orderdate")), attr("priority", F.col("o_orderpriority")), F.when(F.col("lines").isNull(), "/>").otherwise(F.concat(F.lit(">"), F.col("lines"), F.lit("</order>"))))
    per = orders.select("o_custkey", F.struct("o_orderkey", order.alias("xml")).alias("x")).groupBy("o_custkey").agg(joined(F.col("x")).alias("orders"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    xml = F.concat(
        F.lit("<geo><customer"), plain("key", F.col("c_custkey")), attr("name", F.col("c_name")), attr("segment", F.col("c_mktsegment")), plain("acctbal", money("c_acctbal")), F.lit("><nation"),
        plain("key", F.col("n_nationkey")), attr("name", F.col("n_name")), attr("region", F.col("r_name")), F.lit("/>"), F.coalesce("orders", F.lit("")), F.lit("</customer></geo>"),
    )
    return c.select(F.col("c_custkey").cast("string").alias("document_id"), xml.alias("xml"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part; its tags are the words of its type. Rows are spread, as a file of few bytes has many parts."""
    p = table(spark, sf_dir, "part").repartition("p_partkey")
    el = lambda n, c: F.concat(F.lit(f"<{n}>"), xml_escape(c.cast("string")), F.lit(f"</{n}>"))
    tags = F.array_join(F.transform(F.split("p_type", " "), lambda w: F.concat(F.lit("<tag>"), xml_escape(w), F.lit("</tag>"))), "")
    xml = F.concat(F.lit("<catalog><part"), attr("key", F.col("p_partkey")), F.lit(">"), el("name", F.col("p_name")), el("brand", F.col("p_brand")), el("type", F.col("p_type")), el("size", F.col("p_size")), el("price", F.col("p_retailprice")), tags, F.lit("</part></catalog>"))
    return p.select(F.col("p_partkey").cast("string").alias("document_id"), xml.alias("xml"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # Control characters are no XML.
    text = xml_escape(F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    xml = F.concat(F.lit("<corpus><doc"), attr("id", F.col("doc_id")), attr("lang", F.col("lang")), attr("source", F.col("source")), F.lit(">"), text, F.lit("</doc></corpus>"))
    return d.select(F.col("doc_id").cast("string").alias("document_id"), xml.alias("xml"))


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("<turn"), attr("role", F.col("role")), attr("n", F.col("turn")), F.lit(">"), xml_escape(F.col("text")), F.lit("</turn>"))
    per = c.select("conv_id", F.struct("turn", "role", turn.alias("xml")).alias("x")).groupBy("conv_id").agg(joined(F.col("x")).alias("turns"))
    return per.select(F.col("conv_id").cast("string").alias("document_id"), F.concat(F.lit("<dialog"), attr("conv", F.col("conv_id")), F.lit(">"), F.col("turns"), F.lit("</dialog>")).alias("xml"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per event; its properties are open content and its user an undeclared attribute."""
    e = table(spark, sf_dir, "events").repartition("event_id")
    props = F.array_join(F.transform(F.map_entries(F.from_json("props", "map<string,string>")), lambda p: F.concat(F.lit("<"), p["key"], F.lit(">"), xml_escape(p["value"]), F.lit("</"), p["key"], F.lit(">"))), "")
    xml = F.concat(F.lit("<log><event"), attr("id", F.col("event_id")), attr("type", F.col("event_type")), attr("user", F.col("user_id")), F.lit("><value>"), F.col("value").cast("string"), F.lit("</value>"), F.coalesce(props, F.lit("")), F.lit("</event></log>"))
    return e.select(F.col("event_id").cast("string").alias("document_id"), xml.alias("xml"))


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per nation: its customers buy, its suppliers sell."""

    def parties(name: str, kind: str, p: str, key: str) -> DataFrame:
        x = F.concat(F.lit(f"<{kind}"), attr("key", F.col(key)), attr("name", F.col(f"{p}_name")), F.lit("><contact"), attr("balance", F.col(f"{p}_acctbal")), F.lit("><place>"), F.col(f"{p}_nationkey").cast("string"), F.lit(f"</place></contact></{kind}>"))
        return table(spark, sf_dir, name).select(F.col(f"{p}_nationkey").alias("k"), F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), x.alias("xml")).alias("x"))

    both = parties("customer", "buyer", "c", "c_custkey").unionAll(parties("supplier", "seller", "s", "s_suppkey"))
    return both.groupBy("k").agg(joined(F.col("x")).alias("all")).select(F.col("k").cast("string").alias("document_id"), F.concat(F.lit("<trade>"), F.col("all"), F.lit("</trade>")).alias("xml"))


MAKERS = {"geo": geo, "catalog": catalog, "corpus": corpus, "dialog": dialog, "log": log, "shared": shared}


_stored: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes all documents made from a folder of tables once, to be read by what asks for them in this process."""
    for name in MAKERS:
        MAKERS[name](spark, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
    for name in MAKERS:
        _stored[sf_dir, name] = f"{folder}/{name}"


def documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = _stored.get((sf_dir, name))
    return spark.read.schema("document_id string, xml string").parquet(path) if path else MAKERS[name](spark, sf_dir)


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
