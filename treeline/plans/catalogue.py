"""All registered queries of the engine with the SQL that gives the same rows.

Each query makes its documents from the given tables, whole, and runs through the engine. Names begin with the operator
of the survey that they show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import workspace
from treeline.engine import Engine
from treeline.functions import text as text_functions
from treeline.functions.keys import key_column
from treeline.operators import fulltext, publish, split, sync, validate
from treeline.operators.shred import Filters, shred, shred_all
from treeline.schema import ddl
from treeline.sources import documents as readers
from treeline.sources import fixtures, sinks
from treeline.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Nodes of the geo documents as SQL.
C = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
O = "orders JOIN customer ON o_custkey = c_custkey"
L = f"lineitem JOIN {O.replace('orders', 'orders ON l_orderkey = o_orderkey', 1)}"
NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)"
LINES = (
    "(SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))"
)
TURNS = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
M2 = "DECIMAL(18,2)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "geo").xpath("/geo/customer[@segment='BUILDING' and order/@totalprice > 450000]/@name")


def _engine(spark: SparkSession, sf_dir: str, name: str, filters: Filters | None = None, **options) -> Engine:
    return Engine.of_documents(fixtures.documents(spark, sf_dir, name), fixtures.model(name, **options), filters)


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _path(name: str, fixture: str, expression: str, sql: str, columns: list[str] | None = None, **options) -> None:
    """Registers an XPath query; columns: only these of the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _engine(spark, sf_dir, fixture).xpath(expression, **options)
        return out.select(*columns) if columns else out

    _query(name, sql)(run)


def _value(name: str, expression: str, sql: str) -> None:
    """Registers an expression over the part catalog, with one value for each document."""
    _path(name, "catalog", expression, f"SELECT p_partkey::VARCHAR AS document_id, {sql} AS value FROM part")


_query("flagship", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")(flagship)

# Projections and filters -----------------------------------------------------------------------------------------------

_path("prj1_attribute", "geo", "/geo/customer/@name", "SELECT c_name AS name FROM customer")
_path("prj1_element", "geo", "/geo/customer/order/lineitem/part", f"SELECT l_partkey AS part FROM {L}")
_path("prj1_simple_content", "dialog", "/dialog/turn/text()", "SELECT text AS content FROM conversations WHERE trim(text, ' \t\r\n') <> ''")
_path("prj1_table", "geo", "/geo/customer/nation", f"SELECT n_nationkey AS key, n_name AS name, r_name AS region FROM {C}", ["key", "name", "region"])
_path("prj1_typed_table", "geo", "/geo/customer/order", f"SELECT o_custkey::VARCHAR AS document_id, o_orderkey AS key, o_orderstatus AS status, o_totalprice::{M2} AS totalprice, o_orderdate::TIMESTAMP AS date, o_orderpriority AS priority, i::INT AS serial_id FROM {NUMBERED}", ["document_id", "key", "status", "totalprice", "date", "priority", "serial_id"])
_path("prj2_local_name", "geo", "local-name(/geo/customer/nation)", "SELECT 'nation' AS \"local-name\"")
_path("prj2_name", "geo", "name(/geo/customer/order/@key)", "SELECT 'key' AS name")
_path("flt1_equal", "geo", "/geo/customer/order[@status='F']/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_orderstatus = 'F'")
_path("flt1_not_equal", "geo", "/geo/customer[@segment!='BUILDING']/@name", "SELECT c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
_path("flt2_range", "geo", "//lineitem[@quantity >= 25 and @quantity < 30]/@quantity", f"SELECT l_quantity::{M2} AS quantity FROM {L} WHERE l_quantity >= 25 AND l_quantity < 30")
_path("flt2_flipped", "geo", "/geo/customer/order[300000 < @totalprice]/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_totalprice > 300000")
_path("flt3_and_or", "geo", "/geo/customer/order[(@status='F' or @status='P') and @priority='1-URGENT']/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
_path("flt4_not", "geo", "/geo/customer[not(order/@status='P')]/@key", "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_path("flt5_several", "geo", "/geo/customer/order[@status='O'][@priority='5-LOW'][@totalprice > 100000]/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_totalprice > 100000")
_path("flt6_number", "geo", "/geo/customer/order[2]/@key", f"SELECT o_orderkey AS key FROM {NUMBERED} WHERE i = 2")
_path("flt6_position", "geo", "//order/lineitem[position() = 3]/part", f"SELECT l_partkey AS part FROM {LINES} WHERE i = 3")
_path("flt6_position_range", "geo", "/geo/customer/order[position() < 3]/@key", f"SELECT o_orderkey AS key FROM {NUMBERED} WHERE i < 3")
_path("flt6_last", "geo", "/geo/customer/order[last()]/@key", f"SELECT o_orderkey AS key FROM {NUMBERED} WHERE i = n")
_path("flt6_last_but_one", "dialog", "/dialog/turn[last() - 1]/@role", f"SELECT role FROM {TURNS} WHERE i = n - 1")
_path("flt6_filtered_position", "dialog", "/dialog/turn[@role='user'][2]/@n", "SELECT turn AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations WHERE role = 'user') WHERE i = 2")
_path("flt13_variable", "geo", "/geo/customer[@segment = $s and @acctbal > $least]/@name", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000", variables={"s": "MACHINERY", "least": 5000})
_path("flt1_date", "geo", "/geo/customer/order[@date < '1996-01-01T00:00:00']/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_orderdate < TIMESTAMP '1996-01-01'")

# Axes and node tests ---------------------------------------------------------------------------------------------------

_path("ax1_child", "geo", "child::geo/child::customer/child::nation/attribute::region", f"SELECT r_name AS region FROM {C}")
_path("ax2_any_attribute", "log", "/log/event/@user", "SELECT user_id::VARCHAR AS user FROM events")
_path("ax2_wildcard", "geo", "/geo/customer/nation/@*", f"SELECT '/geo/customer/nation/@' || k AS path, v AS value FROM (SELECT unnest(['key', 'name', 'region']) AS k, unnest([n_nationkey::VARCHAR, n_name, r_name]) AS v FROM {C})")
_path("ax3_descendant", "geo", "//lineitem/@linenumber", f"SELECT l_linenumber AS linenumber FROM {L}")
_path("ax3_descendant_or_self", "geo", "/geo/descendant-or-self::order/@priority", f"SELECT o_orderpriority AS priority FROM {O}")
_path("ax4_parent", "geo", "//lineitem[@quantity > 49]/../@key", f"SELECT o_orderkey AS key FROM {O} WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
_path("ax4_parent_of_attribute", "geo", "//@returnflag/../part", f"SELECT l_partkey AS part FROM {L} WHERE l_returnflag IS NOT NULL AND l_returnflag <> ''")
_path("ax5_ancestor", "geo", "//lineitem[@returnflag='R' and @discount > 0.09]/ancestor::customer/@name", f"SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {L} WHERE l_returnflag = 'R' AND l_discount::{M2} > 0.09)")
_path("ax6_self", "geo", "/geo/customer/order/self::order[@status='P']/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_orderstatus = 'P'")
_path("ax7_following_sibling", "geo", "/geo/customer/order[@status='P']/following-sibling::order/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_orderkey > (SELECT min(p.o_orderkey) FROM orders p WHERE p.o_custkey = orders.o_custkey AND p.o_orderstatus = 'P')")
_path("ax7_preceding_sibling", "dialog", "/dialog/turn[@role='assistant']/preceding-sibling::turn/@n", f"SELECT t.turn AS n FROM {TURNS} t WHERE t.i < (SELECT max(u.i) FROM {TURNS} u WHERE u.conv_id = t.conv_id AND u.role = 'assistant')")
_path("ax8_following", "geo", "/geo/customer/nation/following::order/@key", f"SELECT o_orderkey AS key FROM {O}")
_path("ax8_preceding", "geo", "/geo/customer/order[@status='P']/preceding::lineitem/part", f"SELECT l_partkey AS part FROM {L} WHERE l_orderkey < (SELECT max(p.o_orderkey) FROM orders p WHERE p.o_custkey = orders.o_custkey AND p.o_orderstatus = 'P')")
_path("nt1_partial_name", "geo", "//line*/@tax", f"SELECT l_tax::{M2} AS tax FROM {L}")
_path("nt2_node", "geo", "/geo/customer/order/lineitem/node()", f"SELECT '/geo/customer/order/lineitem/' || k AS path, v AS value FROM (SELECT unnest(['part', 'supplier']) AS k, unnest([l_partkey::VARCHAR, l_suppkey::VARCHAR]) AS v FROM {L})")
_path("nt3_text", "geo", "//lineitem/supplier/text()", f"SELECT l_suppkey::VARCHAR AS supplier FROM {L}")
_path("nt5_open_content", "log", "/log/event/k", "SELECT json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")

# Joins -----------------------------------------------------------------------------------------------------------------

_path("jn1_existence", "geo", "/geo/customer[order/lineitem/@quantity = 50]/@name", f"SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {L} WHERE l_quantity = 50)")
_path("jn1_bag", "geo", "/geo/customer[order/@totalprice > 400000]/@name", f"SELECT c_name AS name FROM {O} WHERE o_totalprice > 400000", bag=True)
_path("jn2_shared_type", "shared", "/trade/seller/contact/@balance", "SELECT s_acctbal AS balance FROM supplier")
_path("jn2_through_tables", "shared", "/trade[seller/contact/@balance < 0]/buyer/@name", "SELECT c_name AS name FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
_path("jn3_branches", "geo", "/geo/customer[nation/@region='ASIA' and order/@status='P']/@key", f"SELECT c_custkey AS key FROM {C} WHERE r_name = 'ASIA' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_path("jn3_columns", "geo", "/geo/customer/order[@totalprice > ../@acctbal]/@key", f"SELECT o_orderkey AS key FROM {O} WHERE o_totalprice::{M2} > c_acctbal::{M2}")
_path("jn4_nested_predicates", "geo", "/geo/customer[order[@status='O']/lineitem[@discount > 0.08][@tax < 0.01]]/@name", f"SELECT c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {L} WHERE o_orderstatus = 'O' AND l_discount::{M2} > 0.08 AND l_tax::{M2} < 0.01)")
_path("jn5_table_in_predicate", "geo", "/geo/customer[order]/nation/@name", f"SELECT n_name AS name FROM {C} WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_path("xsd15_parent_of_shared", "shared", "//contact[place = 7]/../@key", "SELECT '/trade/buyer/@key' AS path, c_custkey::VARCHAR AS value FROM customer WHERE c_nationkey = 7 UNION ALL SELECT '/trade/seller/@key', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey = 7")

# Aggregates and unions -------------------------------------------------------------------------------------------------

_path("agg1_count", "geo", "count(/geo/customer/order)", f"SELECT o_custkey::VARCHAR AS document_id, count(*) AS count FROM {O} GROUP BY 1", keys=True)
_path("agg2_sum", "geo", "sum(//lineitem/@quantity)", f"SELECT o_custkey::VARCHAR AS document_id, sum(l_quantity::{M2})::DECIMAL(28,2) AS sum FROM {L} GROUP BY 1", keys=True)
_path("agg3_count_in_predicate", "geo", "/geo/customer[count(order) > 12]/@key", f"SELECT c_custkey AS key FROM {O} GROUP BY 1 HAVING count(*) > 12")
_path("agg3_sum_in_predicate", "geo", "/geo/customer/order[sum(lineitem/@quantity) > 200]/@key", f"SELECT o_orderkey AS key FROM {L} GROUP BY 1 HAVING sum(l_quantity) > 200")
_path("set1_union", "geo", "/geo/customer/@name | //nation/@name", f"SELECT '/geo/customer/@name' AS path, c_name AS value FROM customer UNION ALL SELECT '/geo/customer/nation/@name', n_name FROM {C}")
_path("set2_same_path_once", "geo", "/geo/customer/@name | //customer/@name", "SELECT c_name AS name FROM customer")


@_query("agg5_references", "SELECT * FROM (VALUES ('geo', 0), ('customer', 1), ('nation', 1), ('order', 1), ('lineitem', 1)) AS t(name, refs)")
def _references(spark, sf_dir):
    m = fixtures.model("geo")
    return spark.createDataFrame([(t.name, m.refs(t.name)) for t in m.ordered()], "name string, refs int")


@_query("set3_shared_view", "SELECT 'buyer' AS parent, c_nationkey AS place, c_acctbal AS balance FROM customer UNION ALL SELECT 'seller', s_nationkey, s_acctbal FROM supplier")
def _shared_view(spark, sf_dir):
    e = _engine(spark, sf_dir, "shared")
    rows = e.table("contact", ["place", "balance", *[x.column for x in e.model.parents("contact")]])
    out = None
    for x in e.model.parents("contact"):
        part = rows.where(F.col(x.column).isNotNull()).select(F.lit(x.parent).alias("parent"), "place", "balance")
        out = part if out is None else out.unionAll(part)
    return out


@_query("lim1_first_of_each", "SELECT p_partkey::VARCHAR AS document_id, string_split(p_type, ' ')[1] AS content FROM part")
def _first_of_each(spark, sf_dir):
    return _engine(spark, sf_dir, "catalog").table("tag", ["document_id", "content", "serial_id"]).where("serial_id = 1").select("document_id", "content")


# Functions -------------------------------------------------------------------------------------------------------------

_value("fn08_string", "string(/catalog/part/name)", "p_name")
_value("fn09_concat", "concat(/catalog/part/brand, ' / ', /catalog/part/size)", "p_brand || ' / ' || p_size")
_value("fn10_starts_with", "starts-with(/catalog/part/type, 'PROMO')", "starts_with(p_type, 'PROMO')")
_value("fn11_contains", "contains(/catalog/part/type, 'BRASS')", "contains(p_type, 'BRASS')")
_value("fn12_substring_before", "substring-before(/catalog/part/type, ' ')", "CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, 1, strpos(p_type, ' ') - 1) ELSE '' END")
_value("fn13_substring_after", "substring-after(/catalog/part/brand, 'and#')", "CASE WHEN strpos(p_brand, 'and#') > 0 THEN substr(p_brand, strpos(p_brand, 'and#') + 4) ELSE '' END")
_value("fn14_substring", "substring(/catalog/part/name, 2.6, 4)", "substr(p_name, 3, 4)")
_value("fn14_substring_from", "substring(/catalog/part/name, -1, 5)", "substr(p_name, 1, 3)")
_value("fn15_string_length", "string-length(/catalog/part/name)", "length(p_name)::DOUBLE")
_value("fn16_normalize_space", "normalize-space(concat('  ', /catalog/part/brand, '  ', /catalog/part/type, ' '))", "trim(regexp_replace(p_brand || '  ' || p_type, '[ \t\r\n]+', ' ', 'g'))")
_value("fn17_translate", "translate(/catalog/part/type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'abcdefghijklmnopqrstuvwxyz')", "replace(lower(p_type), ' ', '')")
_value("fn18_boolean", "boolean(/catalog/part/size - 10)", "p_size <> 10")
_value("fn19_not", "not(/catalog/part/size > 10)", "NOT (p_size > 10)")
_value("fn20_true_false", "true() = (/catalog/part/size > 10) or false()", "p_size > 10")
_value("fn23_number", "number(substring-after(/catalog/part/brand, '#'))", "coalesce(try_cast(CASE WHEN strpos(p_brand, '#') > 0 THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END AS DOUBLE), 'nan'::DOUBLE)")
_value("fn25_floor", "floor(/catalog/part/price)", "floor(p_retailprice)")
_value("fn26_ceiling", "ceiling(/catalog/part/price)", "ceil(p_retailprice)")
_value("fn27_round", "round(/catalog/part/price)", "floor(p_retailprice + 0.5)")
_value("arith1_add", "/catalog/part/price + 1.5 - /catalog/part/size", "p_retailprice + 1.5::DOUBLE - p_size::DOUBLE")
_value("arith2_multiply", "/catalog/part/price * 2 div 4", "p_retailprice * 2 / 4")
_value("arith2_mod", "/catalog/part/size mod 7", "(p_size % 7)::DOUBLE")
_value("arith3_negate", "-/catalog/part/size", "-(p_size::DOUBLE)")
_path("arith4_number_predicate", "dialog", "/dialog/turn[1 + 1]/@role", f"SELECT role FROM {TURNS} WHERE i = 2")
_path("fn01_last", "dialog", "/dialog/turn[position() = last()]/@n", f"SELECT turn AS n FROM {TURNS} WHERE i = n")
_path("fn02_position", "dialog", "/dialog/turn[position() != 1]/@role", f"SELECT role FROM {TURNS} WHERE i <> 1")
_path("fn22_lang", "corpus", "//doc[lang('de')]/@id", "SELECT doc_id AS id FROM documents WHERE lower(lang) = 'de' OR lower(lang) LIKE 'de-%'")
_path("fn10_in_predicate", "catalog", "/catalog/part[starts-with(type, 'PROMO') and contains(name, 'a')]/@key", "SELECT p_partkey AS key FROM part WHERE starts_with(p_type, 'PROMO') AND contains(p_name, 'a')")
_path("fn15_in_predicate", "corpus", "//doc[string-length(.) > 5000]/@id", "SELECT doc_id AS id FROM documents WHERE length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) > 5000")

# Sources, shredding and sinks ------------------------------------------------------------------------------------------


@_query("src1_packed_files", "SELECT n_nationkey::VARCHAR AS document_id, n_name AS name FROM nation")
def _packed_files(spark, sf_dir):
    """Documents written as packed files of one line and read by their names."""
    n = fixtures.table(spark, sf_dir, "nation")
    folder = workspace.new_folder(spark, "files")
    xml = F.concat(F.lit("<nation>"), text_functions.xml_escape(F.col("n_name")), F.lit("</nation>"))
    n.select(F.col("n_nationkey").cast("string").alias("name"), xml.alias("value")).repartition("name").write.partitionBy("name").option("compression", "gzip").text(folder)
    files = readers.read_documents(spark, folder, extension=".txt")
    return files.select(F.regexp_extract("path", "name=([^/]+)", 1).alias("document_id"), F.regexp_extract("xml", "<nation>(.*)</nation>", 1).alias("name"))


@_query("src2_document_ids", "SELECT lower(replace(c_name, 'Customer', '')) AS document_id FROM customer")
def _document_ids(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "customer")
    return c.select(readers.document_id(F.concat(F.lit("/data/"), "c_name", F.lit(".xml.gz")), prefix="Customer", case="lower").alias("document_id"))


@_query("src5_shred_lineitem", f"SELECT o_custkey::VARCHAR AS document_id, i::INT AS serial_id, l_linenumber AS linenumber, l_quantity::{M2} AS quantity, l_extendedprice::{M2} AS extendedprice, l_discount::{M2} AS discount, l_tax::{M2} AS tax, l_returnflag AS returnflag, l_linestatus AS linestatus, l_shipdate::TIMESTAMP AS shipdate, l_partkey AS part, l_suppkey AS supplier FROM {LINES}")
def _shred_lineitem(spark, sf_dir):
    return _engine(spark, sf_dir, "geo").table("lineitem", ["document_id", "serial_id", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate", "part", "supplier"])


@_query("src5_shred_once", f"SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM {O} UNION ALL SELECT 'lineitem', count(*) FROM {L} UNION ALL SELECT 'nation', count(*) FROM customer UNION ALL SELECT 'geo', count(*) FROM customer")
def _shred_once(spark, sf_dir):
    tables = shred_all(fixtures.documents(spark, sf_dir, "geo"), fixtures.model("geo"), workspace.new_folder(spark, "tables"))
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@_query("key1_node_keys", f"SELECT o_orderkey AS key, 'sha1:' || right(sha1(o_custkey || '/geo/customer[1]/order[' || i || ']'), 16) AS digest, true AS same FROM {NUMBERED}")
def _node_keys(spark, sf_dir):
    """Keys as shredded against the same keys as expressions over the path, and the path's digest."""
    rows = _engine(spark, sf_dir, "geo").table("order", ["document_id", "order_id", "serial_id", "key"])
    path = F.concat("document_id", F.lit("/geo/customer[1]/order["), "serial_id", F.lit("]"))
    return rows.select("key", F.concat(F.lit("sha1:"), F.right(F.sha1(path), F.lit(16))).alias("digest"), (key_column(path) == F.col("order_id")).alias("same"))


def _written(spark, sf_dir, tab: bool) -> DataFrame:
    folder = workspace.new_folder(spark, "delimited")
    rows = _engine(spark, sf_dir, "dialog").table("turn", ["document_id", "serial_id", "role", "n", "content"])
    sinks.write_delimited(rows, folder, tab=tab)
    return readers.read_delimited(spark, folder, "document_id string, serial_id int, role string, n bigint, content string", tab=tab)


TURN_ROWS = f"SELECT conv_id::VARCHAR AS document_id, i::INT AS serial_id, role, turn AS n, CASE WHEN trim(text, ' \t\r\n') <> '' THEN text END AS content FROM {TURNS}"
_query("snk2_tab_separated", TURN_ROWS)(lambda spark, sf_dir: _written(spark, sf_dir, True))
_query("snk2_comma_separated", TURN_ROWS)(lambda spark, sf_dir: _written(spark, sf_dir, False))


@_query("snk3_append", f"SELECT o_orderkey AS key, o_orderstatus AS status FROM {O} UNION ALL SELECT o_orderkey, o_orderstatus FROM {O}")
def _append(spark, sf_dir):
    folder = workspace.new_folder(spark, "append")
    rows = workspace.stored(_engine(spark, sf_dir, "geo").table("order", ["key", "status"]))
    for _ in range(2):
        sinks.write_tables({"order": rows}, folder, append=True)
    return sinks.read_tables(spark, folder, ["order"])["order"]


@_query("snk4_upsert", f"SELECT c_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def _upsert(spark, sf_dir):
    rows = workspace.stored(_engine(spark, sf_dir, "geo").table("customer", ["key", "segment"]))
    return sync.upsert(rows, rows.where("segment = 'BUILDING'").withColumn("segment", F.lit("new")), "key")


@_query("snk5_delete_cascade", f"SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'order', count(*) FROM {O} WHERE c_acctbal >= 0 UNION ALL SELECT 'lineitem', count(*) FROM {L} WHERE c_acctbal >= 0")
def _delete(spark, sf_dir):
    rows, _ = _engine(spark, sf_dir, "geo").tables({"customer": ["document_id", "acctbal"], "order": ["document_id"], "lineitem": ["document_id"]})
    gone = rows["customer"].where("acctbal < 0").select("document_id")
    left = sync.delete_documents({t: df.select("document_id") for t, df in rows.items()}, gone)
    out = None
    for name, df in left.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@_query("snk1_ddl", "SELECT 'customer' AS name, 'bigint' AS kind, 'key' AS col UNION ALL SELECT 'order', 'bigint', 'key' UNION ALL SELECT 'order', 'decimal(18,2)', 'totalprice' UNION ALL SELECT 'customer', 'decimal(18,2)', 'acctbal' UNION ALL SELECT 'order', 'timestamp_ntz', 'date'")
def _ddl(spark, sf_dir):
    """Types of some columns as Spark reads the statements that the model gives."""
    m = fixtures.model("geo")
    rows = []
    for t, cs in (("customer", ("key", "acctbal")), ("order", ("key", "totalprice", "date"))):
        body = ddl.create_table(m, t)
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body).toString()
        rows += [(t, f.type(m.options), f.name) for f in m.tables[t].fields if f.name in cs and f.name in plan]
    return spark.createDataFrame(rows, "name string, kind string, col string")


@_query("flt7_values_dropped", "SELECT p_partkey::VARCHAR AS document_id, CASE WHEN NOT regexp_matches(p_type, 'STEEL|TIN') THEN p_type END AS type FROM part")
def _dropped(spark, sf_dir):
    return _engine(spark, sf_dir, "catalog", Filters(drop_values={"part.type": "STEEL|TIN"})).table("part", ["document_id", "type"])


@_query("flt9_constant", "SELECT p_partkey::VARCHAR AS document_id, 'n/a' AS brand FROM part")
def _constant(spark, sf_dir):
    return _engine(spark, sf_dir, "catalog", Filters(fill={"part.brand": "n/a"})).table("part", ["document_id", "brand"])


@_query("flt10_default", "SELECT p_partkey::VARCHAR AS document_id, 'none' AS note FROM part")
def _default(spark, sf_dir):
    return _engine(spark, sf_dir, "catalog", Filters(fill_default=True)).table("part", ["document_id", "note"])


@_query("flt11_checked", "SELECT p_partkey::VARCHAR AS document_id, CASE WHEN regexp_matches(p_brand, '^Brand#[1-3][0-9]*$') THEN p_brand END AS brand, CASE WHEN p_size BETWEEN 1 AND 25 THEN p_size END AS size FROM part")
def _checked(spark, sf_dir):
    return _engine(spark, sf_dir, "catalog", Filters(check_types=True)).table("part", ["document_id", "brand", "size"])


# Validation ------------------------------------------------------------------------------------------------------------


@_query("val1_invalid_values", "SELECT p_partkey::VARCHAR AS document_id, 'brand' AS \"column\", p_brand AS value, 'facet' AS reason FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]*$') UNION ALL SELECT p_partkey::VARCHAR, 'size', p_size::VARCHAR, 'facet' FROM part WHERE p_size NOT BETWEEN 1 AND 25")
def _invalid_values(spark, sf_dir):
    return validate.invalid_values(fixtures.documents(spark, sf_dir, "catalog"), fixtures.model("catalog"), "part")


CLOSED = fixtures.LOG.replace('<xs:any minOccurs="0" maxOccurs="unbounded" processContents="lax"/>', "").replace("<xs:anyAttribute/>", "")


@_query("val3_invalid_documents", "SELECT event_id::VARCHAR AS document_id, '/log/event/@user: unknown' AS error FROM events UNION ALL SELECT event_id::VARCHAR, '/log/event/k: unknown' FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _invalid_documents(spark, sf_dir):
    from treeline.schema.xsd import compile_schema

    return validate.invalid_documents(fixtures.documents(spark, sf_dir, "log"), compile_schema(CLOSED))


@_query("val7_checksums", "SELECT doc_id::VARCHAR AS document_id, md5(text) AS digest FROM documents")
def _checksums(spark, sf_dir):
    return sync.checksums(fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("xml")))


@_query("xsd12_duplicate_keys", f"SELECT o_custkey::VARCHAR AS document_id, l_linenumber AS linenumber, count(*) AS n FROM {L} GROUP BY 1, 2 HAVING count(*) > 1")
def _duplicate_keys(spark, sf_dir):
    return validate.duplicate_keys(_engine(spark, sf_dir, "geo").table("lineitem", ["document_id", "linenumber"]), ["linenumber"])


@_query("xsd13_orphans", f"SELECT o_orderkey AS key FROM {O} WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _orphans(spark, sf_dir):
    rows, _ = _engine(spark, sf_dir, "geo").tables({"order": ["order_id", "key"], "lineitem": ["order_id"]})
    return validate.orphans(rows["order"], ["order_id"], rows["lineitem"].withColumnRenamed("order_id", "of"), ["of"]).select("key")


# Publishing ------------------------------------------------------------------------------------------------------------


@_query("pub1_round_trip", "SELECT c_custkey::VARCHAR AS document_id, true AS same FROM customer")
def _round_trip(spark, sf_dir):
    """Documents shredded to stored tables and published again, against what they were: by their digests of 256 bits, so that
    texts need not be brought together once more."""
    docs = workspace.stored(fixtures.documents(spark, sf_dir, "geo"), "documents")
    model = fixtures.model("geo")
    e = Engine.of_tables(spark, shred_all(docs, model, workspace.new_folder(spark, "tables")), model)
    made = publish.to_xml(e).select(F.col("document_id").alias("d"), F.sha2("xml", 256).alias("made"))
    return docs.select("document_id", F.sha2("xml", 256).alias("was")).join(made, F.col("document_id") == F.col("d"), "left").select("document_id", F.coalesce(F.col("made") == F.col("was"), F.lit(False)).alias("same"))


@_query("pub2_fragments", "SELECT conv_id::VARCHAR AS document_id, count(*) AS turns FROM conversations GROUP BY 1")
def _fragments(spark, sf_dir):
    made = publish.to_xml(_engine(spark, sf_dir, "dialog"), "turn")
    return made.where(F.startswith("xml", F.lit("<turn"))).groupBy("document_id").agg(F.count("*").alias("turns"))


@_query("pub3_scalars", "SELECT '<brand>' || p_brand || '</brand>' AS xml FROM part")
def _scalars(spark, sf_dir):
    return publish.scalars_to_xml(_engine(spark, sf_dir, "catalog").xpath("/catalog/part/brand"), "brand", "brand")


@_query("pub4_json_objects", f"SELECT c_custkey::VARCHAR AS document_id, any_value(c_name) AS name, any_value(n_name) AS nation, count(o_orderkey) AS orders FROM {C} LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _json_objects(spark, sf_dir):
    made = publish.to_json(_engine(spark, sf_dir, "geo"), style=publish.JsonStyle(attribute_prefix=""))
    kind = "struct<geo:struct<customer:array<struct<name:string,nation:struct<name:string>,order:array<struct<key:bigint>>>>>>"
    c = F.get(F.col("j.geo.customer"), F.lit(0))
    return made.select("document_id", F.from_json("json", kind).alias("j")).select("document_id", c["name"].alias("name"), c["nation"]["name"].alias("nation"), F.coalesce(F.size(c["order"]), F.lit(0)).cast("bigint").alias("orders"))


@_query("pub5_json_columns", "SELECT conv_id::VARCHAR AS document_id, list(role ORDER BY i) AS roles FROM " + TURNS + " GROUP BY 1")
def _json_columns(spark, sf_dir):
    made = publish.to_json(_engine(spark, sf_dir, "dialog"), dialect="column")
    return made.select("document_id", F.from_json("json", "struct<dialog:struct<turn:struct<`@role`:array<string>>>>").alias("j")).select("document_id", F.col("j.dialog.turn.`@role`").alias("roles"))


@_query("pub7_json_tables", "SELECT conv_id::VARCHAR AS document_id, count(*) AS turns FROM conversations GROUP BY 1")
def _json_tables(spark, sf_dir):
    made = publish.relational_json(_engine(spark, sf_dir, "dialog"))
    return made.select("document_id", F.size(F.from_json("json", "struct<turn:array<struct<role:string>>>")["turn"]).cast("bigint").alias("turns"))


@_query("pub8_open_content", "SELECT event_id::VARCHAR AS document_id, '<k>' || json_extract_string(props, '$.k') || '</k>' AS open FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _open_content(spark, sf_dir):
    made = publish.to_xml(_engine(spark, sf_dir, "log"))
    return made.select("document_id", F.regexp_extract("xml", "<k>[^<]*</k>", 0).alias("open")).where("open != ''")


# Full text -------------------------------------------------------------------------------------------------------------


def _values(spark, sf_dir) -> DataFrame:
    e = _engine(spark, sf_dir, "catalog")
    return fulltext.field_values(e, fulltext.chosen_fields(e.model, ("part.name", "part.type")))


WORDS = "(SELECT p_partkey::VARCHAR AS document_id, k AS field, list_filter(regexp_split_to_array(lower(v), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 1) AS ws FROM (SELECT p_partkey, unnest(['part.name', 'part.type']) AS k, unnest([p_name, p_type]) AS v FROM part))"
TERMS = f"(SELECT document_id, field, unnest(ws) AS term, unnest(range(len(ws)))::INT AS position FROM {WORDS})"
DF = f"(SELECT term, count(*) AS freq, count(DISTINCT document_id) AS df FROM {TERMS} GROUP BY term)"


@_query("fts2_postings", f"SELECT term, field, document_id, count(*) AS tf, list(position ORDER BY position) AS positions FROM {TERMS} GROUP BY ALL")
def _postings(spark, sf_dir):
    return fulltext.postings(_values(spark, sf_dir))


@_query("fts1_field_values", "SELECT p_partkey::VARCHAR AS document_id, k AS field, v AS value FROM (SELECT p_partkey, unnest(['part.name', 'part.type']) AS k, unnest([p_name, p_type]) AS v FROM part)")
def _field_values(spark, sf_dir):
    return _values(spark, sf_dir)


@_query("fts3_update", f"SELECT term, document_id FROM {TERMS} JOIN part ON document_id = p_partkey::VARCHAR WHERE p_size > 10 GROUP BY ALL")
def _update(spark, sf_dir):
    post = fulltext.postings(_values(spark, sf_dir)).select("term", "document_id").distinct()
    gone = _engine(spark, sf_dir, "catalog").table("part", ["document_id", "size"]).where("size <= 10")
    return fulltext.update_postings(post, gone, post.where(F.lit(False)))


@_query("fts4_prefix", f"SELECT * FROM {DF} WHERE starts_with(term, 's') ORDER BY df DESC, term LIMIT 10")
def _prefix(spark, sf_dir):
    return fulltext.suggest_prefix(fulltext.term_frequencies(_values(spark, sf_dir)), "s")


@_query("fts5_infix", f"SELECT * FROM {DF} WHERE contains(term, 'an') ORDER BY df DESC, term LIMIT 10")
def _infix(spark, sf_dir):
    return fulltext.suggest_infix(fulltext.term_frequencies(_values(spark, sf_dir)), "an")


@_query("fts6_next_words", f"SELECT first, second, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY first ORDER BY n DESC, second) AS rank FROM (SELECT a.term AS first, b.term AS second, count(*) AS n FROM {TERMS} a JOIN {TERMS} b ON a.document_id = b.document_id AND a.field = b.field AND b.position = a.position + 1 GROUP BY 1, 2)) WHERE rank <= 5")
def _next(spark, sf_dir):
    return fulltext.next_words(_values(spark, sf_dir))


@_query("fts7_trigrams", f"SELECT term AS word, freq, list_aggregate(list_transform(range(1, length(term) + 3), lambda i: substr('__' || term || '__', i, 3)), 'string_agg', ' ') AS trigrams FROM {DF}")
def _trigrams(spark, sf_dir):
    return fulltext.trigram_dictionary(fulltext.term_frequencies(_values(spark, sf_dir)).select(F.col("term").alias("word"), "freq"))


@_query("fts8_content", "SELECT p_partkey::VARCHAR AS document_id, substr(CASE WHEN p_name = p_type THEN p_name WHEN p_name < p_type THEN p_name || chr(10) || p_type ELSE p_type || chr(10) || p_name END, 1, 2097152) AS content FROM part")
def _content(spark, sf_dir):
    return fulltext.capped_content(_values(spark, sf_dir))


@_query("agg6_merged_dictionaries", f"SELECT term AS word, (2 * freq)::BIGINT AS freq FROM {DF} WHERE 2 * freq >= 20")
def _merged(spark, sf_dir):
    words = fulltext.term_frequencies(_values(spark, sf_dir)).select(F.col("term").alias("word"), "freq")
    return fulltext.merge_dictionaries(words, words, least=20)


@_query("agg7_document_frequency", f"SELECT term, freq, df FROM {DF} WHERE df >= 5")
def _document_frequency(spark, sf_dir):
    return fulltext.term_frequencies(_values(spark, sf_dir)).where("df >= 5")


@_query("agg8_multi_values", "SELECT p_partkey::VARCHAR AS document_id, 'tag.content' AS field, array_to_string(list_sort(string_split(p_type, ' ')), ',') AS joined, list_min(string_split(p_type, ' ')) AS first FROM part")
def _multi(spark, sf_dir):
    e = _engine(spark, sf_dir, "catalog")
    return fulltext.multi_values(fulltext.field_values(e, fulltext.chosen_fields(e.model, ("tag.content",))))


@_query("flt12_min_word", f"SELECT term, count(*) AS freq, count(DISTINCT document_id) AS df FROM {TERMS} WHERE length(term) >= 5 GROUP BY term")
def _min_word(spark, sf_dir):
    return fulltext.term_frequencies(_values(spark, sf_dir), least=5)


@_query("fts_corpus_terms", "SELECT term, count(*) AS freq, count(DISTINCT d) AS df FROM (SELECT doc_id AS d, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS term FROM documents WHERE trim(text, ' \t\r\n') <> '') GROUP BY term")
def _corpus_terms(spark, sf_dir):
    e = _engine(spark, sf_dir, "corpus")
    return fulltext.term_frequencies(fulltext.field_values(e, fulltext.chosen_fields(e.model, ("doc.content",))), least=3)


@_query("snk11_search_documents", "SELECT p_partkey::VARCHAR AS document_id, p_brand AS brand FROM part")
def _search_documents(spark, sf_dir):
    e = _engine(spark, sf_dir, "catalog")
    made = fulltext.search_documents(_values(spark, sf_dir), fulltext.field_values(e, fulltext.chosen_fields(e.model, ("part.brand",))))
    return made.select("document_id", F.regexp_extract("xml", "<part__brand>(.*)</part__brand>", 1).alias("brand"))


@_query("set5_merged_sources", "SELECT c_nationkey::VARCHAR AS document_id, 'customer' AS source FROM customer GROUP BY 1 UNION SELECT s_nationkey::VARCHAR, 'supplier' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def _merged_sources(spark, sf_dir):
    a = fixtures.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("document_id"), F.lit("customer").alias("source")).distinct()
    b = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("document_id"), F.lit("supplier").alias("source")).distinct()
    return fulltext.merge_sources(a, b)


# Splitting, sharding, synchronising ------------------------------------------------------------------------------------


def _brands(spark, sf_dir) -> DataFrame:
    """One document for all parts of a brand, with a head before the first part."""
    p = fixtures.table(spark, sf_dir, "part")
    x = F.concat(F.lit('<part key="'), "p_partkey", F.lit('"><name>'), text_functions.xml_escape(F.col("p_name")), F.lit("</name></part>"))
    parts = p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(x)), "").alias("x"))
    return parts.select(F.col("p_brand").alias("document_id"), F.concat(F.lit("<catalog><head>"), "p_brand", F.lit("</head>"), "x", F.lit("</catalog>")).alias("xml"))


@_query("spl1_split", "SELECT p_partkey::VARCHAR AS document_id, p_brand AS source_id, '<catalog><head>' || p_brand || '</head><part key=\"' || p_partkey || '\"><name>' || p_name || '</name></part></catalog>' AS xml FROM part")
def _split(spark, sf_dir):
    return split.split_documents(_brands(spark, sf_dir), "/catalog/part", "/catalog/part/@key")


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Finished orders of each customer as they were loaded, and all but the open ones as they are now."""
    o = fixtures.table(spark, sf_dir, "orders")
    xml = F.concat(F.lit("<o>"), F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey"))).cast("array<string>"), ","), F.lit("</o>"))
    made = lambda df: df.groupBy(F.col("o_custkey").cast("string").alias("document_id")).agg(xml.alias("xml"))
    return made(o.where("o_orderstatus = 'F' and o_orderpriority != '5-LOW'")), made(o.where("o_orderstatus != 'O' and o_orderpriority != '4-NOT SPECIFIED'"))


_KEYS_OF = "SELECT o_custkey::VARCHAR AS document_id, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders WHERE {} GROUP BY 1"
STATUS = (
    f"(SELECT coalesce(a.document_id, b.document_id) AS document_id, CASE WHEN a.ks IS NULL THEN 'new' WHEN b.ks IS NULL THEN 'deleted' WHEN a.ks = b.ks THEN 'same' ELSE 'updated' END AS status "
    f"FROM ({_KEYS_OF.format('o_orderstatus = chr(70) AND o_orderpriority <> chr(53) || chr(45) || chr(76) || chr(79) || chr(87)')}) a FULL JOIN ({_KEYS_OF.format('o_orderstatus <> chr(79) AND o_orderpriority <> ' + chr(39) + '4-NOT SPECIFIED' + chr(39))}) b ON a.document_id = b.document_id)"
)


@_query("syn4_classify", f"SELECT document_id, status FROM {STATUS}")
def _classify(spark, sf_dir):
    old, now = _states(spark, sf_dir)
    return sync.classify(sync.checksums(old), sync.checksums(now))


@_query("syn4_report", f"SELECT status, count(*) AS documents FROM {STATUS} GROUP BY 1")
def _report(spark, sf_dir):
    old, now = _states(spark, sf_dir)
    return sync.report(sync.checksums(old), now)


def _synchronized(spark, sf_dir, weak: bool) -> DataFrame:
    old, now = _states(spark, sf_dir)
    rows = lambda d: {"o": d.select("document_id", F.regexp_extract("xml", "<o>(.*)</o>", 1).alias("orders"))}
    tables, _ = sync.synchronize(rows(old), sync.checksums(old), now, rows, weak=weak)
    return tables["o"]


_JOINED = "array_to_string(ks, ',') AS orders"
_OLD, _NOW = _KEYS_OF.format("o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'"), _KEYS_OF.format("o_orderstatus <> 'O' AND o_orderpriority <> '4-NOT SPECIFIED'")
_query("syn1_synchronize", f"SELECT document_id, {_JOINED} FROM ({_NOW})")(lambda spark, sf_dir: _synchronized(spark, sf_dir, False))
_query("syn2_add_only", f"SELECT document_id, {_JOINED} FROM ({_OLD}) UNION ALL SELECT document_id, {_JOINED} FROM ({_NOW}) WHERE document_id NOT IN (SELECT document_id FROM ({_OLD}))")(lambda spark, sf_dir: _synchronized(spark, sf_dir, True))


@_query("str1_stream_of_documents", TURN_ROWS)
def _stream(spark, sf_dir):
    folder = workspace.new_folder(spark, "stream")
    fixtures.documents(spark, sf_dir, "dialog").write.parquet(f"{folder}/in")
    ingest.ingest(ingest.document_stream(spark, f"{folder}/in"), fixtures.model("dialog"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return ingest.current(spark, f"{folder}/out", "turn").select("document_id", "serial_id", "role", "n", "content")


def _further() -> None:
    from treeline.plans import catalogue_more  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _further()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _further()
    return dict(_SQL)
