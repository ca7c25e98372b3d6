import pytest

from treeline.__main__ import arguments, run
from treeline.sources import fixtures


def call(spark, *words):
    run(arguments().parse_args([str(w) for w in words]), spark)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "s.xsd").write_text(fixtures.SHARED)
    (d / "in").mkdir()
    for k in range(3):
        (d / "in" / f"doc{k}.xml").write_text(f'<trade><buyer key="{k}" name="b{k}"><contact balance="{k}.5"><place>7</place></contact></buyer><seller key="{k + 10}"><contact balance="1"><place>{k}</place></contact></seller></trade>')
    return d


def test_schema_commands(spark, folder, capsys):
    call(spark, "ddl", "--xsd", folder / "s.xsd")
    call(spark, "jsonschema", "--xsd", folder / "s.xsd", "--dialect", "column", "--draft", "draft-07")
    call(spark, "check-schema", "--xsd", folder / "s.xsd")
    call(spark, "paths", "--xsd", folder / "s.xsd", "--query", "//contact/@balance")
    out = capsys.readouterr().out
    assert "CREATE TABLE `contact`" in out and "draft-07" in out and "valid" in out and out.endswith("/trade/buyer/contact/@balance\n/trade/seller/contact/@balance\n")
    with pytest.raises(SystemExit):
        call(spark, "check-schema", "--xsd", "<a/>")


def test_documents(spark, folder):
    common = ("--xsd", folder / "s.xsd", "--xml", folder / "in", "--out")
    call(spark, "shred", *common, folder / "t", "--check-types")
    assert spark.read.parquet(str(folder / "t" / "buyer")).count() == 3 and spark.read.parquet(str(folder / "t" / "contact")).count() == 6
    call(spark, "delimited", *common, folder / "d", "--keep", "seller")
    assert not (folder / "d" / "buyer").exists() and spark.read.text(str(folder / "d" / "seller")).count() == 3
    call(spark, "xpath", *common, folder / "q", "--query", "/trade/buyer[contact/@balance > $b]/@name", "--var", "b=1")
    assert sorted(r[0] for r in spark.read.parquet(str(folder / "q")).collect()) == ["b1", "b2"]
    call(spark, "xpath", *common, folder / "x", "--query", "/trade/buyer[@key=2]", "--as", "xml")
    assert [r["xml"] for r in spark.read.parquet(str(folder / "x")).collect()] == ['<buyer key="2" name="b2"><contact balance="2.5"><place>7</place></contact></buyer>']
    call(spark, "xpath", *common, folder / "j", "--query", "//buyer/@name", "--as", "json")
    assert spark.read.parquet(str(folder / "j")).count() == 3
    call(spark, "json", *common, folder / "o", "--dialect", "relational")
    call(spark, "validate", *common, folder / "v")
    assert spark.read.parquet(str(folder / "o")).count() == 3 and spark.read.parquet(str(folder / "v")).count() == 0
    call(spark, "dictionary", *common, folder / "w", "--field", "buyer.name")
    assert spark.read.parquet(str(folder / "w")).count() == 3


def test_splitting_and_checksums(spark, folder):
    files = ("--xml", folder / "in", "--out")
    call(spark, "split", *files, folder / "s", "--unit", "/trade/buyer", "--key", "/trade/buyer/@key", "--shards", 2)
    assert spark.read.parquet(str(folder / "s")).count() == 3
    call(spark, "checksums", *files, folder / "c")
    (folder / "in" / "doc9.xml").write_text("<trade/>")
    call(spark, "checksums", *files, folder / "c2", "--state", folder / "c")
    assert sorted(r["status"] for r in spark.read.parquet(str(folder / "c2")).collect()) == ["new", "same", "same", "same"]
