import io
import json
import zipfile

from pyspark.sql import functions as F

from lakewright.sources import feeds, files, sinks


def test_tolerant_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id;nome;"valor; R$"\n1;x;"2;5"\n2;y\n3;z;4;too;many\n4;"q ""w""";\n', encoding="utf-8")
    df = files.read_text_csv(spark, str(p))
    assert df.columns == ["id", "nome", "valor; R$"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "x", "2;5"), ("2", "y", None), ("4", 'q "w"', None)]


def test_typed_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a;b\n1;x\n2;y\n", encoding="utf-8")
    assert dict(files.read_typed_csv(spark, str(p)).dtypes) == {"a": "int", "b": "string"}


def test_dialects_are_all_read(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("nome;v\nação;1\n".encode("utf-8"))
    (tmp_path / "w.csv").write_bytes("nome;v\n“não” – ok;2\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("nome,v\nx,3\n".encode("utf-8"))
    charsets = {r.path.rsplit("/", 1)[-1]: r.encoding for r in files.charset_of_files(spark, str(tmp_path)).collect()}
    assert charsets == {"u.csv": "UTF-8", "w.csv": "windows-1252", "c.csv": "UTF-8"}
    parts = files.read_csv_files(spark, str(tmp_path))
    assert len(parts) == 3
    assert sorted(r.nome for p in parts for r in p.collect()) == ["ação", "x", "“não” – ok"]
    from lakewright.operators.unify import unify

    u = unify(parts)
    assert u.types["v"].simpleString() == "double" and u.df.agg(F.sum("v")).first()[0] == 6.0


def test_sniff():
    assert files.sniff_delimiter("a;b,c") == ";" and files.sniff_delimiter("a,b,c;d") == ","


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("in/ner.csv", "a;b\n1;2\n")
        z.writestr("readme.txt", "no")
    (tmp_path / "set.zip").write_bytes(buffer.getvalue())
    rows = files.archive_members(spark, str(tmp_path / "*.zip")).collect()
    assert [(r.member, bytes(r.content)) for r in rows] == [("set__ner.csv", b"a;b\n1;2\n")]


def test_inventory_and_csv(spark, tmp_path):
    src = tmp_path / "src"
    (src / "x" / "__pycache__").mkdir(parents=True)
    (src / "x" / "__pycache__" / "n.pyc").write_bytes(b"1")
    (src / "x" / "B.CSV").write_bytes(b"12345")
    (src / "a.parquet").write_bytes(b"12")
    inv = files.inventory(spark, str(src))
    assert sorted((r.extension, r.bytes) for r in inv.collect()) == [(".csv", 5), (".parquet", 2)]
    plan = inv._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]
    sinks.write_inventory(inv, str(tmp_path / "inv"))
    assert spark.read.csv(str(tmp_path / "inv"), header=True).count() == 2
    here = files.direct_children(spark.createDataFrame([("d/a",), ("d/e/b",), ("d/",), ("x/c",)], "path string"), "d/")
    assert [r.path for r in here.collect()] == ["d/a"]


def test_metadata_and_dictionary(spark, tmp_path):
    (tmp_path / "tab_a.json").write_text(json.dumps({"tabela": "a", "linhas": 3}, indent=1), encoding="utf-8")
    (tmp_path / "tab_b.json").write_text(json.dumps({"tabela": "b"}), encoding="utf-8")
    meta = files.read_metadata(spark, str(tmp_path))
    assert sorted((r.stem, r.linhas) for r in meta.collect()) == [("tab_a", 3), ("tab_b", None)]
    raw = json.dumps({"dicionario_simplificado": [{"codigo": "Val X", "descricao": " d "}, {"codigo": "k"}]})
    out = files.dictionary_entries(spark.createDataFrame([(raw,)], "value string"))
    assert [tuple(r) for r in out.collect()] == [("Val X", "d"), ("k", "")]


def test_feed(spark):
    xml = ("<rss><channel><title> Veículo </title><item><title>Um &amp; dois</title><link>https://a/1</link><pubDate>hoje</pubDate></item>"
           "<item><title>Sem link</title></item></channel></rss>")
    bare = "<rss><channel><item><title>t</title><link>l</link></item></channel></rss>"
    df = spark.createDataFrame([("https://h.org/feed", xml), ("https://k.org/feed", bare)], "feed string, xml string")
    got = sorted(tuple(r) for r in feeds.feed_items(df).collect())
    assert got == [
        ("https://h.org/feed", "Veículo", "Sem link", "", ""), ("https://h.org/feed", "Veículo", "Um & dois", "https://a/1", "hoje"),
        ("https://k.org/feed", "k.org", "t", "l", ""),
    ]
