import json
import os

import pytest
from pyspark.sql import functions as F

from weft.cli import main
from weft.engine import Engine
from weft.functions import ids
from weft.operators import render
from weft.sources import dbtfacts, store
from weft.sources.pyfacts import python_facts
from weft.sources.repository import Config, ConfigError, list_files, load_config, repository_files
from weft.sources.sqltext import sql_facts

APP = '''
from __future__ import annotations
import requests
from fastapi import APIRouter, FastAPI
from langchain import ChatOpenAI, Chroma
from shared.util import clean
import shared.names as names

app = FastAPI()
router = APIRouter(prefix="/v1")

@router.get("/ask/{q}")
def ask(q):
    return answer(clean(q))

@app.post(PATH)
def dynamic(): ...

def answer(q):
    llm = ChatOpenAI(model="gpt-x")
    other = ChatOpenAI(model=MODEL)
    store = Chroma.from_texts([q], collection_name="notes")
    requests.get("https://User@API.example.com:8443/x")
    requests.get(URL)
    names.pick(q)
    return llm(store)

class Thing:
    def a(self):
        return self.b()
    def b(self):
        def inner(): return 1
        return inner()

def build(g):
    g.add_node("draft", answer)
    g.add_edge("draft", "check")
    g.add_conditional_edges("check", route, {"again": "draft", "done": "end"})

app.include_router(router, prefix="/api")
'''

SPARK = '''
import dlt
from pyspark.sql import SparkSession
TABLE = "silver." + "orders"
PAIRS = {"raw.a": "bronze.a", "raw.b": "bronze.b"}

def job(spark, name):
    df = spark.read.table("raw.orders")
    df.filter("x").createOrReplaceTempView("tmp_orders")
    spark.sql("select * from tmp_orders t join `dim`.Dates d on t.d = d.d").write.saveAsTable(TABLE)
    spark.read.table("raw.lines").where("x").createTempView("lines")
    spark.table(name)
    spark.sql(f"select * from {name}")

def loop(spark):
    for src, dst in PAIRS.items():
        spark.read.table(src).write.saveAsTable(dst)

@dlt.table(name="gold.daily")
def daily():
    return dlt.read("cleaned")

@dlt.view
def cleaned():
    return spark.table("silver.orders")

@dlt.table(name=DYNAMIC)
def skipped(): ...
'''

DATA = '''
import pandas as pd
from django.db import models
from sqlalchemy import select, text, insert
from app.models import Customer

class Order(models.Model):
    class Meta:
        db_table = "shop.orders"

class Base: ...
class Item(Base):
    __tablename__ = "items"
    __table_args__ = {"schema": "shop"}

def work(cur, session, con):
    cur.execute("INSERT INTO audit.log SELECT * FROM staging.events WHERE id = 1")
    cur.execute(query)
    session.execute(text("DELETE FROM tmp.x"))
    pd.read_sql_table("rates", con, schema="fx")
    Order.objects.filter(a=1).count()
    Customer.objects.create(a=1)
    session.execute(select(Item.id))
    session.execute(insert(Item))
'''


def links(rows):
    return {(r["source"], r["target"], r["type"]) for r in rows if r["kind"] == "edge"}


def known(rows):
    return {r["id"] for r in rows if r["kind"] == "node"}


def test_application_facts():
    rows = python_facts("src/app/main.py", APP)
    f = lambda n: f"python_function:app.main.{n}"
    got = links(rows)
    assert {
        ("python_module:shared.util", "python_module:app.main", "imported_by"), (f("answer"), f("ask"), "invoked_by"), ("python_function:shared.util.clean", f("ask"), "invoked_by"), ("python_function:shared.names.pick", f("answer"), "invoked_by"),
        (f("Thing.b"), f("Thing.a"), "invoked_by"), (f("Thing.b.inner"), f("Thing.b"), "invoked_by"), (f("ask"), "api_route:GET:/v1/ask/{q}", "invoked_by"), (f("ask"), "api_route:GET:/api/v1/ask/{q}", "invoked_by"),
        ("llm:openai:gpt-x", f("answer"), "invoked_by"), ("llm:openai:dynamic", f("answer"), "invoked_by"), ("vector_store:chroma", f("answer"), "retrieves_from"), ("vector_store:chroma", "vector_collection:notes", "feeds"), (f("answer"), "vector_collection:notes", "feeds"),
        (f("answer"), "external_system:api.example.com", "depends_on"), (f("answer"), "langgraph_node:draft", "invoked_by"), ("langgraph_node:draft", f("build"), "invoked_by"), ("langgraph_node:draft", "langgraph_node:check", "routes_to"), ("langgraph_node:check", "langgraph_node:end", "routes_to"),
    } <= got
    assert not any("__future__" in str(x) for x in got) and len([i for i in known(rows) if i.startswith("api_route")]) == 2 and len([i for i in known(rows) if i.startswith("external")]) == 1
    assert {r["metadata"].get("provisional") for r in rows if r["kind"] == "edge" and r["source"].startswith("python_function:shared")} == {"true"}


def test_spark_facts():
    rows = python_facts("jobs/orders.py", SPARK)
    f = lambda n: f"python_function:jobs.orders.{n}"
    view = "temp_view:jobs.orders:tmp_orders"
    got = links(rows)
    assert {
        ("sql_table:raw.orders", view, "read_by"), (view, f("job"), "read_by"), ("sql_table:dim.dates", f("job"), "read_by"), (f("job"), "sql_table:silver.orders", "writes_to"), ("sql_table:raw.a", f("loop"), "read_by"), (f("loop"), "sql_table:bronze.b", "writes_to"),
        (f("daily"), "sql_table:gold.daily", "writes_to"), ("pipeline_dataset:cleaned", f("daily"), "read_by"), (f("cleaned"), "pipeline_dataset:cleaned", "writes_to"), ("sql_table:silver.orders", f("cleaned"), "read_by"),
    } <= got
    assert ("sql_table:raw.lines", "temp_view:jobs.orders:lines", "read_by") in got and ("sql_table:raw.lines", f("job"), "read_by") not in got and not any("tmp_orders" in i for i in known(rows) if i.startswith("sql_table")) and not any("skipped" in s for s, *_ in got if "writes" in s)
    big = "P = [" + ",".join(f"'t{i}'" for i in range(65)) + "]\nfor t in P:\n    spark.table(t)\n"
    assert any("limit 64" in r["message"] for r in python_facts("a.py", big) if r["kind"] == "warning")


def test_database_facts():
    rows = python_facts("app/jobs.py", DATA)
    w = "python_function:app.jobs.work"
    assert {
        ("sql_table:shop.orders", "django_model:app.jobs.Order", "read_by"), ("sql_table:shop.items", "sqlalchemy_model:app.jobs.Item", "read_by"), ("sql_table:staging.events", w, "read_by"), (w, "sql_table:audit.log", "writes_to"), (w, "sql_table:tmp.x", "writes_to"),
        ("sql_table:fx.rates", w, "read_by"), ("django_model:app.jobs.Order", w, "read_by"), (w, "django_model:app.Customer", "writes_to"), ("sqlalchemy_model:app.jobs.Item", w, "read_by"), (w, "sqlalchemy_model:app.jobs.Item", "writes_to"),
    } <= links(rows)


def test_broken_python_is_a_warning():
    for text in ("def (", "x = '\0'", "(" * 5000):
        rows = python_facts("a/b.py", text)
        assert [r["kind"] for r in rows] == ["warning"] and "a/b.py" in rows[0]["message"]
    assert python_facts("a.py", "")[0]["id"] == "python_module:a"


@pytest.mark.parametrize(
    ("text", "sources", "target"),
    [
        ("SELECT * FROM a.B x, \"C\" JOIN [d].[e] ON 1 = 1 WHERE EXISTS (SELECT 1 FROM f)", ["a.b", "c", "d.e", "f"], None),
        ("WITH x AS (SELECT * FROM raw.t), y(a) AS (SELECT 1) SELECT * FROM x JOIN y ON true", ["raw.t"], None),
        ("CREATE OR REPLACE TABLE IF NOT EXISTS m.n AS SELECT extract(year FROM d) FROM s LEFT JOIN (SELECT * FROM q) z ON z.a = s.a", ["s", "q"], "m.n"),
        ("insert into t (a) select a from u union all select a from t", ["u"], "t"), ("UPDATE t SET a = b FROM c WHERE t.x = c.x", ["c"], "t"), ("DELETE FROM t USING v WHERE 1 = 1", ["v"], "t"),
        ("MERGE INTO t USING (SELECT * FROM s) s ON 1 = 1 WHEN MATCHED THEN UPDATE SET a = 1", ["s"], "t"), ("SELECT trim(both FROM x), a IS DISTINCT FROM b FROM generate_series(1, 2) g, k", ["k"], None), ("TRUNCATE TABLE t", [], None),
    ],
)
def test_sql_tables(text, sources, target):
    facts, error = sql_facts(text)
    assert error is None and [(list(f.sources), f.target) for f in facts] == [(sources, target)]


@pytest.mark.parametrize("text", ["SELECT * FROM", "SELCT 1", "SELECT (1", "SELECT 'a", "SELECT a FROM t WHERE", "not sql"])
def test_unreadable_sql(text):
    assert sql_facts(text)[1]


def test_dbt_references():
    text = "{# {{ ref('no') }} #}\nselect * from {{ ref( 'a' ) }} join {{- ref('pkg', \"b\") -}} on true\njoin {{ source('raw','t') }} on true"
    assert list(dbtfacts.references(text)) == [("ref", "a", 2), ("ref", "b", 2), ("source", "raw.t", 3)]
    assert any(r["kind"] == "warning" for r in dbtfacts.model_facts("m.sql", "select {{ 1"))
    manifest = {"nodes": {"model.p.m": {"name": "m", "resource_type": "model", "schema": "s", "depends_on": {"nodes": ["source.p.raw.t", "model.p.a"]}}}, "sources": {"source.p.raw.t": {"source_name": "raw", "name": "t"}}}
    assert links(dbtfacts.manifest_facts("target/manifest.json", json.dumps(manifest))) == {("dbt_source:raw.t", "dbt_model:m", "source"), ("dbt_model:a", "dbt_model:m", "ref")}
    assert dbtfacts.manifest_facts("x", "{")[0]["kind"] == "warning"


@pytest.mark.parametrize("text", ["{{ref('a')}}", "{{ ref ( 'a' , ) }}", "{{- REF(\n'p' ,\n 'a') -}}", "{{ ref('a', v=2) }}", "{{ ref(\"a\")"])
def test_spellings_of_references(text):
    assert list(dbtfacts.references(text)) == [("ref", "a", 1)]


def test_extractors_can_be_added_and_may_fail(spark):
    from weft.sources import repository

    before = list(repository.EXTRACTORS)
    try:
        repository.register_extractor(repository.Extractor("lines", lambda p, t, d: p.endswith(".txt"), lambda p, t: [{"kind": "node", "parser": "lines", "id": f"text:{p}", "name": p, "type": "text"}]))
        repository.register_extractor(repository.Extractor("broken", lambda p, t, d: True, lambda p, t: 1 / 0))
        df = spark.createDataFrame([("a.txt", "x"), ("b.py", None)], "path string, content string")
        rows = repository.extract_facts(df).collect()
        assert [(r["kind"], r["id"] or r["message"]) for r in rows] == [("node", "text:a.txt"), ("warning", "Warning: broken failed on a.txt: ZeroDivisionError")]
    finally:
        repository.EXTRACTORS[:] = before


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return str(root)


FILES = {
    "src/app/__init__.py": "", "src/app/main.py": APP, "shared/util.py": "def clean(x): return x\n", "jobs/orders.py": SPARK, "sql/mart.SQL": "create table mart.x as select * from silver.orders", "sql/broken.sql": "selct 1 from",
    "dbt/dbt_project.yml": "name: d\n", "dbt/models/sources.yml": "sources:\n- name: raw\n  tables:\n  - name: orders\n", "dbt/models/stg.sql": "select * from {{ source('raw', 'orders') }}", "dbt/models/mart.sql": "select * from {{ ref('stg') }}",
    ".venv/x.py": "x", "node_modules/a.py": "x", "a.egg-info/b.py": "x", "notes.txt": "x", "bad.py": b"\xff\xfe", "broken.py": "def (", "unused.py": "def helper(): return other()\ndef other(): return 1\n",
}


def test_scan_keeps_lineage(spark, tmp_path):
    root = write(tmp_path, FILES)
    graph = Engine(spark).scan(root)
    found = {r["id"] for r in graph.nodes.collect()}
    assert {"sql_table:mart.x", "sql_table:gold.daily", "dbt_model:mart", "dbt_model:stg", "llm:openai:gpt-x", "vector_collection:notes", "external_system:api.example.com", "api_route:GET:/api/v1/ask/{q}"} <= found
    assert "dbt_source:raw.orders" in found and "sql_table:raw.orders" not in found  # the reference became its declaration
    assert not {"python_function:unused.helper", "python_function:unused.other", "python_module:requests"} & found
    text = " ".join(graph.warnings)
    assert "bad.py: not UTF-8" in text and "syntax error in broken.py:1" in text and "unable to parse SQL in sql/broken.sql" in text
    assert graph.resolve("gold.daily") == "sql_table:gold.daily"
    hit = {r["id"]: r["depth"] for r in graph.impact("dbt_source:raw.orders").collect()}
    assert hit["dbt_model:stg"] == 1 and hit["dbt_model:mart"] == 2 and "sql_table:gold.daily" in hit
    assert {r["id"] for r in graph.upstream("dbt_model:mart").collect()} == {"dbt_model:stg"} and "dbt_source:raw.orders" in {r["id"] for r in graph.ancestors("dbt_model:mart").collect()}
    again = Engine(spark).scan(root)
    assert graph.document()["nodes"] == again.document()["nodes"] and graph.document()["edges"] == again.document()["edges"]
    page = graph.to_html(str(tmp_path / "out.html"))
    html = open(page, encoding="utf-8").read()
    assert "http://" not in html.replace("http://www.w3.org/2000/svg", "") and "<script src" not in html and "def ask" not in html
    assert graph.to_mermaid().startswith("graph LR\n") and "↓" in graph.to_chains()
    graph.register_views("g")
    assert spark.sql("select count(*) from g_nodes").first()[0] == len(found)
    store.save_parquet(graph.graph, str(tmp_path / "graph"))
    assert Engine(spark).load(str(tmp_path / "graph")).nodes.count() == len(found)


def test_file_listing(spark, tmp_path):
    root = write(tmp_path, FILES | {"weft.yml": "x", "deep/.github/y.yaml": ""})
    os.symlink(root, os.path.join(root, "loop"))
    rel = [p for p, _ in list_files(root)[0]]
    assert "src/app/__init__.py" in rel and "sql/mart.SQL" in rel and "weft.yml" not in rel and not [p for p in rel if "venv" in p or "egg" in p or "node_modules" in p or p.startswith("loop")]
    assert [p for p, _ in list_files(root, ["**/*.sql"], ["dbt/**"])[0]] == ["sql/broken.sql"]
    assert list_files(os.path.join(root, "missing"))[1]
    write(tmp_path, {"dbt/target/manifest.json": "{}"})
    assert "dbt/target/manifest.json" in [p for p, _ in list_files(root)[0]]
    rows = {r["path"]: r for r in repository_files(spark, root, Config(include=["*.py"])).collect()}
    assert rows["bad.py"]["warning"].endswith("not UTF-8") and rows["unused.py"]["content"].startswith("def helper")
    few = spark.read.format("repo_files").options(path=root, maxbytes="10").load().filter("path = 'jobs/orders.py'").first()
    assert few["content"] is None and "large" in few["warning"]


def test_configuration(tmp_path):
    assert load_config(str(tmp_path)).include == []
    pytest.importorskip("yaml")
    for text, ok in (("include:\nexclude: [a]\nodd: 1\n", True), ("include: a\n", False), ("[", False), ("- a\n", False), ("output: ' '\n", False)):
        write(tmp_path, {"weft.yml": text})
        if ok:
            config = load_config(str(tmp_path))
            assert (config.include, config.exclude, len(config.warnings)) == ([], ["a"], 1)
        else:
            with pytest.raises(ConfigError):
                load_config(str(tmp_path))
    with pytest.raises(ConfigError):
        load_config(str(tmp_path), str(tmp_path / "none.yml"))


def test_store_round_trip_and_errors(spark, tmp_path):
    document = {
        "version": "0.1", "project": {"name": "p", "path": "/p"}, "scan": {"timestamp": "2024-01-01T00:00:00Z", "files_scanned": 1, "warnings": []},
        "nodes": [{"id": "a", "name": "A \"q\"", "type": "t", "file_path": None, "line_number": 3, "metadata": {"b": [1, {"d": 1, "c": None}], "a": "é"}}, {"id": "b", "name": "B", "type": "t", "file_path": "f", "line_number": None, "metadata": {}}],
        "edges": [{"source": "a", "target": "b", "type": "x", "confidence": "high", "evidence": "p|q", "metadata": {"n": 1}}, {"source": "a", "target": "b", "type": "y", "confidence": "low", "evidence": None, "metadata": {}}],
    }
    path = store.write_text(str(tmp_path / "g.json"), store.render_json(document))
    again = Engine(spark).load(path).document()
    assert again["nodes"] == [{**document["nodes"][0], "metadata": {"a": "é", "b": [1, {"c": None, "d": 1}]}}, document["nodes"][1]] and again["edges"] == document["edges"]
    with pytest.raises(store.GraphNotFound):
        store.load_document(str(tmp_path / "none.json"))
    for text in ("{", "[]", '{"nodes": [{}], "edges": []}'):
        store.write_text(path, text)
        with pytest.raises(store.StoreError):
            store.load_graph(spark, path)
    with pytest.raises(TypeError):
        store.write_text(path, 5)
    assert sorted(os.listdir(tmp_path)) == ["g.json"]


def test_embedded_json_cannot_leave_its_script():
    text = render.embed_json({"a": "</script>&\u2028\u2029"})
    assert not set("<>&\u2028\u2029") & set(text) and json.loads(text) == {"a": "</script>&\u2028\u2029"}


def test_command_line(spark, tmp_path, capsys):
    root = write(tmp_path, {"a.py": "def f(spark):\n    spark.read.table('x.y').write.saveAsTable('z.w')\n", "b.py": "import a\ndef g():\n    return a.f(1)\n"})
    assert main(["impact", "x.y", "--root", root]) == 1
    assert main(["scan", root, "--verbose"]) == 0 and "2 files, 0 in Python, 3 nodes" in capsys.readouterr().out
    assert main(["impact", "x.y", "--json", "--root", root]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["resolved_id"] == "sql_table:x.y" and [r["id"] for r in got["direct"]] == ["python_function:a.f"] and {r["id"] for r in got["downstream"]} == {"sql_table:z.w"} and got["affected_count"] == 2
    assert main(["impact", "x.y", "--depth", "1", "--root", root]) == 0 and "(none)" in capsys.readouterr().out
    assert main(["impact", "sql_table:x.z", "--root", root]) == 1 and "Did you mean" in capsys.readouterr().err
    assert main(["impact", "sql_table:x.z", "--json", "--root", root]) == 1
    document = json.loads(capsys.readouterr().out)
    assert document["error"] == "node_not_found" and document["query"] == "sql_table:x.z" and set(document["suggestions"][0]) == {"id", "name", "type", "file_path"}
    assert main(["impact", "x.y", "--depth", "0", "--root", root]) == 1 and main(["graph", root, "--open"]) == 1 and main(["graph", root, "--json", "--html"]) == 1
    capsys.readouterr()
    assert main(["graph", root, "--json"]) == 0 and len(json.loads(capsys.readouterr().out)["edges"]) == 2
    assert main(["graph", root, "--mermaid"]) == 0 and main(["graph", root]) == 0 and "↓" in capsys.readouterr().out
    assert main(["graph", root, "--html", "--include-source"]) == 0 and "saveAsTable" in open(capsys.readouterr().out.strip(), encoding="utf-8").read()
    assert main(["scan", os.path.join(root, "none")]) == 1


def test_identifiers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert value(ids.sql_table_id(lit(' "Db" . `T` '))) == "sql_table:db.t" and value(ids.sql_table_id(lit("[a].[b c]"))) == "sql_table:a.b c"
    assert value(ids.relation_key(lit(" '' "))) is None and value(ids.node_id("x", lit(" a "), lit(" "), lit("b"))) == "x:a:b"
    with pytest.raises(Exception, match="at least one part"):
        value(ids.node_id("x", lit(" ")))
    assert value(ids.api_route_id(lit("get"), lit("a/b"))) == "api_route:GET:/a/b" and value(ids.api_route_id(lit("get"), lit(""))) == "api_route:GET:/"
    assert value(ids.join_paths(lit("/v1/"), lit("x"))) == "/v1/x" and value(ids.join_paths(lit(""), lit("x"))) == "/x"
    assert value(ids.external_system_id(lit("HTTPS://u@[::1]:80/x"))) == "external_system:::1" and value(ids.http_host(lit("ftp://a/b"))) is None and value(ids.http_host(lit("http://A.b:1/c"))) == "a.b"
    assert value(ids.module_of_path(lit("src/a/__init__.py"))) == "a" and value(ids.temp_view_id(lit(" "), lit("V"))) == "temp_view:__main__:v"
    assert value(ids.django_model_id(lit("app.models"), lit("A"))) == "django_model:app.A" and value(ids.llm_id(lit("m"), lit("p"))) == "llm:p:m"
    assert value(ids.python_function_id(lit("a.b"), lit("C.d"))) == "python_function:a.b.C.d" and value(ids.dbt_source_id(lit("Raw"), lit("t"))) == "dbt_source:Raw.t"
    assert value(ids.vector_store_id(lit("Qdrant"))) == "vector_store:qdrant" and value(ids.sqlalchemy_model_id(lit("m"), lit("A"))) == "sqlalchemy_model:m.A"
    assert value(ids.looks_like_sql(lit(" ((SELECT;"))) and not value(ids.looks_like_sql(lit("selection"))) and value(ids.jinja_is_unbalanced(lit("{{ a }")))
