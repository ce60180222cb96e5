"""Queries of the extractors and of dataset identity over written fixtures, and the rows that the rules give for them.

Fixtures are short sources written for one family of rules each. The SQL states the expected rows as values, each checked
against the rules; they pin results, and are no second computation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import identity, resolve
from weft.operators.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from weft.sources import store
from weft.sources.repository import extract_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FIXTURES: dict[str, dict[str, str]] = {
    "python": {
        "src/shop/cart.py": '''
from __future__ import annotations
import json, shop.stock as stock
from shop.tax import rate
from . import prices
from .codes import *

def total(items):
    def line(i):
        return i.price
    check()
    stock.reserve(items)
    a.b.c()
    return rate(line(items))

def check():
    return unknown()

class Cart:
    async def add(self, x):
        self.save()
    def save(self):
        save()

total([])
''',
        "src/shop/__init__.py": "",
        "broken.py": "def (:\n",
    },
    "routes": {
        "api/main.py": '''
app = FastAPI(prefix="/base")
items = APIRouter(prefix="/items")
plain = APIRouter()

@app.get("health")
async def health(): ...

@items.post("/{id}")
@items.put(path="/{id}/x")
def change(id): ...

@items.delete(PATH)
def dynamic(): ...

@plain.patch("/")
def root(): ...

app.include_router(items, prefix="v2")
app.include_router(plain)
app.include_router(items, prefix=PREFIX)
''',
    },
    "langgraph": {
        "bots/flow.py": '''
def draft(state): ...

def build(g):
    g.add_node("draft", draft)
    g.add_node(node="review", action=imported)
    g.add_edge(START, "draft")
    g.add_edge("draft", "review")
    g.add_edge(start_key="review", end_key="send")
    g.add_conditional_edges("review", pick, {"again": "draft", "done": "send"})
    g.add_conditional_edges("send", pick)
''',
    },
    "models": {
        "bots/rag.py": '''
def answer(q):
    a = ChatOpenAI(model="m-1")
    b = AzureOpenAI(azure_deployment="dep")
    c = ChatAnthropic(model_name=NAME)
    d = OpenAI()
    e = OpenAIEmbeddings(model="emb")
    f = SentenceTransformer("mini")
    return a

def fill(docs):
    Chroma.from_documents(docs, collection_name="notes")

def load():
    s = QdrantVectorStore(collection_name="faq")
    t = FAISS.load_local(index_name=WHICH)
    return s
''',
    },
    "http": {
        "net/calls.py": '''
import requests
requests.get("https://boot.example.com/x")

def sync(session):
    requests.post("https://User:pw@API.Example.com:8443/v1?q=1")
    session.request("PUT", "http://files.example.com")
    session.get(url="https://api.example.com/other")
    requests.get(URL)
    requests.get("ftp://old.example.com")
    requests.get("/relative")
''',
    },
    "spark": {
        "jobs/daily.py": '''
import dlt
LAYER = "silver"
TARGET = LAYER + ".orders"
PAIRS = {"raw.a": "bronze.a"}

def load(spark, name):
    df = spark.read.table("Raw.Orders")
    df.where("x > 0").createOrReplaceTempView("fresh")
    spark.sql("select * from fresh f join dim.days d on f.d = d.d").write.saveAsTable(TARGET)
    spark.table(name)
    spark.sql(f"select * from {name}")

def copy(spark):
    for src, dst in PAIRS.items():
        spark.table(src).writeTo(dst)

@dlt.table(name="gold.daily")
def daily():
    return dlt.read("staged")

@dlt.view
def staged():
    return spark.readStream.table(f"silver.orders")

@dlt.table(name=WHICH)
def skipped():
    return dlt.read_stream("staged")
''',
    },
    "embedded_sql": {
        "db/work.py": '''
QUERY = "delete from tmp.old"

def run(cur, con, session):
    cur.execute("INSERT INTO audit.log SELECT * FROM staging.events e JOIN staging.users u ON e.u = u.u")
    cur.executemany(QUERY)
    session.execute(text("with c as (select * from raw.t) select * from c"))
    pd.read_sql("select 1 from fx.rates", con)
    pd.read_sql_table("rates", con, schema="eu")
    cur.execute(build())
    cur.execute("selec broken from nowhere")
''',
    },
    "django": {
        "shop/models.py": '''
from django.db import models

class Order(models.Model):
    class Meta:
        db_table = "shop.orders"

class Draft(models.Model):
    class Meta:
        db_table = NAME
''',
        "shop/views.py": '''
from shop.models import Order

def seen(request):
    return Order.objects.filter(a=1)

def made(request):
    Order.objects.create(a=1)

def raw(request):
    Order.objects.raw("select * from audit.orders")
''',
    },
    "sqlalchemy": {
        "shop/tables.py": '''
from sqlalchemy import delete, insert, select
from sqlalchemy.orm import DeclarativeBase

class Base(DeclarativeBase): ...

class Item(Base):
    __tablename__ = "items"
    __table_args__ = {"schema": "shop"}

class Plain(Base):
    __tablename__ = TABLE

def read(session):
    return session.execute(select(Item.id))

def write(session):
    session.execute(insert(Item))
    session.execute(delete(Plain))
''',
    },
    "sql": {
        "etl/load.sql": '''
-- a comment ; with a semicolon
CREATE TABLE mart.daily AS WITH d AS (SELECT * FROM raw.days) SELECT * FROM d JOIN "Raw"."Orders" o ON d.d = o.d;
INSERT INTO mart.daily SELECT * FROM mart.daily UNION ALL SELECT * FROM stage.late;
MERGE INTO mart.users USING (SELECT * FROM stage.users) s ON s.id = mart.users.id WHEN MATCHED THEN DELETE;
UPDATE a.t, a.u SET a.t.x = a.u.x WHERE a.t.i = a.u.i;
SELECT * FROM solo.read;
''',
        "etl/words.sql": "CREATE TABLE x AS SELEC * FROM y",
        "etl/operators.sql": "SELECT 1 +* 2 FROM z",
        "etl/order.sql": "select * from a group order b",
        "etl/aliases.sql": "SELECT a b c d FROM t x y z",
        "etl/brackets.sql": "SELECT TOP 5 [n] FROM [dbo].[Rows]",
    },
    "dbt": {
        "dbt/dbt_project.yml": "name: shop\n",
        "dbt/models/sources.yml": "sources:\n- name: raw\n  tables:\n  - name: orders\n  - name: users\n",
        "dbt/models/stg.sql": "select * from {{ source('raw', 'orders') }} {# {{ ref('gone') }} #}",
        "dbt/models/mart.sql": "select * from {{ ref('stg') }}\njoin {{- ref( 'pkg', \"dim\", v=2 ) -}} on true\njoin {{ ref(dynamic) }} on true",
        "dbt/target/manifest.json": '{"nodes": {"model.p.mart": {"name": "mart", "resource_type": "model", "schema": "s", "depends_on": {"nodes": ["source.p.raw.users", "model.p.mart"]}}}, "sources": {"source.p.raw.users": {"source_name": "raw", "name": "users"}}}',
    },
}


def facts(spark: SparkSession, family: str) -> DataFrame:
    files = spark.createDataFrame(list(FIXTURES[family].items()), "path string, content string")
    return extract_facts(files)


def _shown(found: DataFrame) -> DataFrame:
    """(kind, subject, target, type, confidence, evidence): nodes, edges, and the files that gave warnings, each once."""
    subject = F.when(F.col("kind") == "warning", F.col("file")).otherwise(F.coalesce("id", "source"))
    return found.select("kind", subject.alias("subject"), "target", "type", F.col("confidence").cast("int").alias("confidence"), "evidence").distinct()


#: What the rules give: nodes (id, type), edges (source, target, type, confidence, evidence) and files with a warning.
EXPECTED: dict[str, tuple[tuple, ...]] = {}

EXPECTED["python"] = (
    ("node", "python_function:shop.cart.Cart.add", "python_function"),
    ("node", "python_function:shop.cart.Cart.save", "python_function"),
    ("node", "python_function:shop.cart.check", "python_function"),
    ("node", "python_function:shop.cart.total", "python_function"),
    ("node", "python_function:shop.cart.total.line", "python_function"),
    ("node", "python_module:json", "python_module"),
    ("node", "python_module:shop", "python_module"),
    ("node", "python_module:shop.cart", "python_module"),
    ("node", "python_module:shop.codes", "python_module"),
    ("node", "python_module:shop.prices", "python_module"),
    ("node", "python_module:shop.stock", "python_module"),
    ("node", "python_module:shop.tax", "python_module"),
    ("edge", "python_function:shop.cart.Cart.save", "python_function:shop.cart.Cart.add", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:shop.cart.check", "python_function:shop.cart.total", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:shop.cart.total", "python_module:shop.cart", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:shop.cart.total.line", "python_function:shop.cart.total", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:shop.stock.reserve", "python_function:shop.cart.total", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:shop.tax.rate", "python_function:shop.cart.total", "invoked_by", 2, "ast.Call"),
    ("edge", "python_module:json", "python_module:shop.cart", "imported_by", 2, "ast.Import"),
    ("edge", "python_module:shop.codes", "python_module:shop.cart", "imported_by", 2, "ast.Import"),
    ("edge", "python_module:shop.prices", "python_module:shop.cart", "imported_by", 2, "ast.Import"),
    ("edge", "python_module:shop.stock", "python_module:shop.cart", "imported_by", 2, "ast.Import"),
    ("edge", "python_module:shop.tax", "python_module:shop.cart", "imported_by", 2, "ast.Import"),
    ("warning", "broken.py"),
)

EXPECTED["routes"] = (
    ("node", "api_route:GET:/base/health", "api_route"),
    ("node", "api_route:PATCH:/", "api_route"),
    ("node", "api_route:POST:/items/{id}", "api_route"),
    ("node", "api_route:POST:/v2/items/{id}", "api_route"),
    ("node", "api_route:PUT:/items/{id}/x", "api_route"),
    ("node", "api_route:PUT:/v2/items/{id}/x", "api_route"),
    ("node", "python_function:api.main.change", "python_function"),
    ("node", "python_function:api.main.dynamic", "python_function"),
    ("node", "python_function:api.main.health", "python_function"),
    ("node", "python_function:api.main.root", "python_function"),
    ("node", "python_module:api.main", "python_module"),
    ("node", "sqlalchemy_model:api.main.PATH", "sqlalchemy_model"),
    ("edge", "python_function:api.main.change", "api_route:POST:/items/{id}", "invoked_by", 2, "fastapi_decorator"),
    ("edge", "python_function:api.main.change", "api_route:POST:/v2/items/{id}", "invoked_by", 2, "fastapi_decorator"),
    ("edge", "python_function:api.main.change", "api_route:PUT:/items/{id}/x", "invoked_by", 2, "fastapi_decorator"),
    ("edge", "python_function:api.main.change", "api_route:PUT:/v2/items/{id}/x", "invoked_by", 2, "fastapi_decorator"),
    ("edge", "python_function:api.main.dynamic", "sqlalchemy_model:api.main.PATH", "writes_to", 1, "sqlalchemy.delete"),
    ("edge", "python_function:api.main.health", "api_route:GET:/base/health", "invoked_by", 2, "fastapi_decorator"),
    ("edge", "python_function:api.main.root", "api_route:PATCH:/", "invoked_by", 2, "fastapi_decorator"),
)

EXPECTED["langgraph"] = (
    ("node", "langgraph_node:draft", "langgraph_node"),
    ("node", "langgraph_node:review", "langgraph_node"),
    ("node", "langgraph_node:send", "langgraph_node"),
    ("node", "python_function:bots.flow.build", "python_function"),
    ("node", "python_function:bots.flow.draft", "python_function"),
    ("node", "python_module:bots.flow", "python_module"),
    ("edge", "langgraph_node:draft", "langgraph_node:review", "routes_to", 2, "langgraph_add_edge"),
    ("edge", "langgraph_node:draft", "python_function:bots.flow.build", "invoked_by", 1, "langgraph_builder"),
    ("edge", "langgraph_node:review", "langgraph_node:draft", "routes_to", 1, "langgraph_conditional_edge"),
    ("edge", "langgraph_node:review", "langgraph_node:send", "routes_to", 2, "langgraph_add_edge"),
    ("edge", "langgraph_node:review", "langgraph_node:send", "routes_to", 1, "langgraph_conditional_edge"),
    ("edge", "langgraph_node:review", "python_function:bots.flow.build", "invoked_by", 1, "langgraph_builder"),
    ("edge", "python_function:bots.flow.draft", "langgraph_node:draft", "invoked_by", 2, "langgraph_add_node"),
)

EXPECTED["models"] = (
    ("node", "embedding_model:emb", "embedding_model"),
    ("node", "embedding_model:mini", "embedding_model"),
    ("node", "llm:anthropic:dynamic", "llm"),
    ("node", "llm:azure:dep", "llm"),
    ("node", "llm:openai", "llm"),
    ("node", "llm:openai:m-1", "llm"),
    ("node", "python_function:bots.rag.answer", "python_function"),
    ("node", "python_function:bots.rag.fill", "python_function"),
    ("node", "python_function:bots.rag.load", "python_function"),
    ("node", "python_module:bots.rag", "python_module"),
    ("node", "vector_collection:faq", "vector_collection"),
    ("node", "vector_collection:notes", "vector_collection"),
    ("node", "vector_store:chroma", "vector_store"),
    ("node", "vector_store:faiss", "vector_store"),
    ("node", "vector_store:qdrant", "vector_store"),
    ("edge", "embedding_model:emb", "python_function:bots.rag.answer", "embeds_with", 1, "embedding_constructor"),
    ("edge", "embedding_model:mini", "python_function:bots.rag.answer", "embeds_with", 1, "embedding_constructor"),
    ("edge", "llm:anthropic:dynamic", "python_function:bots.rag.answer", "invoked_by", 1, "llm_constructor"),
    ("edge", "llm:azure:dep", "python_function:bots.rag.answer", "invoked_by", 1, "llm_constructor"),
    ("edge", "llm:openai", "python_function:bots.rag.answer", "invoked_by", 1, "llm_constructor"),
    ("edge", "llm:openai:m-1", "python_function:bots.rag.answer", "invoked_by", 1, "llm_constructor"),
    ("edge", "python_function:bots.rag.fill", "vector_collection:notes", "feeds", 1, "vector_collection_write"),
    ("edge", "vector_collection:faq", "python_function:bots.rag.load", "retrieves_from", 1, "vector_collection_read"),
    ("edge", "vector_store:chroma", "python_function:bots.rag.fill", "retrieves_from", 1, "vector_store_constructor"),
    ("edge", "vector_store:chroma", "vector_collection:notes", "feeds", 2, "vector_store_constructor"),
    ("edge", "vector_store:faiss", "python_function:bots.rag.load", "retrieves_from", 1, "vector_store_constructor"),
    ("edge", "vector_store:qdrant", "python_function:bots.rag.load", "retrieves_from", 1, "vector_store_constructor"),
    ("edge", "vector_store:qdrant", "vector_collection:faq", "feeds", 2, "vector_store_constructor"),
)

EXPECTED["http"] = (
    ("node", "external_system:api.example.com", "external_system"),
    ("node", "external_system:boot.example.com", "external_system"),
    ("node", "external_system:files.example.com", "external_system"),
    ("node", "python_function:net.calls.sync", "python_function"),
    ("node", "python_module:net.calls", "python_module"),
    ("node", "python_module:requests", "python_module"),
    ("edge", "python_function:net.calls.sync", "external_system:api.example.com", "depends_on", 1, "http_call"),
    ("edge", "python_function:net.calls.sync", "external_system:files.example.com", "depends_on", 1, "http_call"),
    ("edge", "python_function:requests.get", "python_function:net.calls.sync", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:requests.get", "python_module:net.calls", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:requests.post", "python_function:net.calls.sync", "invoked_by", 2, "ast.Call"),
    ("edge", "python_module:requests", "python_module:net.calls", "imported_by", 2, "ast.Import"),
)

EXPECTED["spark"] = (
    ("node", "pipeline_dataset:staged", "pipeline_dataset"),
    ("node", "python_function:jobs.daily.copy", "python_function"),
    ("node", "python_function:jobs.daily.daily", "python_function"),
    ("node", "python_function:jobs.daily.load", "python_function"),
    ("node", "python_function:jobs.daily.skipped", "python_function"),
    ("node", "python_function:jobs.daily.staged", "python_function"),
    ("node", "python_module:dlt", "python_module"),
    ("node", "python_module:jobs.daily", "python_module"),
    ("node", "sql_table:bronze.a", "sql_table"),
    ("node", "sql_table:dim.days", "sql_table"),
    ("node", "sql_table:gold.daily", "sql_table"),
    ("node", "sql_table:raw.a", "sql_table"),
    ("node", "sql_table:raw.orders", "sql_table"),
    ("node", "sql_table:silver.orders", "sql_table"),
    ("node", "temp_view:jobs.daily:fresh", "temp_view"),
    ("edge", "pipeline_dataset:staged", "python_function:jobs.daily.daily", "read_by", 2, "dlt.read"),
    ("edge", "pipeline_dataset:staged", "python_function:jobs.daily.skipped", "read_by", 2, "dlt.read_stream"),
    ("edge", "python_function:dlt.read", "python_function:jobs.daily.daily", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:dlt.read_stream", "python_function:jobs.daily.skipped", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:dlt.table", "python_function:jobs.daily.daily", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:dlt.table", "python_function:jobs.daily.skipped", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:jobs.daily.copy", "sql_table:bronze.a", "writes_to", 2, "spark.writeTo"),
    ("edge", "python_function:jobs.daily.daily", "sql_table:gold.daily", "writes_to", 2, "dlt.table"),
    ("edge", "python_function:jobs.daily.staged", "pipeline_dataset:staged", "writes_to", 2, "dlt.view"),
    ("edge", "python_module:dlt", "python_module:jobs.daily", "imported_by", 2, "ast.Import"),
    ("edge", "sql_table:dim.days", "python_function:jobs.daily.load", "read_by", 2, "spark.sql"),
    ("edge", "sql_table:raw.a", "python_function:jobs.daily.copy", "read_by", 2, "spark.table"),
    ("edge", "sql_table:raw.orders", "python_function:jobs.daily.load", "read_by", 2, "spark.read.table"),
    ("edge", "sql_table:raw.orders", "temp_view:jobs.daily:fresh", "read_by", 2, "spark.createOrReplaceTempView"),
    ("edge", "sql_table:silver.orders", "python_function:jobs.daily.staged", "read_by", 2, "spark.readStream.table"),
    ("edge", "temp_view:jobs.daily:fresh", "python_function:jobs.daily.load", "read_by", 2, "spark.sql"),
)

EXPECTED["embedded_sql"] = (
    ("node", "python_function:db.work.run", "python_function"),
    ("node", "python_module:db.work", "python_module"),
    ("node", "sql_table:audit.log", "sql_table"),
    ("node", "sql_table:eu.rates", "sql_table"),
    ("node", "sql_table:fx.rates", "sql_table"),
    ("node", "sql_table:raw.t", "sql_table"),
    ("node", "sql_table:staging.events", "sql_table"),
    ("node", "sql_table:staging.users", "sql_table"),
    ("node", "sql_table:tmp.old", "sql_table"),
    ("edge", "python_function:db.work.run", "sql_table:audit.log", "writes_to", 2, "cursor.execute"),
    ("edge", "python_function:db.work.run", "sql_table:tmp.old", "writes_to", 2, "cursor.executemany"),
    ("edge", "sql_table:eu.rates", "python_function:db.work.run", "read_by", 2, "pandas.read_sql_table"),
    ("edge", "sql_table:fx.rates", "python_function:db.work.run", "read_by", 2, "pandas.read_sql"),
    ("edge", "sql_table:raw.t", "python_function:db.work.run", "read_by", 2, "cursor.execute"),
    ("edge", "sql_table:raw.t", "python_function:db.work.run", "read_by", 2, "text"),
    ("edge", "sql_table:staging.events", "python_function:db.work.run", "read_by", 2, "cursor.execute"),
    ("edge", "sql_table:staging.users", "python_function:db.work.run", "read_by", 2, "cursor.execute"),
)

EXPECTED["django"] = (
    ("node", "django_model:shop.Draft", "django_model"),
    ("node", "django_model:shop.Order", "django_model"),
    ("node", "python_function:shop.views.made", "python_function"),
    ("node", "python_function:shop.views.raw", "python_function"),
    ("node", "python_function:shop.views.seen", "python_function"),
    ("node", "python_module:django.db", "python_module"),
    ("node", "python_module:shop.models", "python_module"),
    ("node", "python_module:shop.views", "python_module"),
    ("node", "sql_table:audit.orders", "sql_table"),
    ("node", "sql_table:shop.orders", "sql_table"),
    ("edge", "django_model:shop.Order", "python_function:shop.views.raw", "read_by", 1, "django.objects.raw"),
    ("edge", "django_model:shop.Order", "python_function:shop.views.seen", "read_by", 1, "django.objects.filter"),
    ("edge", "python_function:shop.views.made", "django_model:shop.Order", "writes_to", 1, "django.objects.create"),
    ("edge", "python_module:django.db", "python_module:shop.models", "imported_by", 2, "ast.Import"),
    ("edge", "python_module:shop.models", "python_module:shop.views", "imported_by", 2, "ast.Import"),
    ("edge", "sql_table:audit.orders", "python_function:shop.views.raw", "read_by", 2, "django.objects.raw"),
    ("edge", "sql_table:shop.orders", "django_model:shop.Order", "read_by", 2, "django.Meta.db_table"),
)

EXPECTED["sqlalchemy"] = (
    ("node", "python_function:shop.tables.read", "python_function"),
    ("node", "python_function:shop.tables.write", "python_function"),
    ("node", "python_module:shop.tables", "python_module"),
    ("node", "python_module:sqlalchemy", "python_module"),
    ("node", "python_module:sqlalchemy.orm", "python_module"),
    ("node", "sql_table:shop.items", "sql_table"),
    ("node", "sqlalchemy_model:shop.tables.Item", "sqlalchemy_model"),
    ("node", "sqlalchemy_model:shop.tables.Plain", "sqlalchemy_model"),
    ("edge", "python_function:shop.tables.write", "sqlalchemy_model:shop.tables.Item", "writes_to", 1, "sqlalchemy.insert"),
    ("edge", "python_function:shop.tables.write", "sqlalchemy_model:shop.tables.Plain", "writes_to", 1, "sqlalchemy.delete"),
    ("edge", "python_function:sqlalchemy.delete", "python_function:shop.tables.write", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:sqlalchemy.insert", "python_function:shop.tables.write", "invoked_by", 2, "ast.Call"),
    ("edge", "python_function:sqlalchemy.select", "python_function:shop.tables.read", "invoked_by", 2, "ast.Call"),
    ("edge", "python_module:sqlalchemy", "python_module:shop.tables", "imported_by", 2, "ast.Import"),
    ("edge", "python_module:sqlalchemy.orm", "python_module:shop.tables", "imported_by", 2, "ast.Import"),
    ("edge", "sql_table:shop.items", "sqlalchemy_model:shop.tables.Item", "read_by", 2, "sqlalchemy.__tablename__"),
    ("edge", "sqlalchemy_model:shop.tables.Item", "python_function:shop.tables.read", "read_by", 1, "sqlalchemy.select"),
)

EXPECTED["sql"] = (
    ("node", "sql_table:a.t", "sql_table"),
    ("node", "sql_table:a.u", "sql_table"),
    ("node", "sql_table:dbo.rows", "sql_table"),
    ("node", "sql_table:mart.daily", "sql_table"),
    ("node", "sql_table:mart.users", "sql_table"),
    ("node", "sql_table:raw.days", "sql_table"),
    ("node", "sql_table:raw.orders", "sql_table"),
    ("node", "sql_table:solo.read", "sql_table"),
    ("node", "sql_table:stage.late", "sql_table"),
    ("node", "sql_table:stage.users", "sql_table"),
    ("edge", "sql_table:a.u", "sql_table:a.t", "read_by", 2, "sql_statement"),
    ("edge", "sql_table:raw.days", "sql_table:mart.daily", "read_by", 2, "sql_statement"),
    ("edge", "sql_table:raw.orders", "sql_table:mart.daily", "read_by", 2, "sql_statement"),
    ("edge", "sql_table:stage.late", "sql_table:mart.daily", "read_by", 2, "sql_statement"),
    ("edge", "sql_table:stage.users", "sql_table:mart.users", "read_by", 2, "sql_statement"),
    ("warning", "etl/aliases.sql"),
    ("warning", "etl/operators.sql"),
    ("warning", "etl/order.sql"),
    ("warning", "etl/words.sql"),
)

EXPECTED["dbt"] = (
    ("node", "dbt_model:dim", "dbt_model"),
    ("node", "dbt_model:mart", "dbt_model"),
    ("node", "dbt_model:stg", "dbt_model"),
    ("node", "dbt_source:raw.orders", "dbt_source"),
    ("node", "dbt_source:raw.users", "dbt_source"),
    ("edge", "dbt_model:dim", "dbt_model:mart", "ref", 2, "dbt_ref"),
    ("edge", "dbt_model:stg", "dbt_model:mart", "ref", 2, "dbt_ref"),
    ("edge", "dbt_source:raw.orders", "dbt_model:stg", "source", 2, "dbt_source"),
    ("edge", "dbt_source:raw.users", "dbt_model:mart", "source", 2, "dbt_manifest"),
)


def _values(rows: list[tuple], columns: str) -> str:
    """Rows as a SQL query."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _expected(family: str) -> str:
    rows = []
    for kind, *rest in EXPECTED[family]:
        if kind == "edge":
            source, target, name, confidence, evidence = rest
            rows.append((kind, source, target, name, confidence, evidence))
        else:
            rows.append((kind, rest[0], None, rest[1] if kind == "node" else None, None, None))
    return _values(rows, "kind, subject, target, type, confidence, evidence")


def _add(family: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(facts(spark, family))

    run.__name__, run.__doc__ = f"extract_{family}", f"Facts of the {family} fixture."
    QUERIES[run.__name__], ORACLE[run.__name__] = run, _expected(family)


for _family in FIXTURES:
    _add(_family)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _graph(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> Graph:
    """Nodes (id, type, metadata) and edges (source, target, type)."""
    rows = [(i, i.rpartition(":")[2], t, None, None, m) for i, t, m in nodes]
    return Graph(spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame([(*e, 1, ["x"], None) for e in edges], EDGE_SCHEMA))


_IDENTITY_NODES = [
    ("pipeline_dataset:clean", "pipeline_dataset", {"dataset_declaration": "true"}), ("sql_table:clean", "sql_table", {"table": '"clean"'}), ("dbt_model:orders", "dbt_model", {"schema": '"Mart"'}),
    ("sql_table:mart.orders", "sql_table", {"sql_file": "true"}), ("sql_table:orders", "sql_table", None), ("sql_table:other.orders", "sql_table", None), ("dbt_source:raw.Users", "dbt_source", None),
    ("sql_table:raw.users", "sql_table", None), ("dbt_model:a", "dbt_model", {"relation_name": '"x.y"'}), ("dbt_model:b", "dbt_model", {"relation_name": '"`X`.`Y`"'}), ("sql_table:x.y", "sql_table", None), ("f", "python_function", None),
]
_IDENTITY_EDGES = [
    ("sql_table:raw.users", "f", "read_by"), ("f", "sql_table:mart.orders", "writes_to"), ("f", "sql_table:orders", "writes_to"), ("dbt_model:orders", "sql_table:mart.orders", "ref"), ("sql_table:other.orders", "f", "read_by"),
    ("f", "sql_table:clean", "writes_to"), ("sql_table:x.y", "f", "read_by"),
]


@query(_values(
    [
        ("node", "pipeline_dataset:clean", None, "pipeline_dataset", "clean"), ("node", "dbt_model:orders", None, "dbt_model", "mart.orders"), ("node", "sql_table:other.orders", None, "sql_table", None),
        ("node", "dbt_source:raw.Users", None, "dbt_source", "raw.users"), ("node", "dbt_model:a", None, "dbt_model", None), ("node", "dbt_model:b", None, "dbt_model", None), ("node", "sql_table:x.y", None, "sql_table", None),
        ("node", "f", None, "python_function", None), ("edge", "dbt_source:raw.Users", "f", "read_by", None), ("edge", "f", "dbt_model:orders", "writes_to", None), ("edge", "sql_table:other.orders", "f", "read_by", None),
        ("edge", "f", "pipeline_dataset:clean", "writes_to", None), ("edge", "sql_table:x.y", "f", "read_by", None),
    ],
    "kind, subject, target, type, referenced_as",
))
def identity_full(spark, sf):
    """References merged into their declarations: by dataset, relation, source and bare name, and those that stay."""
    g = identity.resolve_identity(_graph(spark, _IDENTITY_NODES, _IDENTITY_EDGES))
    known = F.get_json_object(F.concat(F.lit('{"v":'), F.col("metadata")["referenced_as"], F.lit("}")), "$.v")
    nodes = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("subject"), F.lit(None).cast("string").alias("target"), "type", known.alias("referenced_as"))
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("source").alias("subject"), "target", "type", F.lit(None).cast("string").alias("referenced_as")))


# shares of equal characters, twice their number by the length of both texts
@query("SELECT id, similarity::DOUBLE AS similarity FROM (" + _values([("sql_table:raw.orders", 0.974359), ("sql_table:raw.orders_old", 0.883721), ("sql_table:row.order", 0.894737)], "id, similarity") + ")")
def suggest_close(spark, sf):
    """The nodes most like a misspelt id, with their similarity."""
    ids = ["sql_table:raw.orders", "sql_table:raw.orders_old", "sql_table:row.order", "llm:x", "f"]
    found = resolve.suggest(_graph(spark, [(i, "t", None) for i in ids], [("f", "f", "t")]).nodes.withColumn("name", F.lit("~")), "sql_table:raw.ordrs")
    return found.select("id", F.round("similarity", 6).alias("similarity"))


_MADE = {
    "module": ("python_module:a.B", lambda: ids.python_module_id(F.lit(" a.B "))), "function": ("python_function:a.b.C.f", lambda: ids.python_function_id(F.lit("a.b"), F.lit("C.f"))),
    "table": ("sql_table:gold.my t", lambda: ids.sql_table_id(F.lit(" `Gold` . [My T] ."))), "dbt_model": ("dbt_model:Stg", lambda: ids.dbt_model_id(F.lit(" Stg "))),
    "dbt_source": ("dbt_source:Raw.Orders", lambda: ids.dbt_source_id(F.lit("Raw"), F.lit(" Orders"))), "dataset": ("pipeline_dataset:a.b", lambda: ids.pipeline_dataset_id(F.lit('"A".b'))),
    "view": ("temp_view:__main__:tmp", lambda: ids.temp_view_id(F.lit(" "), F.lit("TMP"))), "view_of": ("temp_view:a.b:tmp", lambda: ids.temp_view_id(F.lit("a.b"), F.lit("tmp"))),
    "django": ("django_model:shop.Order", lambda: ids.django_model_id(F.lit("shop.models"), F.lit("Order"))), "sqlalchemy": ("sqlalchemy_model:shop.models.Item", lambda: ids.sqlalchemy_model_id(F.lit("shop.models"), F.lit("Item"))),
    "llm": ("llm:openai:m", lambda: ids.llm_id(F.lit("m"), F.lit("openai"))), "llm_bare": ("llm:openai", lambda: ids.llm_id(F.lit(" "), F.lit("openai"))), "embedding": ("embedding_model:E-1", lambda: ids.embedding_model_id(F.lit("E-1"))),
    "store": ("vector_store:chroma", lambda: ids.vector_store_id(F.lit("Chroma"))), "collection": ("vector_collection:Notes", lambda: ids.vector_collection_id(F.lit("Notes"))),
    "collection_of": ("vector_collection:faiss:Notes", lambda: ids.vector_collection_id(F.lit("Notes"), F.lit("FAISS"))), "step": ("langgraph_node:draft", lambda: ids.langgraph_node_id(F.lit("draft"))),
    "host": ("external_system:api.example.com", lambda: ids.external_system_id(F.lit("HTTPS://u:p@API.example.com:8443/x?y"))), "host_v6": ("external_system:::1", lambda: ids.external_system_id(F.lit("http://[::1]:80/"))),
    "route": ("api_route:GET:/x", lambda: ids.api_route_id(F.lit("get"), F.lit("x"))), "route_root": ("api_route:POST:/", lambda: ids.api_route_id(F.lit("post"), F.lit(""))),
}


@query(_values([(name, made) for name, (made, _) in _MADE.items()], "kind, id"))
def id_makers(spark, sf):
    """One id of every kind."""
    made = F.array(*(F.struct(F.lit(name).alias("kind"), make().alias("id")) for name, (_, make) in _MADE.items()))
    return spark.range(1).select(F.inline(made))


@query(_values(
    [
        ('{"source":"a \\"q\\"","target":"b","type":"t","confidence":"high","evidence":"p|q","metadata":{"k":1,"l":"x"}}',), ('{"source":"b","target":"c","type":"t","confidence":"low","evidence":null,"metadata":{}}',),
        ('{"source":"b","target":"c","type":"u","confidence":"medium","evidence":"e","metadata":{"n":null}}',),
    ],
    "line",
))
def canonical_edges(spark, sf):
    """Edges as canonical JSON objects: words for confidence, evidence in one text, metadata by key."""
    rows = [("b", "c", "u", 1, ["e"], {"n": None}), ("a \"q\"", "b", "t", 2, ["p", "q"], {"l": '"x"', "k": "1"}), ("b", "c", "t", 0, [], None)]
    return store.json_rows(Graph(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame(rows, EDGE_SCHEMA)))[1]

