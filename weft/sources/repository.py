"""Source repositories as a data source, and the facts of their files.

``spark.read.format("repo_files")`` walks a directory on the driver, which only lists names, and reads contents on
executors. Unlike file formats of Spark it does not hide names that begin with ``_`` or ``.``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.errors import ConfigError
from weft.functions.ids import glob_regex
from weft.sources import dbtfacts
from weft.sources.pyfacts import python_facts

#: Directories that hold no sources of a repository; fixed values.
IGNORED_DIRS = frozenset((
    ".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".next", ".cursor",
    ".eggs", ".idea", ".vscode", ".tox", ".nox", "htmlcov", "site-packages", "graphify-out", ".weft",
))
SUFFIXES = (".py", ".sql", ".yml", ".yaml")
#: Larger files are skipped with a warning; fixed value.
MAX_BYTES = 10 * 1024 * 1024
CONFIG_FILE = "weft.yml"
#: Where a dbt project keeps what it compiled; read beside the project file if it is there.
MANIFEST = "target/manifest.json"

FILE_SCHEMA = "path string, abs_path string, length long, content string, warning string"
FACT_SCHEMA = (
    "file string, parser string, seq int, kind string, id string, name string, type string, line_number int, source string, target string, "
    "confidence tinyint, evidence string, metadata map<string,string>, message string"
)


@dataclass
class Config:
    """What to scan and where the graph goes; unknown keys are ignored with a warning."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    output: str = "graph.json"
    warnings: list[str] = field(default_factory=list)


def load_config(root: str, path: str | None = None) -> Config:
    """The configuration of a repository; a missing file gives defaults, a broken one a ``ConfigError``."""
    file = path or os.path.join(root, CONFIG_FILE)
    if not os.path.exists(file):
        if path:
            raise ConfigError(f"no configuration at {path}")
        return Config()
    try:
        import yaml

        with open(file, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
    except ImportError as e:
        raise ConfigError("a configuration needs PyYAML") from e
    except Exception as e:  # noqa: BLE001
        raise ConfigError(f"unable to read {file}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{file} is no mapping")
    config = Config()
    for key, value in data.items():
        if key in ("include", "exclude"):
            value = [] if value is None else value
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise ConfigError(f"{key} must be a list of patterns")
            setattr(config, key, value)
        elif key == "output":
            if not isinstance(value, str) or not value.strip():
                raise ConfigError("output must be a path")
            config.output = value
        else:
            config.warnings.append(f"Warning: unknown configuration key {key}")
    return config


def _matches(rel: str, patterns: list[str]) -> bool:
    rel = rel.lstrip("./")
    base = rel.rpartition("/")[2]
    return any(re.match(rx, rel) or re.match(rx, base) for rx in (glob_regex(p.lstrip("./")) for p in patterns))


def list_files(root: str, include: list[str] = (), exclude: list[str] = ()) -> tuple[list[tuple[str, str]], list[str]]:
    """(relative path, absolute path) of the files to read, in order of names, and warnings about unreadable places."""
    found: list[tuple[str, str]] = []
    warnings: list[str] = []
    seen: set[str] = set()

    def walk(folder: str, rel: str) -> None:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        try:
            names = sorted(os.listdir(folder))
        except OSError as e:
            warnings.append(f"Warning: unable to read {rel or '.'}: {e.strerror}")
            return
        for name in names:
            full, own = os.path.join(folder, name), f"{rel}/{name}" if rel else name
            if os.path.isdir(full):
                if name in IGNORED_DIRS or name.endswith(".egg-info") or (exclude and (_matches(own, list(exclude)) or _matches(own + "/_", list(exclude)))):
                    continue
                walk(full, own)
            elif name.lower().endswith(SUFFIXES) and own != CONFIG_FILE:
                if (include and not _matches(own, list(include))) or _matches(own, list(exclude)):
                    continue
                found.append((own, os.path.abspath(full)))
                manifest = os.path.join(folder, MANIFEST)
                if name.lower() in ("dbt_project.yml", "dbt_project.yaml") and os.path.isfile(manifest):
                    found.append((f"{rel}/{MANIFEST}" if rel else MANIFEST, os.path.abspath(manifest)))

    walk(root, "")
    return found, warnings


class _Batch(InputPartition):
    def __init__(self, files: list[tuple[str, str]], warnings: list[str]):
        self.files, self.warnings = files, warnings


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("batch", "200"))
        self.include, self.exclude = (([p for p in options.get(k, "").split("\n") if p]) for k in ("include", "exclude"))
        self.limit = int(options.get("maxbytes", MAX_BYTES))

    def partitions(self) -> list[InputPartition]:
        files, warnings = list_files(self.root, self.include, self.exclude)
        batches = [_Batch(files[i : i + self.size], []) for i in range(0, len(files), self.size)] or [_Batch([], [])]
        batches[0].warnings = warnings
        return batches

    def read(self, partition: _Batch) -> Iterator[tuple]:
        for message in partition.warnings:
            yield (None, None, None, None, message)
        for rel, full in partition.files:
            try:
                length = os.stat(full).st_size
                if length > self.limit:
                    yield (rel, full, length, None, f"Warning: skipped large file {rel}")
                    continue
                with open(full, "rb") as f:
                    data = f.read()
                yield (rel, full, length, data.decode("utf-8"), None)
            except UnicodeDecodeError:
                yield (rel, full, length, None, f"Warning: unable to read {rel}: not UTF-8")
            except OSError as e:
                yield (rel, full, None, None, f"Warning: unable to read {rel}: {e.strerror}")


class RepositorySource(DataSource):
    """The files of a source repository; options path, include, exclude (patterns, one a line), batch, maxbytes."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def repository_files(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """The files of a repository on a folder that all executors share."""
    config = config or Config()
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repo_files").options(path=root, include="\n".join(config.include), exclude="\n".join(config.exclude)).load()


@dataclass(frozen=True)
class Extractor:
    """One kind of facts: whether it claims a file, and the facts of a text.

    ``claims(path, text, in_dbt)`` and ``facts(path, text)`` run on executors, so they must be importable there.
    """

    name: str
    claims: Callable[[str, str, bool], bool]
    facts: Callable[[str, str], list[dict]]


def _suffix(path: str, *suffixes: str) -> bool:
    return path.lower().endswith(suffixes)


#: All extractors that claim a file read it, in this order.
EXTRACTORS: list[Extractor] = [
    Extractor("python", lambda path, text, in_dbt: _suffix(path, ".py"), python_facts),
    Extractor("sql", lambda path, text, in_dbt: _suffix(path, ".sql") and not dbtfacts.is_jinja(text), dbtfacts.sql_file_facts),
    Extractor("dbt_model", lambda path, text, in_dbt: _suffix(path, ".sql") and (in_dbt or dbtfacts.is_jinja(text)), dbtfacts.model_facts),
    Extractor("dbt_sources", lambda path, text, in_dbt: in_dbt and _suffix(path, ".yml", ".yaml") and path.rpartition("/")[2] not in dbtfacts.SKIPPED_YAML, dbtfacts.source_yaml_facts),
    Extractor("dbt_manifest", lambda path, text, in_dbt: path == MANIFEST or path.endswith("/" + MANIFEST), dbtfacts.manifest_facts),
]


def register_extractor(extractor: Extractor) -> None:
    """Adds an extractor after the others; one of the same name is replaced."""
    EXTRACTORS[:] = [e for e in EXTRACTORS if e.name != extractor.name] + [extractor]


def facts_of(path: str, text: str, in_dbt: bool, extractors: list[Extractor] | None = None) -> list[dict]:
    """The facts of one file by all extractors that claim it; one that fails gives a warning and the others go on."""
    out: list[dict] = []
    for e in EXTRACTORS if extractors is None else extractors:
        try:
            if e.claims(path, text, in_dbt):
                out += e.facts(path, text)
        except Exception as error:  # noqa: BLE001
            out.append({"kind": "warning", "parser": e.name, "message": f"Warning: {e.name} failed on {path}: {type(error).__name__}"})
    return out


def dbt_projects(files: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and ``project`` of every folder that holds a dbt project file."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.filter(name.isin("dbt_project.yml", "dbt_project.yaml")).select(*keys, F.regexp_replace("path", r"/?[^/]*$", "").alias("project")).distinct()


def extract_facts(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per fact: the key columns, file, extractor, and the node, edge or warning.

    ``files`` needs path and content, and has ``keys`` such as the repository. The nearest folder above a file that holds
    a dbt project is found by an equi-join of its ancestors. Each file is parsed once; null contents give nothing.
    """
    keys = list(keys)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    numbered = files.select(*keys, "path", "content").filter("path is not null and content is not null")
    inside = numbered.select(*keys, "path", F.explode(above).alias("project")).join(dbt_projects(files, keys), [*keys, "project"], "left_semi")
    inside = inside.select(*keys, "path").distinct().withColumn("in_dbt", F.lit(True))
    ready = numbered.join(inside, [*keys, "path"], "left").select(*keys, "path", "content", F.coalesce("in_dbt", F.lit(False)).alias("in_dbt"))
    n = len(keys)
    schema = "".join(f"`{k}` {files.schema[k].dataType.simpleString()}, " for k in keys) + FACT_SCHEMA
    types = [
        ("file", pa.string()), ("parser", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("id", pa.string()), ("name", pa.string()), ("type", pa.string()),
        ("line_number", pa.int32()), ("source", pa.string()), ("target", pa.string()), ("confidence", pa.int8()), ("evidence", pa.string()),
        ("metadata", pa.map_(pa.string(), pa.string())), ("message", pa.string()),
    ]

    extractors = list(EXTRACTORS)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            index: list[int] = []
            for i, (path, text, in_dbt) in enumerate(zip(*(batch.column(n + k).to_pylist() for k in range(3)))):
                for seq, fact in enumerate(facts_of(path, text, in_dbt, extractors)):
                    rows.append(fact | {"file": path, "seq": seq, "line_number": fact.get("line")})
                    index.append(i)
            own = [c.take(pa.array(index, pa.int64())) for c in batch.columns[:n]]
            arrays = [pa.array([list(r[c].items()) if c == "metadata" and r.get(c) is not None else r.get(c) for r in rows], t) for c, t in types]
            yield pa.RecordBatch.from_arrays([*own, *arrays], names=[*keys, *(c for c, _ in types)])

    return ready.mapInArrow(extract, schema)


def fact_nodes(facts: DataFrame) -> DataFrame:
    """Node rows as the merge takes them. References of dbt models to others have no file of their own."""
    own = ~((F.col("parser") == "dbt") & F.col("line_number").isNull()) & ~F.coalesce(F.col("metadata")["imported"] == "true", F.lit(False))
    return facts.filter("kind = 'node'").select("id", "name", "type", F.when(own, F.col("file")).alias("file_path"), "line_number", "metadata")


def fact_edges(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'edge'").select("source", "target", "type", "confidence", F.array("evidence").alias("evidence"), "metadata")
