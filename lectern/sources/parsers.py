"""Parsers of files outside the engine: a program that writes JSON, a store of its output, and a stub for tests.

Parsing is two steps, so that output can be kept: ``run`` makes the raw output of one file, ``read_pages`` or
``read_trees`` (``lectern.operators.ingest``) turns raw outputs into blocks.
"""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.files import Folder


class ParserFailed(RuntimeError):
    """The program failed; the message says how."""


def run_to_json(command: Sequence[str], content: bytes, seconds: float, environment: Mapping[str, str] | None = None) -> bytes:
    """Run ``command`` with ``content`` as its input and give what it writes; nothing is put on the machine's disk.

    The message of a failure has the last five lines of what the program said.
    """
    try:
        done = subprocess.run(list(command), input=content, capture_output=True, timeout=seconds, env=os.environ | dict(environment or {}))
    except subprocess.TimeoutExpired:
        raise ParserFailed(f"{command[0]} took more than {seconds:g} seconds") from None
    except OSError as e:
        raise ParserFailed(f"{command[0]} cannot be run: {e.strerror}") from None
    if done.returncode:
        said = done.stderr.decode(errors="replace").strip().splitlines()
        raise ParserFailed(f"{command[0]} ended with {done.returncode}: " + "\n".join(said[-5:]))
    if not done.stdout.strip():
        raise ParserFailed(f"{command[0]} wrote no result")
    return done.stdout


class ProgramParser:
    """A parser that is a program; ``version`` must change whenever its output can."""

    def __init__(self, name: str, version: str, command: Sequence[str], seconds: float = 3600, environment: Mapping[str, str] | None = None):
        self.name, self.version, self.command, self.seconds, self.environment = name, version, list(command), seconds, environment

    def run(self, content: bytes) -> bytes:
        return run_to_json(self.command, content, self.seconds, self.environment)


class StubParser:
    """One page with one text block, whatever the file."""

    name, version = "stub", "0"

    def run(self, content: bytes) -> bytes:
        return b'{"pages": [{"page_index": 0, "parsing_res_list": [{"block_label": "text", "block_content": "Stub paragraph.", "block_bbox": [0, 0, 1, 1]}]}]}'


def parse_files(files: DataFrame, parser_of: Callable) -> DataFrame:
    """(sha256, parser, parser_version, raw, error) of files (sha256, content); ``parser_of()`` makes a parser, once per task.
    A file that fails has an error and stops no other."""

    def run(batches):
        parser = parser_of()
        for pdf in batches:
            rows = []
            for sha, content in zip(pdf["sha256"], pdf["content"]):
                try:
                    rows.append((sha, parser.name, parser.version, parser.run(bytes(content)).decode(), None))
                except (ParserFailed, UnicodeDecodeError) as e:
                    rows.append((sha, parser.name, parser.version, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["sha256", "parser", "parser_version", "raw", "error"])

    return files.select("sha256", "content").mapInPandas(run, "sha256 string, parser string, parser_version string, raw string, error string")


def store_output(parsed: DataFrame, readable: DataFrame, root: str) -> None:
    """Keep raw outputs under ``root``, in a folder per parser and version. Only outputs that could be read are kept
    (``readable`` has their sha256), each hash once; a new part appears in whole or not at all."""
    folder = Folder(parsed.sparkSession, root)
    good = parsed.where("error IS NULL").join(readable.select("sha256").distinct(), "sha256", "left_semi").dropDuplicates(["sha256", "parser", "parser_version"])
    stage = f"incoming/{uuid.uuid4().hex}"
    good.select("sha256", "raw", "parser", "parser_version").write.partitionBy("parser", "parser_version").parquet(folder.at(stage))
    for parser in folder.names(stage):
        for version in folder.names(f"{stage}/{parser}"):
            for k, part in enumerate(folder.names(f"{stage}/{parser}/{version}")):
                folder.move(f"{stage}/{parser}/{version}/{part}", f"output/{parser}/{version}/{uuid.uuid4().hex}-{k}.parquet")
    folder.remove(stage)


def stored_output(spark, root: str) -> DataFrame:
    """(sha256, raw, parser, parser_version) of all that is kept."""
    schema = "sha256 string, raw string, parser string, parser_version string"
    folder = Folder(spark, root)
    return spark.read.schema(schema).parquet(folder.at("output")) if folder.exists("output") else spark.createDataFrame([], schema)


def host_and_port(address: str, port: int) -> tuple[str, int]:
    """Host and port of an address; ``port`` where it names none."""
    parts = urlsplit(address if "//" in address else f"//{address}")
    if not parts.hostname:
        raise ValueError(f"no host in {address!r}")
    return parts.hostname, parts.port or port


def failed_formulas(formulas: DataFrame, check_of: Callable) -> DataFrame:
    """(key columns, tex, error) of formulas (…, tex) that a checker rejects; ``check_of()`` makes one, once per task: a
    function from tex to a message or none."""
    columns = formulas.columns

    def run(batches):
        check = check_of()
        for pdf in batches:
            pdf = pdf.assign(error=[check(t) for t in pdf["tex"]])
            yield pdf[pdf["error"].notna()]

    return formulas.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formulas.schema) + ", error string").select(*columns, F.col("error"))
