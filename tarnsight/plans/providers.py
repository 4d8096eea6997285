"""Providers: where scores and transcripts come from that a model must give. Each is a function from a sample table to (sample_id, ...).

Models run outside: in a child process that reads and writes JSON lines, behind a server, or as a Python function over batches or rows.
Every sample must get exactly one answer; a batch that comes back shorter or longer raises.
"""

from __future__ import annotations

import json
import subprocess
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship


def _checked(asked: list[dict], got: list, what: str) -> list:
    if len(got) != len(asked):
        raise ValueError(f"{what} gave {len(got)} answers for {len(asked)} samples")
    return got


def _mapped(answer: Callable[[list[dict]], list[dict]], columns: list[str], schema: str, key: str, batch: int):
    names = [c.split()[0] for c in schema.split(", ")]

    def provider(samples: DataFrame) -> DataFrame:
        ship(samples.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = json.loads(f[[key, *columns]].to_json(orient="records"))
                for i in range(0, len(rows), batch):
                    part = rows[i : i + batch]
                    yield pd.DataFrame([{key: a[key], **{k: v for k, v in b.items() if k != key}} for a, b in zip(part, answer(part))], columns=names)

        return samples.select(key, *columns).mapInPandas(run, schema)

    return provider


def subprocess_provider(command: list[str], columns: list[str], schema: str, key: str = "sample_id", batch: int = 128, timeout: float = 600):
    """A provider that sends batches to a child process: a JSON line for each sample in, one for each out, in order."""

    def answer(rows: list[dict]) -> list[dict]:
        done = subprocess.run(command, input="".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), capture_output=True, text=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-500:]}")
        return _checked(rows, [json.loads(x) for x in done.stdout.splitlines() if x.strip()], command[0])

    return _mapped(answer, columns, schema, key, batch)


def server_provider(url: str, columns: list[str], schema: str, key: str = "sample_id", batch: int = 32, timeout: float = 60, tries: int = 3):
    """A provider that posts {"samples": [...]} to a model server and reads {"results": [...]}; a failed call is repeated."""

    def answer(rows: list[dict]) -> list[dict]:
        body = json.dumps({"samples": rows}).encode()
        for i in range(tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as got:
                    return _checked(rows, json.load(got)["results"], url)
            except OSError:
                if i + 1 == tries:
                    raise
        raise AssertionError

    return _mapped(answer, columns, schema, key, batch)


def function_provider(columns: list[str], schema: str, whole: Callable[[list[dict]], list[dict]] | None = None, each: Callable[[dict], dict] | None = None, key: str = "sample_id", batch: int = 128):
    """A provider by a Python function over batches where there is one, else over single samples."""
    if whole is None and each is None:
        raise ValueError("a function over batches or over samples is needed")
    return _mapped((lambda rows: _checked(rows, whole(rows), "the provider")) if whole else (lambda rows: [each(r) for r in rows]), columns, schema, key, batch)
