"""Model seams: external models (recognition, language, embedding) as functions over Arrow batches, with deterministic stand-ins.

A model is a function from an iterator of pandas batches to an iterator of pandas batches; it is loaded once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written

Model = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def infer(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    return rows.mapInPandas(model, schema)


def cached(prompts: DataFrame, cache: DataFrame, model: Model, schema: str, key: str = "prompt") -> DataFrame:
    """Answers of a cache table by the hash of the prompt, and the model's for the distinct prompts that are not in it."""
    p = prompts.select(key).distinct().withColumn("hash", F.md5(key))
    hit = p.join(cache, "hash").select("hash", "answer", F.lit(True).alias("cached"))
    miss = infer(p.join(cache.select("hash"), "hash", "left_anti").select("hash", key), model, schema).select("hash", "answer", F.lit(False).alias("cached"))
    return hit.unionByName(miss)


Answer = Callable[[pd.DataFrame, int], pd.DataFrame]


def infer_with_retries(rows: DataFrame, key: str, model: Answer, schema: str, retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(answers, dead letters) of a model that may fail.

    `model` takes a batch of rows and the number of the attempt (from 0) and gives, for each row, its columns of `schema` and `error` (null: none); what it raises is the error of
    every row of the batch. Each attempt's results are written, and only rows that failed are asked again, at most `retries` times. Answers have key, the columns of
    `schema` and attempts (1: at once); dead letters have key, attempts and the last error. Rows that share a key are each asked.
    """
    names = [f.split()[0] for f in schema.split(",")]
    kind = rows.schema[key].dataType.simpleString()
    done, left = None, rows
    for attempt in range(retries + 1):

        def ask(batches: Iterator[pd.DataFrame], attempt: int = attempt) -> Iterator[pd.DataFrame]:
            for b in batches:
                try:
                    out = model(b, attempt)[[*names, "error"]]
                except Exception as e:  # an error of the model is a result here
                    out = pd.DataFrame({**dict.fromkeys(names), "error": str(e) or type(e).__name__}, index=b.index)
                yield pd.concat([b.reset_index(drop=True).rename(columns=lambda c: c if c == key else f"asked_{c}"), out.reset_index(drop=True)], axis=1)

        asked = [f for f in rows.schema.fields if f.name != key]
        columns = ", ".join([f"{key} {kind}", *[f"asked_{f.name} {f.dataType.simpleString()}" for f in asked], schema, "error string"])
        got = written(infer(left.select(key, *[f.name for f in asked]), ask, columns), "attempt")
        good = got.where("error is null").select(key, *names, F.lit(attempt + 1).alias("attempts"))
        done = good if done is None else done.unionByName(good)
        failed = got.where("error is not null")
        if attempt == retries or failed.isEmpty():
            break
        left = failed.select(key, *[F.col(f"asked_{f.name}").alias(f.name) for f in asked])
    return done, failed.select(key, F.lit(attempt + 1).alias("attempts"), F.concat(F.lit(f"Failed after {retries} retries: "), "error").alias("error"))


def unsteady_model(rows: pd.DataFrame, attempt: int) -> pd.DataFrame:
    """Stand-in for a model that fails by a hash of the prompt and the attempt: two times in five it is busy, one in five the prompt is too long."""
    digit = pd.Series([int(hashlib.md5(f"{p}:{attempt}".encode()).hexdigest()[:4], 16) % 5 for p in rows["prompt"]], index=rows.index)
    error = digit.map({0: "busy", 1: "busy", 2: "too long"})
    return pd.DataFrame({"answer": ("Re: " + rows["prompt"]).where(error.isna()), "error": error})


def echo_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for a language model: the first words of the prompt."""
    for b in batches:
        yield pd.DataFrame({"hash": b["hash"], "answer": b["prompt"].fillna("").str.split().str[:5].str.join(" ")})


def gram_embedding(texts: pd.Series, size: int = 64) -> list[list[float]]:
    """Stand-in for an embedding model: hashed character 2- to 4-grams, of unit length (zero for an empty text)."""
    out = []
    for t in texts.fillna(""):
        v = np.zeros(size)
        for n in (2, 3, 4):
            for i in range(len(t) - n + 1):
                v[int.from_bytes(hashlib.blake2b(t[i : i + n].encode(), digest_size=4).digest(), "big") % size] += 1
        norm = np.linalg.norm(v)
        out.append((v / norm if norm else v).tolist())
    return out


def embed(rows: DataFrame, key: str, text: str, chars: int = 2000, size: int = 64) -> DataFrame:
    """(key, embedding) of the part of each text that is embedded."""

    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": gram_embedding(b["t"], size)})

    return infer(rows.select(F.col(key).cast("long").alias(key), F.substring(text, 1, chars).alias("t")), model, f"{key} long, embedding array<double>")
