"""Text providers: what stands where a language model would, with a cache keyed by the prompt."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Answer = Callable[[str], str]


@dataclass
class StaticProvider:
    """The same answers in turn by the prompt's hash; ``response`` and ``responses`` both work."""

    responses: Sequence[str] = ()
    response: str | None = None

    def __call__(self, prompt: str) -> str:
        known = list(self.responses) or ([self.response] if self.response is not None else [])
        if not known:
            raise ValueError("no response is configured")
        return known[int(hashlib.md5(prompt.encode()).hexdigest(), 16) % len(known)]


@dataclass
class ReplayProvider:
    """Recorded answers by the md5 of the prompt; a miss is an error."""

    recorded: dict[str, str] = field(default_factory=dict)

    def __call__(self, prompt: str) -> str:
        return self.recorded[hashlib.md5(prompt.encode()).hexdigest()]


@dataclass
class Retry:
    """Calls again after errors, with doubling pauses and jitter."""

    inner: Answer
    tries: int = 10
    pause: float = 0.1

    def __call__(self, prompt: str) -> str:
        for n in range(self.tries):
            try:
                return self.inner(prompt)
            except Exception:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**n * (1 + random.random()))
        raise AssertionError


@dataclass
class Valid:
    """Asks again, at most ``tries`` times, until ``accept`` holds; the last answer stands."""

    inner: Answer
    accept: Callable[[str], bool]
    tries: int = 3

    def __call__(self, prompt: str) -> str:
        for n in range(self.tries):
            answer = self.inner(prompt if not n else f"{prompt}\n\n{n}")
            if self.accept(answer):
                break
        return answer


def cache_key(name: str, operation: str, prompt: Column, parameters: str = "") -> Column:
    return F.concat(F.lit(f"{name}-{operation}-v2-"), F.md5(F.concat(prompt, F.lit(parameters))))


def ask(prompts: DataFrame, prompt: str, provider: Answer, cache: DataFrame | None = None, name: str = "text", operation: str = "chat") -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows): distinct prompts that the cache lacks are asked once each.

    ``answers`` is ``prompts`` with ``key`` and ``answer``; ``cache`` is (key, answer).
    """
    keyed = prompts.withColumn("key", cache_key(name, operation, F.col(prompt)))
    wanted = keyed.select("key", F.col(prompt).alias("_p")).where("_p is not null").distinct()
    known = cache if cache is not None else prompts.sparkSession.createDataFrame([], "key string, answer string")
    misses = wanted.join(known.select("key"), "key", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "answer": [provider(p) for p in pdf["_p"]]})

    from quillgraph.functions.session import cut

    fresh = cut(misses.mapInPandas(call, "key string, answer string"))
    both = known.select("key", "answer").unionByName(fresh.where("answer <> ''"))
    return keyed.join(both, "key", "left"), fresh


def hash_embedding(text: Column, dimensions: int = 16) -> Column:
    """A deterministic unit-free embedding of a text: hashed values in [-1, 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (F.pmod(F.xxhash64(text, i), F.lit(1 << 20)) / (1 << 19) - 1).cast("double"))


def mock_translation(text: Column) -> Column:
    return F.concat(text, F.lit(" translated"))


@dataclass
class Paced:
    """Calls at most so often a minute in each worker, and as many tokens; ``share`` workers run at once."""

    inner: Answer
    calls_per_minute: float = math.inf
    tokens_per_minute: float = math.inf
    share: int = 1
    free_at: float = 0.0

    def __call__(self, prompt: str) -> str:
        now = time.monotonic()
        if now < self.free_at:
            time.sleep(self.free_at - now)
        answer = self.inner(prompt)
        tokens = len(prompt.split()) + len(answer.split())
        self.free_at = max(now, self.free_at) + 60.0 * self.share * max(1 / self.calls_per_minute, tokens / self.tokens_per_minute)
        return answer


@dataclass
class MentionProvider:
    """A rule instead of a model: records of the capitalised words of a prompt, in the extractor's language."""

    claims: bool = False

    def __call__(self, prompt: str) -> str:
        names = sorted(set(re.findall(r"\b[A-Z][a-z]+", prompt, re.A)))
        if self.claims:
            records = [f"({n}<|>NONE<|>MENTION<|>TRUE<|><|><|>{n} is mentioned<|>{n})" for n in names]
        else:
            records = [f'("entity"<|>{n}<|>WORD<|>{n} is mentioned)' for n in names]
            records += [f'("relationship"<|>{a}<|>{b}<|>{a} stands before {b}<|>2)' for a, b in zip(names, names[1:])]
        return "##".join(records) + "<|COMPLETE|>"


def read_cache(spark, folder: str) -> DataFrame:
    """(key, answer) kept in a folder; none yet is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "key string, answer string")
    return spark.read.schema("key string, answer string").parquet(folder).groupBy("key").agg(F.max("answer").alias("answer"))


def write_cache(fresh: DataFrame, folder: str) -> None:
    """Add new answers to a folder; empty answers are asked again next time."""
    fresh.where("answer is not null and answer <> ''").select("key", "answer").write.mode("append").parquet(folder)
