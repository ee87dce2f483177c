"""The inference step: a pluggable provider called from partitions, with rates, retries and batches."""

from __future__ import annotations

import hashlib
import itertools
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A provider takes a prompt and returns an answer, or raises; RateLimited asks for a pause.
Provider = Callable[[str], str]


class RateLimited(Exception):
    pass


@dataclass
class TokenBucket:
    """Requests and tokens per minute, refilled continuously; starts full."""

    requests_per_minute: float
    tokens_per_minute: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _state: list[float] = field(default_factory=list)

    def take(self, tokens: float) -> None:
        if not self._state:
            self._state = [self.requests_per_minute, self.tokens_per_minute, self.clock()]
        tokens = min(tokens, self.tokens_per_minute)
        while True:
            requests, held, before = self._state
            now = self.clock()
            part = (now - before) / 60
            requests = min(self.requests_per_minute, requests + self.requests_per_minute * part)
            held = min(self.tokens_per_minute, held + self.tokens_per_minute * part)
            if requests >= 1 and held >= tokens:
                self._state = [requests - 1, held - tokens, now]
                return
            self._state = [requests, held, now]
            self.sleep(max(0.001, 60 * max((1 - requests) / self.requests_per_minute, (tokens - held) / self.tokens_per_minute)))


@dataclass(frozen=True)
class Calls:
    requests_per_minute: float = 480
    tokens_per_minute: float = 80_000
    attempts: int = 5
    pause: float = 15.0
    partitions: int = 8


def ask(prompt: str | None, provider: Provider, bucket: TokenBucket, calls: Calls, sleep=time.sleep) -> tuple[str | None, list[str], int]:
    """(answer or nothing, the errors on the way, the number of attempts). A null prompt fails without an attempt."""
    errors: list[str] = []
    if prompt is None:
        return None, ["no prompt"], 0
    for attempt in range(1, calls.attempts + 1):
        bucket.take(len(prompt.split()) * 4 / 3)
        try:
            return provider(prompt), errors, attempt
        except RateLimited as e:
            errors.append(f"rate limit: {e}")
            sleep(calls.pause)
        except Exception as e:  # noqa: BLE001  a provider's failure is a result here
            errors.append(str(e) or type(e).__name__)
    return None, errors, calls.attempts


def infer(prompts: DataFrame, provider: Provider, calls: Calls | None = None, key: str = "uid", prompt: str = "prompt") -> DataFrame:
    """key, response, errors, attempts, status. Each task has its share of the global rates; writes are keyed, so that a task
    that is run again is harmless."""
    calls = calls or Calls()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(calls.requests_per_minute / calls.partitions, calls.tokens_per_minute / calls.partitions)
        for f in frames:
            told = [ask(p, provider, bucket, calls) for p in f[prompt]]
            yield pd.DataFrame({key: f[key], "response": [t[0] for t in told], "errors": [t[1] for t in told], "attempts": [t[2] for t in told], "status": ["ok" if t[0] is not None else "failed" for t in told]})

    schema = f"{key} {prompts.schema[key].dataType.simpleString()}, response string, errors array<string>, attempts int, status string"
    return prompts.select(key, prompt).repartition(calls.partitions).mapInPandas(run, schema)


def request_parameters(model: str, temperature: float, top_p: float, max_tokens: int) -> dict:
    """Reasoning models take another limit and no sampling parameters."""
    if model.startswith("o1"):
        return {"model": model, "max_completion_tokens": max_tokens, "temperature": 1, "top_p": 1}
    return {"model": model, "max_tokens": max_tokens, "temperature": temperature, "top_p": top_p}


def stub_provider(prompt: str) -> str:
    """A deterministic answer for tests: whether the prompt has an even number of characters."""
    return json.dumps({"entailment_prediction": 1 - len(prompt) % 2})


BLOCKED, FAILED = "SAFETY_HAZARD", "GENERATION_FAILED"


def join_chunks(events: DataFrame, key: str, order: str, text: str, blocked: str) -> DataFrame:
    """Answers that came as a stream: key, response, status.

    `events` has a row for each chunk: its place (`order`), its text, and whether the provider held it back (`blocked`), in which
    case the fixed literal stands in its place. A chunk without text that isn't blocked adds nothing; an answer without any chunk
    that counts is a failed one. Status is ok, blocked or failed. An answer is one row's work, as its provider bounds its length. Chunks without a key
    belong to no answer and are left out.
    """
    chunk = F.when(F.coalesce(F.col(blocked), F.lit(False)), F.lit(BLOCKED)).otherwise(F.col(text))
    told = events.where(F.col(key).isNotNull()).select(key, F.struct(F.col(order), chunk.alias("chunk")).alias("c"), chunk.isNotNull().alias("counts"), F.coalesce(F.col(blocked), F.lit(False)).alias("held"))
    whole = told.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("counts"), F.col("c")))).alias("cs"), F.max("held").alias("held"))
    joined = F.array_join(F.transform("cs", lambda c: c["chunk"]), "")
    none = F.size("cs") == 0
    return whole.select(key, F.when(none, FAILED).otherwise(joined).alias("response"), F.when(none, "failed").when(F.col("held"), "blocked").otherwise("ok").alias("status"))


@dataclass(frozen=True)
class BatchService:
    """A provider of batch jobs. submit(request id, [(key, prompt)]) -> job; state(job) -> running, done or failed;
    fetch(job) -> [(key, answer)]. A request id that comes again, from a task that ran twice, must not open a second job."""

    submit: Callable[[str, list[tuple]], str]
    state: Callable[[str], str]
    fetch: Callable[[str], list[tuple]]


def submit_batches(prompts: DataFrame, service: BatchService, path: str, key: str = "uid", prompt: str = "prompt", size: int = 1000) -> None:
    """Open a job for every `size` prompts of a partition, and append the table of jobs (job, request, n) to `path`."""

    def opened(rows: list[tuple]) -> dict:
        request = hashlib.md5("\n".join(str(k) for k, _ in rows).encode()).hexdigest()
        return {"job": [service.submit(request, rows)], "request": [request], "n": [len(rows)]}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for f in frames:
            held += zip(f[key], f[prompt])
            while len(held) >= size:
                yield pd.DataFrame(opened(held[:size]))
                held = held[size:]
        if held:
            yield pd.DataFrame(opened(held))

    prompts.select(key, prompt).mapInPandas(run, "job string, request string, n int").write.mode("append").parquet(path)


def collect_batches(jobs: DataFrame, service: BatchService, key_type: str = "string", polls: int = 2, pause: float = 30.0, sleep=time.sleep) -> DataFrame:
    """Wait for jobs and read their answers: job, key, response, status (ok, failed, or running after the last poll).

    Each task asks for all of its jobs, `polls` times at most, `pause` seconds apart. Jobs without answers have one row without a
    key; those that still run can be collected again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = [j for f in frames for j in f["job"]]
        for turn in range(polls):
            if turn and left:
                sleep(pause)
            waiting = []
            for j in left:
                state = service.state(j)
                if state == "done":
                    answers = service.fetch(j)
                    yield pd.DataFrame({"job": j, "key": [k for k, _ in answers], "response": [a for _, a in answers], "status": "ok"})
                elif state == "failed":
                    yield pd.DataFrame({"job": [j], "key": [None], "response": [None], "status": ["failed"]})
                else:
                    waiting.append(j)
            left = waiting
        if left:
            yield pd.DataFrame({"job": left, "key": None, "response": None, "status": "running"})

    return jobs.select("job").mapInPandas(run, f"job string, key {key_type}, response string, status string")


def stub_service() -> BatchService:
    """Jobs for tests, done at once: a job's name holds its answers, so that no service has to remember it."""
    answered = lambda request, rows: json.dumps([[int(k), stub_provider(p)] for k, p in rows])
    return BatchService(answered, lambda job: "done", lambda job: [tuple(a) for a in json.loads(job)])


def run_grid(spark: SparkSession, axes: dict[str, list[str]], step: Callable[[dict[str, str]], DataFrame], path: str) -> DataFrame:
    """Run `step` for each combination of the axes' values (models, data sets, prompts) and read all results with the axes as columns.

    A combination that has been written is skipped, so a broken loop can be run again.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for values in itertools.product(*axes.values()):
        config = dict(zip(axes, values))
        folder = "/".join([path, *(f"{k}={v}" for k, v in config.items())])
        done = fs_path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            step(config).write.mode("overwrite").parquet(folder)
    return spark.read.option("basePath", path).parquet(path)
