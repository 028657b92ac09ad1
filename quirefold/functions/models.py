"""Model operators: any provider of generated texts and embeddings, called once for each row, with retries, in batches."""

from __future__ import annotations

import asyncio
import hashlib
import json
import re
import threading
import time
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from functools import lru_cache
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.text import END, NONE
from quirefold.scratch import Scratch


class Busy(Exception):
    """The service asks to be called again later."""


class Blocked(Exception):
    """The model declined to recite; another one may answer."""


class Provider(Protocol):
    def generate(self, prompt: str, attachment: bytes | None = None) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:15], 16)


class Offline:
    """A provider without a network that always gives the same: embeddings are hashed bags of words, texts follow rules that keep
    what the parsers rely on."""

    #: It waits for nothing: a call is work of its task.
    waits = False

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            hashes = [_word_hash(word) for word in re.findall(r"\w+", text.lower())]
            v = np.zeros(self.dim)
            for h, n in Counter(hashes).items():
                v[h % self.dim] += n if h >> 59 else -n
            n = float(np.sqrt(v @ v))
            out.append((v / n if n else v).tolist())
        return out

    @staticmethod
    def read(attachment: bytes) -> str:
        """The text of a PDF page; other bytes as they are."""
        from quirefold.sources.pdf import Broken, Document

        if b"%PDF-" in attachment[:1024]:
            try:
                doc = Document(attachment)
                return "\n".join(doc.text(page) for page in doc.pages())
            except Broken:
                return ""
        return attachment.decode("utf-8", "replace")

    def generate(self, prompt: str, attachment: bytes | None = None) -> str:
        task, _, body = prompt.partition("\n\n")
        if "markdown fence" in task and "Set the headings" in task:
            return f"{body.strip()}\n{END}" if "```" in body else f"```markdown\n{body.strip()}\n{END}\n```"  # an inner fence would end the block
        if "markdown fence" in task:
            return f"```markdown\n{self.read(attachment or b'').strip()}\n```"
        if "Write a line Tool" in task:
            tools, _, rest = body.partition("\nQuestion: ")
            asked, _, seen = rest.partition("\nSeen:\n")
            names = [line.split(" : ")[0] for line in tools.splitlines() if " : " in line]
            if seen.strip():
                return f"Answer: {' '.join(re.findall(r'\w+', seen)[:40])}"
            wanted = [n for n in names if n.startswith("summary") == ("summar" in asked.lower())]
            return f"Tool: {(wanted or names)[0]}\nInput: {asked.strip()}"
        if "one question for each" in task:
            asked, _, tools = body.partition("\nDocuments:\n")
            return "\n".join(f"{name} : {asked.strip()}" for name in tools.splitlines() if name.strip())
        if "JSON object" in task:
            words = re.findall(r"\w+", body)
            found = {"author": "", "publication_date": "", "language": "en", "document_type": "text", "themes": [], "entities": [], "time_periods": [], "keywords": sorted(set(words))[:5], "summary": " ".join(words[:12])}
            return f"```json\n{json.dumps(found)}\n```"
        if "Copy the table" in task:
            heads = [line for line in body.splitlines() if line.startswith("#")]
            return "\n".join(heads) or NONE
        if "Give each page" in task:
            pages = re.split(r"--- end page \d+", body)
            numbers = re.findall(r"--- end page (\d+)", body)
            return "\n".join(f"Page {n} : {(p.strip().splitlines() or ['Untitled'])[0][:60]}" for n, p in zip(numbers, pages))
        if "table of contents as" in task or "Correct this" in task:
            return body if "Correct this" in task else "# Contents (Page 1)"
        if "Put the pages" in task:
            return "\n".join(["# Contents", *(f"- {line}" for line in body.splitlines() if re.match(r"Page \d+ : ", line))])
        return " ".join(m[0] for m in islice(re.finditer(r"\w+", body), 40))


def call(provider: Provider, prompt: str, attachment: bytes | None, attempts: int, wait: float, fallback: Provider | None, other: bytes | None = None) -> str:
    """other: what the fallback gets instead of the attachment, such as an image of it."""
    for k in range(attempts):
        try:
            return provider.generate(prompt, attachment)
        except Blocked:
            if fallback is None:
                raise
            return fallback.generate(prompt, attachment if other is None else other)
        except Busy:
            if k + 1 == attempts:
                raise
            time.sleep(wait)
    raise AssertionError


#: Calls that a task has open at once, where the stage may have more.
WINDOW = 4


def window_of(provider: Provider) -> int:
    """Calls that a task has open at once: one where calls are work of the task itself (waits is False), which more threads don't shorten; as
    many more tasks then share what may be open."""
    return WINDOW if getattr(provider, "waits", True) else 1


def dealt(df: DataFrame, workers: int, window: int = WINDOW, spread: bool = True) -> tuple[DataFrame, int]:
    """df dealt to as many tasks as may run at once, and the calls that each may have open: tasks x calls is no more than `workers`, so the
    whole stage has no more open, whatever the cluster. spread: rows are shuffled for it; without, tasks take whole parts of a stored table as
    they lie (one that no call makes, or its calls would be open in the same stage). Needs spark.speculation off, as session() has it."""
    if workers < 1:
        raise ValueError("workers must be positive")
    window = min(window, workers)
    return df.repartition(workers // window) if spread else df.coalesce(workers // window), window


class _Calls:
    """Calls of one task: up to `window` open at once, those of the next batch too while the last ones of this one are awaited. A provider
    with a coroutine `agenerate` is awaited on one loop, any other is called by threads, or where it is asked if the window is one."""

    def __init__(self, provider: Provider, window: int):
        self.awaited = hasattr(provider, "agenerate")
        if self.awaited:
            self.loop = asyncio.new_event_loop()
            self.slots = asyncio.Semaphore(window)
            threading.Thread(target=self.loop.run_forever, daemon=True).start()
        else:
            self.pool = ThreadPoolExecutor(window) if window > 1 else None

    def submit(self, one, aone, *row) -> Future:
        if not self.awaited and self.pool is None:
            done = Future()
            done.set_result(one(*row))
            return done
        if not self.awaited:
            return self.pool.submit(one, *row)

        async def slot():
            async with self.slots:
                return await aone(*row)

        return asyncio.run_coroutine_threadsafe(slot(), self.loop)

    def close(self) -> None:
        if self.awaited:
            self.loop.call_soon_threadsafe(self.loop.stop)
        elif self.pool is not None:
            self.pool.shutdown(wait=True, cancel_futures=True)


async def acall(provider: Provider, prompt: str, attachment: bytes | None, attempts: int, wait: float, fallback: Provider | None, other: bytes | None = None) -> str:
    """call() for providers with a coroutine; a fallback without one is called in a thread."""
    for k in range(attempts):
        try:
            return await provider.agenerate(prompt, attachment)
        except Blocked:
            if fallback is None:
                raise
            given = attachment if other is None else other
            return await fallback.agenerate(prompt, given) if hasattr(fallback, "agenerate") else await asyncio.to_thread(fallback.generate, prompt, given)
        except Busy:
            if k + 1 == attempts:
                raise
            await asyncio.sleep(wait)
    raise AssertionError


def _asking(provider: Provider, attempts: int, wait: float, fallback: Provider | None, strict: bool):
    """What a call gives, as (answer, error): plainly, and awaited."""

    def told(error: Exception) -> tuple[None, str]:
        if strict:
            raise error
        return None, f"{type(error).__name__}: {error}"

    def one(p, a, other):
        try:
            return (None, None) if p is None or p != p else (call(provider, p, a, attempts, wait, fallback, other), None)
        except Exception as error:
            return told(error)

    async def aone(p, a, other):
        try:
            return (None, None) if p is None or p != p else (await acall(provider, p, a, attempts, wait, fallback, other), None)
        except Exception as error:
            return told(error)

    return one, aone


def generated(df: DataFrame, prompt: str | Column, into: str, provider: Provider, attachment: str | None = None, attempts: int = 10, wait: float = 5.0, fallback: Provider | None = None, workers: int = 32, strict: bool = True, image: str | None = None, only: list[str] | None = None, spread: bool = True, window: int = WINDOW) -> DataFrame:
    """df (or its columns `only`) with `into`, the answer to its prompt (a column's name, or an expression), and for strict False `into`_error (null if it went well).

    The whole stage has no more than `workers` calls open (see dealt()): rows are dealt to a few tasks, each with a window of calls that
    keeps the order of its rows. Busy is tried again after a wait, Blocked goes to the fallback, with the column `image` for an
    attachment if there is one. Rows whose prompt is null get null without a call. Write the result before it is used twice: a call
    may cost money. A prompt that is an expression is made where its call is, from what it is made of: it is never shuffled, and its
    text doesn't come back with the answer; nor do columns that `only` leaves out.
    """
    names = df.columns if only is None else only
    rows, window = dealt(df, workers, window, spread)
    rows = rows.select(*names, *{c for c in (attachment, image) if c and c not in names}, (F.col(prompt) if isinstance(prompt, str) else prompt).alias("__prompt"))
    schema = f"{', '.join(f'`{c}` {df.schema[c].dataType.simpleString()}' for c in names)}, {into} string, {into}_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, aone = _asking(provider, attempts, wait, fallback, strict)

        def answered(batch: pd.DataFrame, asked: list[Future]) -> pd.DataFrame:
            got = [f.result() for f in asked]
            batch = batch[names].copy()
            batch[into], batch[f"{into}_error"] = [g[0] for g in got], [g[1] for g in got]
            return batch

        calls = _Calls(provider, window)
        try:
            before = None
            for batch in batches:
                columns = (batch["__prompt"], *(batch[c] if c else [None] * len(batch) for c in (attachment, image)))
                asked = [calls.submit(one, aone, *row) for row in zip(*columns)]
                if before is not None:
                    yield answered(*before)
                before = (batch, asked)
            if before is not None:
                yield answered(*before)
        finally:
            calls.close()

    out = rows.mapInPandas(run, schema)
    return out.select(*names, into) if strict else out


#: Calls of one row of generated_each().
GROUP = 1024


def generated_each(calls: DataFrame, shared: DataFrame, on: str, field: str, prompt: tuple[str, str], text: str, into: str, provider: Provider, attempts: int = 10, wait: float = 5.0, fallback: Provider | None = None, workers: int = 32) -> DataFrame:
    """calls without `on`, with `into`, the answer to its prompt: prompt[0], its `field`, prompt[1], and the text that `shared` (on, text) has for
    its `on` (nothing where it has none). A null field causes no call; a failing call raises.

    Calls that share a text go together, up to GROUP of them a row, so the text is shuffled once for them all, not once for each of them, and a
    prompt is only put together while it is asked. No more than `workers` calls are open, as in generated()."""
    names = [c for c in calls.columns if c != on]
    counted = calls.groupBy(on).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("__n"))
    dealt_out = calls.join(counted, calls[on].eqNullSafe(counted[on])).drop(counted[on]).withColumn("__k", F.pmod(F.xxhash64(*names), F.col("__n")).cast("int"))
    rows = dealt_out.groupBy(on, "__k").agg(F.collect_list(F.struct(*names)).alias("__calls")).join(shared.select(on, F.col(text).alias("__text")), on, "left")
    rows, window = dealt(rows.select("__calls", F.coalesce("__text", F.lit("")).alias("__text")), workers, window_of(provider))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, aone = _asking(provider, attempts, wait, fallback, True)

        def whole(said: str | None, rest: str) -> str | None:
            return None if said is None else f"{prompt[0]}{said}{prompt[1]}{rest}"

        async def later(said, rest):
            return await aone(whole(said, rest), None, None)

        open_calls = _Calls(provider, window)
        try:
            for batch in batches:
                for r in range(batch.num_rows):
                    members, rest = batch.column(0)[r].values, batch.column(1)[r].as_py()
                    asked = [open_calls.submit(lambda said, rest: one(whole(said, rest), None, None), later, said, rest) for said in members.field(field).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*(members.field(c) for c in names), pa.array([f.result()[0] for f in asked], pa.string())], names=[*names, into])
        finally:
            open_calls.close()

    return rows.mapInArrow(run, f"{', '.join(f'`{c}` {calls.schema[c].dataType.simpleString()}' for c in names)}, {into} string")


def embedded(df: DataFrame, text: str, into: str, provider: Provider, workers: int | None = None) -> DataFrame:
    """df with `into`, the embedding of a text column; a call for each batch. Null texts embed as empty ones. workers: the most calls open
    over the whole stage, one for each task; without it every task calls."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {into} array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[into] = provider.embed([t if isinstance(t, str) else "" for t in batch[text]])
            yield batch

    return (df if workers is None else dealt(df, workers, 1)[0]).mapInPandas(run, schema)


def reformatted(docs: DataFrame, provider: Provider, most: int = 50, text: str = "text") -> DataFrame:
    """docs (with format) with `text` set anew: the model goes on until it writes the end mark; raises after `most` rounds without.

    Each round's answers are written before anything reads them, so no call is paid twice. Documents that say of themselves that they are
    reformatted (is_reformatted) stay as they are."""
    from quirefold.functions import text as T
    from quirefold.sources.prompts import reformat_prompt

    keep = docs.columns
    scratch = Scratch(docs.sparkSession)
    done = docs.where("is_reformatted") if "is_reformatted" in keep else None
    open_ = (docs if done is None else docs.where("not coalesce(is_reformatted, false)")).withColumn("__done", F.lit(""))
    finished = done
    for _ in range(most):
        got = generated(open_, reformat_prompt(F.col(text), F.col("__done"), F.col("format") == "landscape"), "__said", provider).withColumn("__said", T.unwrap_markdown(F.col("__said")))
        got = got.withColumn("__done", F.concat("__done", T.without_end(F.col("__said")))).withColumn("__end", T.is_ended(F.col("__said")))
        got = scratch.write(got.drop("__said"), "rounds")
        closed = got.where("__end").select(*(F.col("__done").alias(c) if c == text else F.col(c) for c in keep))
        finished = closed if finished is None else finished.unionByName(closed)
        open_ = got.where("not __end").select(*keep, "__done")
        if open_.isEmpty():
            return finished
    raise RuntimeError(f"no end after {most} rounds")


def summaries(chunks: DataFrame, provider: Provider, key: str = "doc_id", order: str = "chunk_ord", fan: int = 8, prompt: str | None = None) -> DataFrame:
    """(key, summary) of all chunks of each document: `fan` neighbours at a time, until one text is left. Each level is written before
    the next reads it, so no call is paid twice."""
    from quirefold.sources.prompts import SUMMARY

    ask = SUMMARY if prompt is None else prompt
    scratch = Scratch(chunks.sparkSession)
    level = chunks.select(key, F.col(order).alias("__o"), "text")
    while True:
        level = level.withColumn("__g", F.floor((F.row_number().over(Window.partitionBy(key).orderBy("__o")) - 1) / fan))
        joined = level.groupBy(key, F.col("__g").alias("__o")).agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY __o)").alias("text"))
        said = generated(joined, F.concat(F.lit(ask), "text"), "__s", provider, only=[key, "__o"])
        level = scratch.write(said.select(key, "__o", F.col("__s").alias("text")), "level")
        if (level.agg(F.max("__o")).first()[0] or 0) == 0:
            return level.select(key, F.col("text").alias("summary"))
