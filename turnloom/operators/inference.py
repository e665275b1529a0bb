"""Batch inference: run a user's generator over a table and parse what it returns.

The generator is a factory, called once per task, that returns a function from a
list of prompts to a list of results of the same length:

* ``returns="text"``: one string per prompt, the new text only;
* ``returns="ids"``: one list or NumPy array of new token ids per prompt, or a pair
  ``(prompt_len, ids)`` when the ids still start with the (padded) prompt.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.chat import render_prompt
from turnloom.functions.reasoning import (
    END_OF_REASONING_ID,
    END_OF_REASONING_TEXT,
    split_ids,
    split_text,
    strip_prompt_ids,
)
from turnloom.functions.slices import grouped, id_bytes, sliced, text_bytes
from turnloom.functions.strings import strip_newlines
from turnloom.functions.templates import Template, get_template
from turnloom.operators.first import first_n
from turnloom.operators.position import POSITION, first_with_position, with_position
from turnloom.plans.ordered import with_running_start
from turnloom.plans.scratch import is_written, scratch_path, scratch_table
from turnloom.sources.pieces import ERROR, PIECE, in_pieces, piece_folders, read_pieces, write_pieces

# Executors get this module's functions with their code; they need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GeneratorFactory = Callable[..., Callable[[list[str]], Sequence[Any]]]
DecoderFactory = Callable[[], Callable[[list[list[int]]], Sequence[str]]]

# The settings of a run when nothing else is asked for.
BATCH_SIZE = 4
GENERATION_OPTIONS = {"max_new_tokens": 512, "enable_thinking": True}

_RAW_IDS = [
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("prompt_len", T.IntegerType()),
]


def build_prompts(
    df: DataFrame, key: Sequence[str], text: str = "text", template: str | Template = "chatml"
) -> DataFrame:
    """``key..., input, prompt``: each text as one user turn, ready for an answer."""
    chat_template = get_template(template)
    if chat_template is None:
        raise ValueError("prompts need a chat template")
    if not isinstance(df.schema[text].dataType, T.StringType):
        raise TypeError(f"column {text} must be a string, not {df.schema[text].dataType}")
    return df.select(
        *key,
        F.col(text).alias("input"),
        render_prompt(F.col(text), chat_template).alias("prompt"),
    )


def cut_batches(lengths: Sequence[int], batch_size: int, by_length: bool, max_padded: int | None = None) -> list[list[int]]:
    """The rows of each batch: at most ``batch_size``, and no more than padding to the longest allows.

    Rows come in their order, or by descending length, so that rows of like length share a
    batch and the one that needs most memory comes first. ``max_padded`` bounds a batch's rows times
    its greatest length; a row that is longer than that is a batch of its own.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i]) if by_length else range(len(lengths))
    batches: list[list[int]] = []
    longest = 0
    for i in order:
        longest = max(longest, lengths[i])
        rows = len(batches[-1]) + 1 if batches else batch_size + 1
        if rows > batch_size or (max_padded is not None and rows * longest > max_padded):
            batches.append([])
            longest = lengths[i]
        batches[-1].append(i)
    return batches


def padding_statistics(
    prompts: DataFrame, batch_size: int = BATCH_SIZE, by_length: bool = False, max_padded: int | None = None,
    key: Sequence[str] = (), rows: int | None = None,
) -> DataFrame:
    """One row: prompts, batches, characters, and characters once every batch is padded to its longest prompt.

    It cuts the prompts as ``generate`` does with the same settings, and generates nothing. With ``key`` they
    count as one task would take them in that order, ``rows`` of them (as many as an Arrow batch has) at a time; prompts with equal keys
    go by their length. Only keys and lengths are shuffled then, and each such run of prompts is a group of its own.
    """

    def counted(lengths: list[int]) -> list[int]:
        cut = cut_batches(lengths, batch_size, by_length, max_padded)
        return [len(lengths), len(cut), sum(lengths), sum(len(b) * max(lengths[i] for i in b) for b in cut)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0, 0, 0, 0]
        for batch in batches:
            counts = [a + b for a, b in zip(counts, counted(batch["n"].to_pylist()))]
        yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.int64()) for c, v in zip(names, counts)})

    def run_group(group: pa.Table) -> pa.Table:
        group = group.sort_by("start")
        lengths = [n for n, times in zip(group["n"].to_pylist(), group["times"].to_pylist()) for _ in range(times)]
        return pa.table({c: pa.array([v], pa.int64()) for c, v in zip(names, counted(lengths))})

    names = ["n_prompts", "n_batches", "n_chars", "n_padded"]
    schema = ", ".join(f"{c} long" for c in names)
    lengths = prompts.select(*key, F.char_length("prompt").alias("n"))
    if key:
        parts = _in_runs(lengths, key, rows).groupBy("run").applyInArrow(run_group, schema)
    else:
        parts = lengths.mapInArrow(run, schema)
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in names])


def _in_runs(lengths: DataFrame, key: Sequence[str], rows: int | None) -> DataFrame:
    """``run, start, n, times``: the lengths in each run of ``rows`` prompts in the order of their keys.

    Prompts equal in key and length are one row until it is known which runs they are in.
    """
    rows = rows or int(lengths.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows < 1:
        raise ValueError("a run needs room for a prompt")
    different = scratch_table(lengths.groupBy(*key, "n").agg(F.count("*").alias("times")), "prompt-lengths")
    placed = with_running_start(different, [*key, "n"], "times").select("n", "times", "start")
    stop = F.col("start") + F.col("times")
    first, last = ((x - F.pmod(x, F.lit(rows))) / F.lit(rows) for x in (F.col("start"), stop - 1))
    spread = placed.select("*", stop.alias("stop"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("run"))
    low = F.greatest("start", F.col("run") * F.lit(rows))
    high = F.least("stop", (F.col("run") + 1) * F.lit(rows))
    return spread.select("run", low.alias("start"), "n", (high - low).alias("times"))


def generate(
    prompts: DataFrame,
    generator: GeneratorFactory,
    returns: str = "text",
    batch_size: int = BATCH_SIZE,
    options: dict[str, Any] | None = None,
    by_length: bool = False,
    max_padded: int | None = None,
    profile: ResourceProfile | None = None,
    barrier: bool = False,
    mark_failures: bool = False,
) -> DataFrame:
    """Replace ``prompt`` by the raw generation; all other columns travel along.

    ``by_length`` puts prompts of like length into one batch, so that little is padded, and
    ``max_padded`` bounds a batch's prompts times the characters of its longest one. Both look at the rows of one
    Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``) at a time and leave their order.

    ``profile`` gives the tasks that generate, and no others, resources of their own, such as an
    accelerator; ``barrier`` starts all of them together, for a generator whose tasks talk to each other.

    With ``mark_failures`` a generator that fails in a task's last attempt does not fail the job: the rows of
    that task that have no results yet say why in a column ``__error``, which is NULL elsewhere.
    """
    if returns not in ("text", "ids"):
        raise ValueError(f"returns must be 'text' or 'ids', not {returns!r}")
    if batch_size < 1 or (max_padded is not None and max_padded < 1):
        raise ValueError("a batch needs room for a prompt")
    settings = {**GENERATION_OPTIONS, **(options or {})}
    carried = prompts.drop("prompt")
    names = carried.columns
    schema = T.StructType([*carried.schema.fields, T.StructField("raw", T.StringType())])
    if returns == "ids":
        schema = T.StructType([*carried.schema.fields, *_RAW_IDS])
    if mark_failures:
        schema = schema.add(ERROR, T.StringType())
    attempts = _attempts(prompts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, failure = generator(**settings), None

        def answered(texts: list[str], sizes: list[int]) -> list[Any]:
            """The results of some batches, which follow each other in ``texts``."""
            nonlocal failure
            results: list[Any] = []
            for size in sizes if failure is None else ():
                asked = texts[len(results) : len(results) + size]
                try:
                    answers = list(model(asked))
                except Exception as error:
                    if not mark_failures or TaskContext.get().attemptNumber() + 1 < attempts:
                        raise
                    failure = f"{type(error).__name__}: {error}"
                    break
                if len(answers) != size:
                    raise ValueError(f"{size} prompts gave {len(answers)} results")
                results += answers
            return results if failure is None else [None] * len(texts)

        def columns(results: list[Any]) -> dict[str, pa.Array]:
            if returns == "text":
                return {"raw": pa.array(results, pa.string())}
            pairs = [r if isinstance(r, tuple) else (0, r) for r in results]
            return {
                "ids": pa.array([ids for _, ids in pairs], pa.list_(pa.int32())),
                "prompt_len": pa.array([n for n, _ in pairs], pa.int32()),
            }

        def finished(rows: pa.RecordBatch, results: dict[str, pa.Array]) -> pa.RecordBatch:
            out = {name: rows[name] for name in names} | results
            if mark_failures:
                out[ERROR] = pa.array([failure] * rows.num_rows, pa.string())
            return pa.RecordBatch.from_pydict(out)

        for rows in batches:
            cut = cut_batches(pc.utf8_length(rows["prompt"]).to_pylist(), batch_size, by_length, max_padded)
            # Only the prompts and results of a group of batches are Python objects at a time.
            groups = grouped(cut, text_bytes(rows["prompt"]))
            if not by_length:
                for group in groups:
                    some = rows.slice(group[0][0], sum(map(len, group)))
                    results = columns(answered(some["prompt"].to_pylist(), list(map(len, group))))
                    yield finished(some, results)
                    del some, results
                del rows  # before the next batch is read
                continue
            parts = [
                columns(answered(rows["prompt"].take(pa.array([i for b in group for i in b])).to_pylist(), list(map(len, group))))
                for group in groups
            ]
            order = [i for b in cut for i in b]
            back = pa.array(sorted(range(len(order)), key=order.__getitem__), pa.int64())
            if failure is not None:
                parts = [columns([None] * len(order))]
            yield finished(rows, {c: pa.concat_arrays([p[c] for p in parts]).take(back) for c in parts[0]} if parts else columns([]))

    return prompts.mapInArrow(run, schema, barrier=barrier, profile=profile)


def _attempts(spark: SparkSession) -> int:
    """How often a task is tried: in a local session once, unless its master says more."""
    local = re.match(r"local(?:\[[^,\]]*(?:,\s*(\d+))?\])?$", spark.conf.get("spark.master", ""))
    return int(local[1] or 1) if local else int(spark.conf.get("spark.task.maxFailures", "4"))


def parse_text(
    raw: DataFrame, marker: str = END_OF_REASONING_TEXT, keep_marker: bool = True
) -> DataFrame:
    """``raw`` text to ``thinking`` and ``output``."""
    thinking, output = split_text(F.col("raw"), marker, keep_marker)
    return raw.withColumns({"thinking": thinking, "output": output}).drop("raw")


def split_generated_ids(raw: DataFrame, marker: int = END_OF_REASONING_ID) -> DataFrame:
    """``ids, prompt_len`` to ``thinking_ids`` and ``output_ids``."""
    new = raw.withColumn("ids", strip_prompt_ids(F.col("ids"), F.col("prompt_len")))
    thinking, output = split_ids(F.col("ids"), marker)
    return new.withColumns({"thinking_ids": thinking, "output_ids": output}).drop(
        "ids", "prompt_len"
    )


def parse_ids(
    raw: DataFrame, decoder: DecoderFactory, marker: int = END_OF_REASONING_ID, keep_marker: bool = True
) -> DataFrame:
    """``ids, prompt_len`` to decoded ``thinking`` and ``output``."""
    split = split_generated_ids(raw, marker)
    if not keep_marker:  # the reasoning ends with it, if there is any
        size = F.greatest(F.size("thinking_ids") - 1, F.lit(0))
        split = split.withColumn("thinking_ids", F.slice("thinking_ids", F.lit(1), size))
    carried = split.drop("thinking_ids", "output_ids")
    names = carried.columns
    parts = ("thinking", "output")
    schema = T.StructType(
        [*carried.schema.fields, *[T.StructField(part, T.StringType()) for part in parts]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder()
        for rows in batches:
            sizes = [a + b for a, b in zip(*(id_bytes(rows[f"{part}_ids"]) for part in parts))]
            for some in sliced(rows, sizes):
                out = {name: some[name] for name in names}
                for part in parts:
                    texts = list(decode(some[f"{part}_ids"].to_pylist()))
                    out[part] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_pydict(out)

    decoded = split.mapInArrow(run, schema)
    return decoded.withColumns({part: strip_newlines(F.col(part)) for part in parts})


def batch_infer(
    df: DataFrame,
    key: str | Sequence[str] | None,
    generator: GeneratorFactory,
    text: str = "text",
    template: str | Template = "chatml",
    returns: str = "text",
    decoder: DecoderFactory | None = None,
    batch_size: int = BATCH_SIZE,
    n: int | None = None,
    tasks: int | None = None,
    options: dict[str, Any] | None = None,
    raw_path: str | None = None,
    keep_marker: bool = True,
    marker: str | int | None = None,
    on_error: str = "raise",
    pieces: int = 1,
    resume: bool = False,
    by_length: bool = False,
    max_padded: int | None = None,
    profile: ResourceProfile | None = None,
    barrier: bool = False,
) -> DataFrame:
    """``key..., input, thinking, output`` for every row of ``df``.

    The raw generations are written first, to ``raw_path`` or the shared scratch
    folder, and parsed from there: parsing can be repeated, and losing an executor
    later never calls the generator again. ``n`` takes only the first rows by key. ``tasks``
    spreads few but costly rows over that many tasks, the first ``n`` over all cores by default.

    With ``pieces`` the rows are divided by a hash into that many tasks of one job, which reads its input
    once. Each commits its own folder below ``raw_path`` when it is done. A generator that fails leaves its
    own piece undone and fails the call once the others are through. After a failure the same call with ``resume=True`` generates only the pieces that are not there; input,
    generator and ``pieces`` have to be the same. Take several pieces per core; ``tasks`` has no say then.

    Without a key (None) the rows are those of files, and ``position``, their number in
    file order, becomes the key.

    ``by_length``, ``max_padded``, ``profile`` and ``barrier`` are those of ``generate``; the results are
    the same.

    ``marker`` ends the reasoning: a text, or an id for a generator of ids. A NULL text fails the
    job; with ``on_error="quarantine"`` its row is kept, with NULL results and an ``error``.
    """
    if key is None:
        key = POSITION
        if n is None:
            df = with_position(df.select(text))
        else:
            df, n = first_with_position(df.select(text), n), None
            tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    keys = [key] if isinstance(key, str) else list(key)
    if returns == "ids" and decoder is None:
        raise ValueError("a generator of ids needs a decoder")
    if on_error not in ("raise", "quarantine"):
        raise ValueError(f"on_error must be 'raise' or 'quarantine', not {on_error!r}")
    if pieces < 1:
        raise ValueError(f"pieces must be at least 1, not {pieces}")
    if resume and raw_path is None:
        raise ValueError("resume needs the raw_path of the run that failed")
    rows = df.select(*keys, text)
    if n is not None:
        rows = first_n(rows, n, keys)
    rejected = rows.filter(F.col(text).isNull()) if on_error == "quarantine" else None
    if rejected is not None:
        rows = rows.filter(F.col(text).isNotNull())
    if tasks is None and n is not None:  # the first rows come in one partition
        tasks = df.sparkSession.sparkContext.defaultParallelism
    spark = df.sparkSession
    path = raw_path or scratch_path(spark, "generations")

    def generated(own: DataFrame, keys: Sequence[str]) -> DataFrame:
        prompts = build_prompts(own, keys, text, template)
        return generate(
            prompts, generator, returns, batch_size, options, by_length, max_padded, profile, barrier, mark_failures=pieces > 1
        )

    if pieces == 1:
        raw = generated(rows if tasks is None else rows.repartition(tasks), keys)
        if not (resume and is_written(spark, path)):
            raw.write.mode("overwrite" if resume else "errorifexists").parquet(path)
        saved = spark.read.schema(raw.schema).parquet(path)
    else:
        done = piece_folders(spark, path)
        if done and not resume:
            raise ValueError(f"{path} already exists: it holds {len(done)} pieces, pass resume=True to go on with them")
        place = F.pmod(F.xxhash64(*keys, text), F.lit(pieces)).cast("int")
        rest = rows.filter(~place.isin(list(done))) if done else rows
        raw = generated(in_pieces(rest, place, pieces), [*keys, PIECE])
        if len(done) < pieces:
            write_pieces(raw, path)
        saved = read_pieces(spark, path, raw.drop(PIECE, ERROR).schema)
    if returns == "text":
        parsed = parse_text(saved, END_OF_REASONING_TEXT if marker is None else marker, keep_marker)
    else:
        parsed = parse_ids(saved, decoder, END_OF_REASONING_ID if marker is None else marker, keep_marker)
    if rejected is None:
        return parsed
    nothing = F.lit(None).cast("string")
    empty = rejected.select(
        *keys, F.col(text).alias("input"), nothing.alias("thinking"), nothing.alias("output"),
        F.lit("text is null").alias("error"),
    )
    return parsed.withColumn("error", nothing).unionByName(empty)
