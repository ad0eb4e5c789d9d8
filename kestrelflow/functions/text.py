"""Templates, chat rendering, routing of questions and token masks, all as column expressions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrelflow.functions.batches import small_batches
from kestrelflow.functions.numbers import significant, signed

#: Wording by band; {n} is the horizon in cycles.
WORDING = {
    "CRITICAL": ("Readings have left the healthy range.", "Inspect within {n} cycles."),
    "WARNING": ("Readings drift towards the limits.", "Plan an inspection within {n} cycles."),
    "NORMAL": ("Readings stay within the healthy range.", "Keep to the regular schedule."),
}

#: A question with one of these substrings asks about parts or upkeep, or about a route.
UPKEEP_WORDS = (
    "part", "oem", "component", "station", "failing", "sub-assembly", "bom", "thermodynamic", "mechanism", "physics",
    "divergence", "t50", "ps30", "anomaly", "faa", "easa", "audit", "compliance", "borescope", "maintenance",
)
ROUTE_WORDS = ("route", "etops", "dispatch", "jfk", "lhr", "fly", "destination", "divert")


def describe_window(start: Column, end: Column, drifts: dict[str, Column]) -> tuple[Column, Column]:
    """A prompt and a rationale from what was observed; neither takes a unit or a remaining life."""
    prompt = F.concat(F.lit("Assess the readings of cycles "), start.cast("string"), F.lit(" to "), end.cast("string"), F.lit("."))
    said = [F.concat(F.lit(f"{name} changed by "), signed(x, 2)) for name, x in drifts.items()]
    return prompt, F.concat(F.lit("From first to last reading "), F.concat_ws(", ", *said), F.lit("."))


def directive(band: Column, horizon: Column) -> Column:
    """What to do, with the horizon filled in."""
    text = F.lit(None).cast("string")
    for name, (_, say) in WORDING.items():
        head, mark, tail = say.partition("{n}")
        whole = F.concat(F.lit(head), horizon.cast("string"), F.lit(tail)) if mark else F.lit(say)
        text = F.when(band == name, whole).otherwise(text)
    return text


def staged_report(observation: Column, band: Column, horizon: Column, projected: Column) -> Column:
    """A struct of four stages and a summary, in which a null projection is left out."""
    finding = F.lit(None).cast("string")
    for name, (say, _) in WORDING.items():
        finding = F.when(band == name, F.lit(say)).otherwise(finding)
    todo = directive(band, horizon)
    projection = F.coalesce(F.concat(F.lit(" About "), projected.cast("string"), F.lit(" cycles remain.")), F.lit(""))
    return F.struct(
        observation.alias("observation"), finding.alias("analysis"), F.concat(F.lit("State: "), band, F.lit("."), projection).alias("assessment"),
        todo.alias("directive"), F.concat_ws(" ", F.concat(band, F.lit(":")), todo).alias("summary"),
    )


def feature_prompt(names: Sequence[str], stats: Sequence[Sequence[Column]]) -> Column:
    """A line of statistics for each channel, with four significant digits, and the request for one number."""
    rows = [F.concat(F.lit(f"{n}: "), F.concat_ws(", ", *(significant(x) for x in row))) for n, row in zip(names, stats, strict=True)]
    ask = "How many cycles remain? Columns: mean, standard deviation, minimum, maximum, last minus first."
    return F.concat_ws("\n", F.lit(ask), *rows, F.lit("Answer with one non-negative number."))


def supervised_target(rationale: Column, target: Column) -> Column:
    return F.concat_ws(" ", rationale, target)


def render_chat(rows: DataFrame, conversation: str = "conv_id", opener: bool = False) -> DataFrame:
    """(conversation, rendered): the messages by turn between start and end marks, with an assistant's opener if asked for."""
    message = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    listed = rows.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct("turn", message.alias("said")))).alias("listed"))
    end = F.lit("<|im_start|>assistant\n" if opener else "")
    return listed.select(conversation, F.concat(F.array_join(F.col("listed.said"), ""), end).alias("rendered"))


def question_route(prompt: Column, generated: Column) -> Column:
    """upkeep, route, generated or fallback: upkeep words go before route words; both match within words."""
    low = F.lower(prompt)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return (
        F.when(any_of(UPKEEP_WORDS), "upkeep").when(any_of(ROUTE_WORDS), "route")
        .when(F.length(F.regexp_replace(generated, r"\A\s+|\s+\z", "")) > 0, "generated").otherwise("fallback")
    )


def masked_tokens(prompt_ids: Column, response_ids: Column, length: int, begin: int = 1, end: int = 2, ignore: int = -100, padding: int | None = None) -> Column:
    """A struct of input ids, attention mask, labels and whether they fit.

    The prompt starts with `begin` and has ignored labels; the response ends with `end`; both are
    padded with `padding` (`end` by default). What is too long is never cut: its arrays are null and `fits` is false.
    """
    if type(length) is not int or length < 1:
        raise ValueError("length must be a positive whole number")
    head = F.concat(F.array(F.lit(begin)), prompt_ids)
    tail = F.concat(response_ids, F.array(F.lit(end)))
    used = F.size(head) + F.size(tail)
    rest = F.greatest(F.lit(length) - used, F.lit(0))
    repeat = lambda v, n: F.array_repeat(F.lit(v), n)
    fits = used <= length
    return F.struct(
        F.when(fits, F.concat(head, tail, repeat(end if padding is None else padding, rest))).alias("input_ids"),
        F.when(fits, F.concat(repeat(1, used), repeat(0, rest))).alias("attention_mask"),
        F.when(fits, F.concat(repeat(ignore, F.size(head)), tail, repeat(ignore, rest))).alias("labels"),
        fits.alias("fits"),
    )


def with_prefix(mask: Column, labels: Column, prefix: int, ignore: int = -100) -> tuple[Column, Column]:
    """Mask and labels with so many attended, unlabelled places before them."""
    return F.concat(F.array_repeat(F.lit(1), prefix), mask), F.concat(F.array_repeat(F.lit(ignore), prefix), labels)


def is_blank(prompt: Column) -> Column:
    """True for a null prompt and one of white space only, which nothing can be asked with."""
    return F.coalesce(F.length(F.regexp_replace(prompt, r"\s+", "")) == 0, F.lit(True))


def word_ids(text: Column, first: int = 10, size: int = 1 << 30) -> Column:
    """An id from `first` on for each word between white space, by a hash of the word; one pass over texts of any length."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(size)) + first).cast("int"))


#: Rows whose ids a task holds at a time.
PIECE = 64


class Tokenizer(Protocol):
    """What a tokenizer has to offer: ids of a text without special tokens, and the ids that begin, end and pad."""

    begin_id: int
    end_id: int
    padding_id: int

    def encode(self, text: str) -> list[int]: ...


class HashedWords:
    """A tokenizer without a vocabulary: each word between white space has an id from 10 on, by a hash of its bytes."""

    begin_id, end_id, padding_id = 1, 2, 0

    def encode(self, text: str) -> list[int]:
        return [zlib.crc32(w.encode()) % (1 << 30) + 10 for w in text.split()]


def token_ids(make: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A column function of any tokenizer: `make` gives one, once a task. A null text has null ids."""

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for texts in parts:
            yield texts.map(lambda t: None if t is None else own.encode(t))

    return encode


def tokenized(rows: DataFrame, make: Callable[[], Tokenizer], prompt: str, response: str, length: int) -> DataFrame:
    """The rows with `tokens`, as masked_tokens() has them, by a tokenizer's own ids; `prompt` and `response` are columns of text.

    A task holds the ids of PIECE rows at a time, whatever the table's size.
    """
    own = make()

    def encode(batches):
        each = [(c, make()) for c in (prompt, response)]
        for batch in batches:
            for piece in (batch.slice(i, PIECE) for i in range(0, batch.num_rows, PIECE)):
                ids = [pa.array([None if t is None else tokenizer.encode(t) for t in piece.column(c).to_pylist()], pa.list_(pa.int32())) for c, tokenizer in each]
                yield pa.RecordBatch.from_arrays([*piece.columns, *ids], [*piece.schema.names, "_prompt", "_response"])

    kept = T.StructType([*rows.schema, T.StructField("_prompt", T.ArrayType(T.IntegerType())), T.StructField("_response", T.ArrayType(T.IntegerType()))])
    listed = small_batches(rows).mapInArrow(encode, kept)
    whole = masked_tokens(F.col("_prompt"), F.col("_response"), length, own.begin_id, own.end_id, padding=own.padding_id)
    return listed.withColumn("tokens", whole).drop("_prompt", "_response")


#: Questions a user may start from, by name.
PRESETS = {
    "state": "What state is the unit in, and why?",
    "remaining": "How many cycles remain before the unit has to be taken out of service?",
    "upkeep": "Which component should maintenance look at first?",
    "route": "Is the unit fit for the planned route?",
}


def prompt_preset(name: str) -> str:
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def preset_prompt(name: Column) -> Column:
    """The question of a preset's name; null for another name."""
    out = F.lit(None).cast("string")
    for key in PRESETS:
        out = F.when(name == key, prompt_preset(key)).otherwise(out)
    return out
