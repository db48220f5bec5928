"""Chat formatting: layouts are told by fingerprints of their field paths, and mapped into canonical turns.

A layout's fingerprint is the XXH64 of its nested field paths, those that some mapping names (list steps are written
``[]``, as in ``messages[].role``; other fields, such as metadata, don't change it). It selects a ``Mapping``: a plain
statement of which fields are turns, and of whose. Fingerprints of the stated layouts are a table; one that isn't in it is
resolved once (the first mapping whose fields are all there) and remembered. Frames have one layout, their schema's, and
are converted by column expressions; JSON records are told apart row by row and converted in Arrow batches.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. No text can pose as a mark: each ``<|`` of it, with
any backslashes between the two signs, gets one backslash more, and reading takes it out again. In roles, line breaks and
backslashes are spelt with a backslash as well. The loss mask covers the texts of the assistant, and no marks.

A formatted conversation is a run of pieces, one a turn, in order; each piece is made where its row is read. Reading back
streams the pieces of a conversation through one task, as its digests are sequential: the task holds a batch of turns and
two hash states, however long the conversation is.

* Null texts and null roles are empty. Turns are sorted by number, null last, then by their place in the record; ties by
  role and text, so that repeated rows give repeated turns. Rows of a null conversation are one conversation.
* A record that isn't JSON, or whose fields no mapping knows, is kept: one row without layout, role and text. A frame of
  an unknown layout is an error that lists its paths. A record whose list of messages is empty has no layout.
* An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType
from xxhash import xxh64_hexdigest

from canloom.llm.common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Names that other layouts have for roles.
ALIASES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "chatgpt": ASSISTANT}


@dataclass(frozen=True)
class One:
    """A field that is the text of one turn; an optional one that is missing, null or empty is no turn. A field that ``adds`` goes behind
    the text of the turn before, after an empty line."""

    text: str
    role: str
    optional: bool = False
    adds: bool = False


@dataclass(frozen=True)
class Many:
    """A list of messages, each with a role and a text; roles may go by other names."""

    items: str
    role: str
    text: str
    aliases: bool = False


@dataclass(frozen=True)
class Row:
    """A record that is one turn of a conversation, with its number."""

    turn: str
    role: str
    text: str


@dataclass(frozen=True)
class Mapping:
    name: str
    steps: tuple[One | Many | Row, ...]

    def paths(self, optional: bool) -> list[str]:
        """Field paths of the steps that must be there, or of those that may be."""
        return [p for s in self.steps if (isinstance(s, One) and s.optional) == optional for p in step_paths(s)]


def step_paths(step: One | Many | Row) -> list[str]:
    if isinstance(step, One):
        return [step.text]
    if isinstance(step, Many):
        return [f"{step.items}[].{step.role}", f"{step.items}[].{step.text}"]
    return [step.turn, step.role, step.text]


#: Known layouts. Where a record fits several, the first.
MAPPINGS = (
    Mapping("turn rows", (Row("turn", "role", "text"),)),
    Mapping("messages", (One("system", "system", optional=True), Many("messages", "role", "content"))),
    Mapping("conversations", (One("system", "system", optional=True), Many("conversations", "from", "value", aliases=True))),
    Mapping("conversation", (One("system", "system", optional=True), Many("conversation", "role", "content"))),
    Mapping("instruction", (One("system", "system", optional=True), One("instruction", "user"), One("input", "user", optional=True, adds=True), One("output", ASSISTANT))),
    Mapping("instruction and response", (One("system", "system", optional=True), One("instruction", "user"), One("context", "user", optional=True, adds=True), One("response", ASSISTANT))),
    Mapping("prompt and completion", (One("system", "system", optional=True), One("prompt", "user"), One("completion", ASSISTANT))),
    Mapping("prompt and response", (One("system", "system", optional=True), One("prompt", "user"), One("response", ASSISTANT))),
    Mapping("question and answer", (One("system", "system", optional=True), One("question", "user"), One("answer", ASSISTANT))),
    Mapping("nested exchange", (One("data.prompt", "user"), One("data.reply.text", ASSISTANT))),
)


def value_paths(value: object, at: str = "") -> Iterator[str]:
    """Paths of all fields of a JSON value."""
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{_key(k)}" if at else _key(k)
            yield path
            yield from value_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{at}[]")


def schema_paths(kind: DataType, at: str = "") -> Iterator[str]:
    """Paths of all fields of a schema; keys of maps are values, not fields."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            path = f"{at}.{_key(f.name)}" if at else _key(f.name)
            yield path
            yield from schema_paths(f.dataType, path)
    elif isinstance(kind, ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")


def _key(name: str) -> str:
    return json.dumps(name) if re.search(r'[.\[\]"\n]', name) else name


class Layouts:
    """Mappings by fingerprint."""

    def __init__(self, mappings: Iterable[Mapping] = MAPPINGS):
        self.mappings = tuple(mappings)
        self.vocabulary = frozenset(p for m in self.mappings for o in (False, True) for p in m.paths(o))
        self.known: dict[str, Mapping | None] = {}
        for m in reversed(self.mappings):  # of equal layouts the first mapping counts
            may = m.paths(True)
            for some in chain.from_iterable(combinations(may, n) for n in range(len(may) + 1)):
                self.known[self.fingerprint([*m.paths(False), *some])] = m

    def fingerprint(self, paths: Iterable[str]) -> str:
        return xxh64_hexdigest("\n".join(sorted(self.vocabulary.intersection(paths))))

    def select(self, paths: Iterable[str]) -> tuple[str, Mapping | None]:
        """The fingerprint of a record with these paths, and its mapping, if there is one."""
        there = self.vocabulary.intersection(paths)
        mark = self.fingerprint(there)
        if mark not in self.known:
            self.known[mark] = next((m for m in self.mappings if there.issuperset(m.paths(False))), None)
        return mark, self.known[mark]


TURNS = "turn long, place int, role string, text string, layout string, fingerprint string"


# frames: one layout, by columns


def _plain_text(column: Column, kind: DataType) -> Column:
    """The text of a field; of a list of parts, their texts joined."""
    if isinstance(kind, ArrayType):
        part = kind.elementType
        text = (lambda p: p["text"]) if isinstance(part, StructType) else (lambda p: p)
        return F.array_join(F.transform(column, lambda p: F.coalesce(text(p).cast("string"), F.lit(""))), "")
    return column.cast("string")


def _at(kind: DataType, path: str) -> DataType:
    for name in path.split("."):
        kind = next(f.dataType for f in kind.fields if f.name == name)
    return kind


def _turns_column(step: One | Many, schema: StructType) -> Column:
    """array<struct<role, text>> of a step."""
    if isinstance(step, One):
        text = _plain_text(F.col(step.text), _at(schema, step.text))
        turn = F.array(F.struct(F.lit(step.role).alias("role"), F.coalesce(text, F.lit("")).alias("text")))
        return F.when(F.length(text) > 0, turn).otherwise(F.filter(turn, lambda x: F.lit(False))) if step.optional else turn
    item = _at(schema, step.items).elementType
    whose = lambda m: F.coalesce(m[step.role].cast("string"), F.lit(""))
    role = whose
    if step.aliases:
        names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
        role = lambda m: F.coalesce(F.try_element_at(names, whose(m)), whose(m))
    one = lambda m: F.struct(role(m).alias("role"), F.coalesce(_plain_text(m[step.text], _at(item, step.text)), F.lit("")).alias("text"))
    return F.transform(F.filter(F.coalesce(F.col(step.items), F.array().cast(_at(schema, step.items))), lambda m: m.isNotNull()), one)


def _added(turns: Column, more: Column) -> Column:
    """turns, the last of which has the one of ``more`` (if any) behind it."""
    last, size = F.element_at(turns, -1), F.size(turns)
    both = F.struct(last["role"].alias("role"), F.concat(last["text"], F.lit("\n\n"), more[0]["text"]).alias("text"))
    return F.when(F.size(more) > 0, F.concat(F.slice(turns, 1, size - 1), F.array(both))).otherwise(turns)


def turns_of(df: DataFrame, key: str = "conv_id", layouts: Layouts | None = None) -> DataFrame:
    """conv_id, turn, place, role, text, layout and fingerprint of a frame whose schema is a known layout."""
    schema = df.schema
    paths = sorted(schema_paths(schema))
    mark, mapping = (layouts or Layouts()).select(paths)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {mark}: {', '.join(paths)}")
    told = [F.lit(mapping.name).alias("layout"), F.lit(mark).alias("fingerprint")]
    first = mapping.steps[0]
    if isinstance(first, Row):
        filled = [F.coalesce(_plain_text(F.col(c), _at(schema, c)), F.lit("")).alias(n) for c, n in ((first.role, "role"), (first.text, "text"))]
        return df.select(F.col(key).alias("conv_id"), F.col(first.turn).cast("long").alias("turn"), F.lit(0).alias("place"), *filled, *told)
    steps = [s for s in mapping.steps if not (isinstance(s, One) and s.optional and s.text not in paths)]
    turns = _turns_column(steps[0], schema)
    for s in steps[1:]:
        more = _turns_column(s, schema)
        turns = _added(turns, more) if isinstance(s, One) and s.adds else F.concat(turns, more)
    listed = df.select(F.col(key).alias("conv_id"), F.posexplode(turns).alias("place", "one"))
    return listed.select("conv_id", F.col("place").cast("long").alias("turn"), "place", "one.role", "one.text", *told)


# JSON records: a layout each, in Arrow batches


def _get(value: object, path: str) -> object:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _said(value: object) -> str:
    """The text of a JSON value: parts of a list joined, null empty, numbers as they are written."""
    if isinstance(value, list):
        return "".join(_said(v.get("text") if isinstance(v, dict) else v) for v in value)
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def record_turns(record: dict, mapping: Mapping) -> list[tuple[int | None, str, str]]:
    """(number, role, text) of each turn of a JSON record."""
    out: list[tuple[int | None, str, str]] = []
    for s in mapping.steps:
        if isinstance(s, Row):
            n = _get(record, s.turn)
            out.append((n if isinstance(n, int) and -(2**63) <= n < 2**63 else None, _said(_get(record, s.role)), _said(_get(record, s.text))))
        elif isinstance(s, One):
            text = _said(_get(record, s.text))
            if text or not s.optional:
                if s.adds and out:
                    out[-1] = (*out[-1][:2], f"{out[-1][2]}\n\n{text}")
                else:
                    out.append((len(out), s.role, text))
        else:
            items = _get(record, s.items)
            for m in items if isinstance(items, list) else []:
                if isinstance(m, dict):
                    role = _said(_get(m, s.role))
                    out.append((len(out), ALIASES.get(role, role) if s.aliases else role, _said(_get(m, s.text))))
    return out


def _reading(layouts: Layouts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, taken = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    record = json.loads(text or "")
                except (ValueError, RecursionError):
                    record = None
                mark, mapping = layouts.select(value_paths(record)) if isinstance(record, dict) else (None, None)
                turns = record_turns(record, mapping) if mapping else [(None, None, None)]
                rows += [(n, place, role, said, mapping and mapping.name, mark) for place, (n, role, said) in enumerate(turns)]
                taken += [i] * len(turns)
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 4]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["turn", "place", "role", "text", "layout", "fingerprint"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), *columns], ["conv_id", *names])

    return run


def turns_of_json(df: DataFrame, key: str, record: str, layouts: Layouts | None = None) -> DataFrame:
    """conv_id (= key), turn, place, role, text, layout and fingerprint of JSON records of any mix of known layouts."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    chosen = df.select(F.col(key).alias("conv_id"), F.col(record).cast("string").alias("record"))
    return chosen.mapInArrow(_reading(layouts or Layouts()), f"conv_id {kind}, {TURNS}")


# the template


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<\\" in text else text


def role_read(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role)) if "\\" in role else role


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, place, piece, loss_start and loss_end (code points of the piece; equal where nothing is learnt)."""
    role = escaped(F.replace(F.replace("role", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    parts = turns.where(F.col("layout").isNotNull()).select("conv_id", "turn", "place", F.col("role").eqNullSafe(ASSISTANT).alias("learnt"), role.alias("r"), escaped(F.col("text")).alias("t"))
    start = F.length("r") + len(START) + 1
    piece = F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(f"{END}\n"))
    return parts.select("conv_id", "turn", "place", piece.alias("piece"), start.alias("loss_start"), (start + F.when(F.col("learnt"), F.length("t")).otherwise(0)).alias("loss_end"))


def conversations(pieces: DataFrame) -> DataFrame:
    """conv_id, text and loss (array of start and end) of each formatted conversation, which must fit one string."""
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "place", "piece")
    at = F.coalesce(F.sum(F.length("piece")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = pieces.select("conv_id", F.row_number().over(before).alias("n"), "piece", (at + F.col("loss_start")).alias("start"), (at + F.col("loss_end")).alias("end"))
    held = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "start", "end"))).alias("p"))
    learnt = F.transform(F.filter("p", lambda x: x["end"] > x["start"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return held.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), learnt.alias("loss"))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text; an error if it is anything else."""
    out, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        end = text.find(END, line)
        if not text.startswith(START, at) or line < 0 or end < 0 or not text.startswith("\n", end + len(END)):
            raise ValueError(f"no turn at {at}")
        out.append((role_read(text[at + len(START) : line]), unescaped(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


class _Reader:
    """Counts and digests of the pieces of one conversation."""

    def __init__(self, key: object):
        self.key, self.turns, self.chars, self.loss_chars = key, 0, 0, 0
        self.said, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int) -> None:
        for role, text in parse(piece):
            self.turns += 1
            self.said.update(f"{role}\n{text}\n".encode())
        loss = unescaped(piece[start:end])
        self.chars += len(piece)
        self.loss_chars += len(loss)
        self.learnt.update(loss.encode())

    def row(self) -> tuple:
        return self.key, self.turns, self.said.hexdigest(), self.loss_chars, self.learnt.hexdigest(), self.chars


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, kind, done = None, None, []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def out() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for key, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
            if reader is None or key != reader.key:
                done += [reader.row()] if reader else []
                reader = _Reader(key)
            reader.add(piece, start, end)
        if done:
            yield out()
            done = []
    if reader:
        done = [reader.row()]
        yield out()


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read from the formatted pieces."""
    small_batches(pieces.sparkSession)
    kind = pieces.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.col("turn").asc_nulls_last(), "place", "piece"]
    together = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "loss_start", "loss_end")
    return together.mapInArrow(_digesting, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
