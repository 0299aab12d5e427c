"""Chat formatting by schema fingerprints.

A record's layout is recognised by the hash of its nested field paths. LAYOUTS declares, for each layout, where roles and texts lie;
the fingerprint picks the declaration, and the record becomes canonical turns (conv_id, turn, role, text). Fields that no
layout knows are left out of the fingerprint, so extra columns do no harm; a record whose
known paths fit no layout is returned with its fingerprint and no turns. Typed tables are fingerprinted once by
their schema, JSON records one by one.

Turns are written with markers, `<|im_start|>role\\ntext<|im_end|>\\n`. A control string inside a text gets one more backslash
behind its first character, and reading back takes one away, so texts that already hold escaped strings survive. The loss
mask covers the escaped text of assistant turns.

Null text: empty. Null role: `unknown`. Half of a surrogate pair in a JSON record: U+FFFD. A record that is no JSON object, or nested too deeply to be read, has no layout. Turns are ordered by turn, then role, then text; equal turn
numbers and repeated rows are all kept. A null conv_id is a conversation of its own. Conversations are streamed turn by
turn in sorted order, so a very long one needs no more memory than a short one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
# Layouts. Each has the known paths of its records and where its turns lie:
# a list of turns with the names of role and text, or (role, paths joined by a blank line) in order.
LAYOUTS = {
    "turn_rows": {"paths": ["role", "text", "turn"], "row": ("turn", "role", "text")},
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    "share": {"paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    "instruction": {"paths": ["instruction", "output"], "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input": {"paths": ["input", "instruction", "output"], "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "system_instruction": {"paths": ["instruction", "output", "system"], "fields": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]},
    "prompt_response": {"paths": ["prompt", "response"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "prompt_completion": {"paths": ["completion", "prompt"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "question_answer": {"paths": ["answer", "question"], "fields": [("user", ["question"]), ("assistant", ["answer"])]},
}
KNOWN = {p for x in LAYOUTS.values() for p in x["paths"]}


def fingerprint(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths & KNOWN)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(set(x["paths"])): name for name, x in LAYOUTS.items()}

PATTERN = re.compile("|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return PATTERN.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return PATTERN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def canonical_role(role: str | None) -> str:
    role = "unknown" if role is None else str(role)
    return ROLES.get(role.lower(), whole(role))


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of it under the loss mask."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    turn = f"{head}{body}{END}\n"
    return (turn, len(head), len(head) + len(body)) if role == "assistant" else (turn, 0, 0)


def read_turn(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (turn.startswith(START) and turn.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    role, text = turn[len(START) : -len(END) - 1].split("\n", 1)
    return unescape_role(role), unescape(text)


def schema_paths(t: T.DataType, at: str = "") -> set[str]:
    if isinstance(t, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in t)) if t.fields else set()
    if isinstance(t, T.ArrayType):
        return schema_paths(t.elementType, f"{at}[]")
    return {at}


def value_paths(x: object, at: str = "") -> set[str]:
    if isinstance(x, dict):
        return set().union(*(value_paths(v, f"{at}.{k}" if at else k) for k, v in x.items())) if x else set()
    if isinstance(x, list):
        return set().union(*(value_paths(v, f"{at}[]") for v in x)) if x else {f"{at}[]"}
    return {at}


def whole(text: str) -> str:
    """text with U+FFFD in place of unpaired surrogates, which UTF-8 can't hold."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def as_text(x: object) -> str:
    return "" if x is None else whole(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))


def turns_of(record: dict, layout: dict) -> list[tuple[str, str]]:
    if "list" in layout:
        name, role, text = layout["list"]
        return [(canonical_role(t.get(role)), as_text(t.get(text))) for t in record[name] if isinstance(t, dict)]
    return [(role, "\n\n".join(x for p in paths if (x := as_text(record.get(p))))) for role, paths in layout["fields"]]


TURNS = "conv_id bigint, turn bigint, role string, text string, layout string, fingerprint string"


def turns_from_json(records: DataFrame, ident: str = "conv_id", record: str = "record") -> DataFrame:
    """Canonical turns of JSON records of any layout; records of no layout give one row with null turn and layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    x = json.loads(raw) if raw else {}
                    x = x if isinstance(x, dict) else {}
                    print_ = fingerprint(value_paths(x))
                except (ValueError, RecursionError):
                    x, print_ = {}, fingerprint(set())
                name = BY_FINGERPRINT.get(print_)
                if name is None or "row" in LAYOUTS[name]:
                    out.append((i, None, None, None, None, print_))
                else:
                    out += [(i, k, role, text, name, print_) for k, (role, text) in enumerate(turns_of(x, LAYOUTS[name]))]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
            names = [f.split(" ")[0] for f in TURNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    return records.select(F.col(ident).cast("long"), F.col(record).cast("string")).mapInArrow(run, TURNS)


def turns_from_rows(rows: DataFrame, ident: str = "conv_id") -> DataFrame:
    """Canonical turns of a table with one row a turn, recognised by its schema."""
    print_ = fingerprint(schema_paths(rows.schema))
    name = BY_FINGERPRINT.get(print_)
    if name is None or "row" not in LAYOUTS[name]:
        raise ValueError(f"no layout of turn rows has the fingerprint {print_}")
    turn, role, text = LAYOUTS[name]["row"]
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    said = F.coalesce(F.col(role).cast("string"), F.lit("unknown"))
    return rows.select(
        F.col(ident).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(known[F.lower(said)], said).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(name).alias("layout"), F.lit(print_).alias("fingerprint"),
    )


SEGMENTS = "conv_id bigint, nth bigint, turn bigint, segment string, loss_start long, loss_end long"


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, turn, segment, loss_start, loss_end) by canonical turn; a conversation is its segments in the order of nth, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = SEGMENTS, 0  # no conversation yet
        for b in batches:
            nth = []
            for conv in b.column(0).to_pylist():
                n = n + 1 if conv == at else 0
                at = conv
                nth.append(n)
            out = [write_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            segment, start, end = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nth, pa.int64()), b.column(1), pa.array(segment, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], [f.split(" ")[0] for f in SEGMENTS.split(", ")])

    ordered = turns.where("role is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


class Reader:
    """Reads one conversation as a stream of text: turns are found by their markers, wherever the pieces of it are cut."""

    def __init__(self) -> None:
        self.n = self.loss = self.chars = self.done = 0
        self.turns, self.masked, self.rest, self.spans = hashlib.sha256(), hashlib.sha256(), "", []

    def feed(self, piece: str, start: int, end: int) -> None:
        """The next piece, and the span of it under the loss mask."""
        if end > start:
            self.spans.append((self.chars + start, self.chars + end))
        self.chars += len(piece)
        self.rest += piece
        first = 0
        while (close := self.rest.find(f"{END}\n", first)) >= 0:
            last = close + len(END) + 1
            role, text = read_turn(self.rest[first:last])
            self.turns.update(f"{role}\n{text}\n".encode())
            base = self.done + first
            while self.spans and self.spans[0][1] <= base + last - first:
                a, z = self.spans.pop(0)
                under = unescape(self.rest[a - self.done : z - self.done])
                self.masked.update(under.encode())
                self.loss += len(under)
            self.n, first = self.n + 1, last
        self.done += first
        self.rest = self.rest[first:]

    def row(self, conv: int | None) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv} ends inside a turn")
        return conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of the conversations of segments in any order, read from their joined text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader, out = None, None, []
        for b in batches:
            for conv, segment, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if reader is None or conv != at:
                    if reader is not None:
                        out.append(reader.row(at))
                    at, reader = conv, Reader()
                reader.feed(segment, start, end)
            yield rows(out)
            out = []
        if reader is not None:
            yield rows([reader.row(at)])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        names = [f.split(" ")[0] for f in READ.split(", ")]
        kinds = [pa.string() if n.endswith("256") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, READ)


def oracle(said: str) -> str:
    """DuckDB SQL of the digests for `conversations` and conversation -7, two turns that say `said`. Escapes add one character each."""
    controls = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)).replace("'", "''")
    return f"""
    WITH t AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')
    ), e AS (
        SELECT *, length('{START}{END}') + length(role) + 2 + length(text) + len(regexp_extract_all(text, '{controls}')) AS size FROM t
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """
