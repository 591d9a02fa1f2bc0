"""Chat formatting with schema fingerprinting.

Each record is a JSON document in one of several layouts (prompt/response, instruction/input/output,
role-content messages, from-value conversations, ...).  The nested field paths that some layout knows are
hashed; the hash selects a declarative mapping that turns the record into canonical ``(role, text)`` turns
(a hash that is met for the first time is resolved to the layout with the most fields among those whose
fields are all there, so other keys, such as ids, do no harm).  A template writes the turns with control marks::

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts every backslash becomes two and every ``<|`` becomes ``<\\|`` (and a line
feed in a role ``\\n``), so no text can forge a mark and `parse` gives the turns back exactly.  The loss mask is a
list of code-point spans of the formatted string that cover the assistants' texts.

Edge cases: a null text or role is empty; numbers, booleans and nested values are their JSON text; a turn that
is no object is a text without role; a lone surrogate becomes U+FFFD; texts of any length are kept whole;
an empty or null record, one that is no JSON object or nested too deeply for the parser, and one with no
layout's fields give no turns and ``mapping`` null; repeated turns and rows stay, in the order given; an empty
table gives an empty result; columns other than id and record are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def field_paths(value) -> set[str]:
    """Paths of all leaves and containers; list items share one path."""
    found, stack = set(), [("", value)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            found.add(path + "{}")
            stack += [(f"{path}.{k}", v) for k, v in value.items()]
        elif isinstance(value, list):
            found.add(path + "[]")
            stack += [(path + "[]", v) for v in value]
        else:
            found.add(path)
    return found


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()


def as_text(value) -> str:
    """Strings as they are, null empty, everything else as JSON."""
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # surrogates: pairs are put together, lone ones replaced
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


@dataclass(frozen=True)
class Layout:
    """How one layout is read: single fields with their roles, or a list with a role and a text key."""

    name: str
    example: dict
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, keys joined by an empty line)
    turns: str | None = None
    role_key: str = "role"
    text_key: str = "content"
    roles: tuple[tuple[str, str], ...] = ()

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.turns is not None:
            names = dict(self.roles)
            rows = [(as_text(x.get(self.role_key)), as_text(x.get(self.text_key))) if isinstance(x, dict) else ("", as_text(x))
                    for x in record[self.turns]]
            return [(names.get(r, r), t) for r, t in rows]
        return [(role, "\n\n".join(as_text(record[k]) for k in keys)) for role, keys in self.fields]


class Mappings:
    """Finds the layout of a record by the hash of its known field paths."""

    def __init__(self, layouts: Iterable[Layout]):
        self.paths = [(x, frozenset(field_paths(x.example))) for x in layouts]
        self.known = frozenset().union(*(p for _, p in self.paths))
        self.by_print: dict[str, Layout | None] = {fingerprint(p): x for x, p in self.paths}

    def of(self, record: dict) -> Layout | None:
        own = field_paths(record) & self.known
        key = fingerprint(own)
        if key not in self.by_print:
            fitting = [(len(p), -i) for i, (_, p) in enumerate(self.paths) if p <= own]
            self.by_print[key] = self.paths[-max(fitting)[1]][0] if fitting else None
        return self.by_print[key]


_MESSAGE = {"role": "", "content": ""}
LAYOUTS = (
    Layout("messages", {"messages": [_MESSAGE]}, turns="messages"),
    Layout("messages_empty", {"messages": []}, turns="messages"),
    Layout("from_value", {"conversations": [{"from": "", "value": ""}]}, turns="conversations", role_key="from",
           text_key="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_response", {"prompt": "", "response": ""}, (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", {"prompt": "", "completion": ""}, (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", {"question": "", "answer": ""}, (("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", {"instruction": "", "output": ""}, (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", {"instruction": "", "input": "", "output": ""},
           (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_prompt_response", {"system": "", "prompt": "", "response": ""},
           (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def write(turns: Iterable[tuple[str, str]], loss_roles: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns = []
    for piece in formatted.split(START)[1:]:
        head, _, body = piece.removesuffix(END).partition("\n")
        turns.append((unescape(head), unescape(body)))
    return turns


def format_chats(records: DataFrame, id_col: str = "conv_id", record_col: str = "record",
                 layouts: Iterable[Layout] = LAYOUTS, loss_roles: Iterable[str] = ("assistant",)) -> DataFrame:
    """(id, JSON record) to (id, mapping, formatted, loss_spans); one row per input row, no shuffle."""
    layouts, trained = tuple(layouts), frozenset(loss_roles)

    def one(raw: str | None, mappings: Mappings) -> tuple:
        layout, turns = None, []
        try:
            record = json.loads(raw) if raw else None
            layout = mappings.of(record) if isinstance(record, dict) else None
            turns = layout.read(record) if layout else []
        except (ValueError, RecursionError):
            layout = None
        formatted, spans = write(turns, trained)
        return layout and layout.name, formatted, [{"start": a, "stop": b} for a, b in spans]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mappings = Mappings(layouts)
        for pdf in batches:
            rows = [one(x, mappings) for x in pdf[record_col]]
            out = pd.DataFrame(rows, columns=["mapping", "formatted", "loss_spans"], index=pdf.index)
            yield pd.concat([pdf[[id_col]], out], axis=1)

    kind = records.schema[id_col].dataType.simpleString()
    return records.select(id_col, record_col).mapInPandas(
        run, f"{id_col} {kind}, mapping string, formatted string, loss_spans array<struct<start:long,stop:long>>")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one JSON record per conversation.

    A system-user-assistant triple gets a system field; the user-assistant pairs are dealt by a hash of conv_id to the
    layouts of two fields, or to instruction, input and output if the user's text has a blank line; everything else is
    a list of messages or, for every other conversation of the usual roles, of from-value turns.  A conversation
    is one training example, so its rows meet in one row of the result; rows without conv_id form one
    conversation of their own.
    """
    turns = F.array_sort(F.collect_list(F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    grouped = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("t"))
    grouped = grouped.withColumn("roles", F.transform("t", lambda x: x["role"])).withColumn("deal", F.pmod(F.xxhash64("conv_id"), F.lit(8)))
    shape = lambda *roles: F.col("roles") == F.array(*map(F.lit, roles))
    text = lambda i, name: F.get(F.col("t"), i)["content"].alias(name)
    record = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    user, at = F.get(F.col("t"), 0)["content"], F.instr(F.get(F.col("t"), 0)["content"], "\n\n")
    split = record(F.left(user, at - 1).alias("instruction"), F.substr(user, at + 2).alias("input"), text(1, "output"))
    pairs = [("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output")]
    pair = F.when((at > 0) & (F.col("deal") >= 4), split)
    for i, (a, b) in enumerate(pairs):
        pair = pair.when(F.col("deal") % 4 == i, record(text(0, a), text(1, b)))
    usual = F.forall("roles", lambda r: r.isin("system", "user", "assistant")) & (F.col("deal") % 2 == 1)
    named = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    conversation = F.transform("t", lambda x: F.struct(named(x["role"]).alias("from"), x["content"].alias("value")))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return grouped.select("conv_id", F.when(shape("user", "assistant"), pair).when(
        shape("system", "user", "assistant"), record(text(0, "system"), text(1, "prompt"), text(2, "response"))).when(
        usual, record(conversation.alias("conversations"))).otherwise(record(messages.alias("messages"))).alias("record"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the masked text, parsed from the formatted strings alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, spans in zip(pdf["formatted"], pdf["loss_spans"], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, index=pdf.index, columns=[
                "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([pdf[[id_col]], out], axis=1)

    kind = formatted.schema[id_col].dataType.simpleString()
    return formatted.select(id_col, "formatted", "loss_spans").mapInPandas(
        run, f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
