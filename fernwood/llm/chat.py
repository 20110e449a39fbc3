"""Chat formatting: records of unlike layouts become canonical turns, and turns become marked text with a loss mask.

A record is JSON. Its nested field paths (``messages[]``, ``messages[].role``, ``prompt``: keys down to two levels, ``[]`` after
lists, ``{}`` after objects) are listed, those that no layout knows are left out, and the sorted rest is hashed: the record's fingerprint.
Every layout states which paths it has and which of them may lack, so its fingerprints are known beforehand, and one look-up
finds the mapping that turns the record into (role, text) pairs. Records of equal shape share a fingerprint whatever they hold.

A template marks every turn: an opening mark, the role (URL-encoded), a mark after it, the escaped text, a closing mark. Inside texts a backslash
is put after each backslash and after the first character of each control string. So no text holds a control string, and taking out the first
backslash of each pair restores it. The output is a list of segments with a loss flag, whose concatenation is the formatted text: the
mask covers assistant texts and nothing else. ``read_back`` makes turns of the formatted text alone.

All of this is column code: no Python runs on rows, nothing is shuffled. A record is one value, however long its conversation.

Defined cases: JSON that is null, broken or no object, and records whose fingerprint no layout has (fields of two layouts at once, say), have null layout, turns and
segments; fields that no layout knows are ignored; null or missing roles and texts are empty; numbers and booleans as texts are written as
in JSON; texts given as lists of parts are joined; an empty message list has no turns, formatted as an empty text; empty texts keep
their turn; repeated rows count each; no rows give none; other columns stay, and one named like a result gives way to it.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKED_ROLE = "assistant"


@dataclass(frozen=True)
class Field:
    """One turn from one field, and from a second one after a blank line, if that is there and not empty."""

    path: str
    role: str
    optional: bool = False
    second: str = ""

    def shapes(self) -> list[set[str]]:
        with_it = [{self.path}, {self.path, self.second}] if self.second else [{self.path}]
        return [*with_it, set()] if self.optional else with_it

    def turns(self, record: Column) -> Column:
        text = F.coalesce(_string(record, self.path), F.lit(""))
        if self.second:
            more = _string(record, self.second)
            text = F.when(more != "", F.concat(text, F.lit("\n\n"), more)).otherwise(text)
        turn = F.array(F.struct(F.lit(self.role).alias("role"), text.alias("text")))
        return F.when(F.try_variant_get(record, f"$.{self.path}", "variant").isNotNull(), turn).otherwise(F.slice(turn, 1, 0)) if self.optional else turn


@dataclass(frozen=True)
class Messages:
    """One turn from every element of a list."""

    path: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)

    def shapes(self) -> list[set[str]]:
        inner = [f"{self.path}[].{self.role}", f"{self.path}[].{self.text}", f"{self.path}[].{self.text}[]"]
        return [{f"{self.path}[]", *some} for n in range(4) for some in itertools.combinations(inner, n)]

    def turns(self, record: Column) -> Column:
        def turn(m: Column) -> Column:
            role = F.coalesce(_string(m, self.role), F.lit(""))
            for theirs, ours in self.roles.items():
                role = F.when(role == theirs, ours).otherwise(role) if theirs != ours else role
            parts = F.try_variant_get(m, f"$.{self.text}", "array<variant>")
            joined = F.array_join(F.transform(parts, lambda p: F.coalesce(_string(p, "text"), F.lit(""))), "")
            return F.struct(role.alias("role"), F.coalesce(joined, _string(m, self.text), F.lit("")).alias("text"))

        return F.transform(F.try_variant_get(record, f"$.{self.path}", "array<variant>"), turn)


@dataclass(frozen=True)
class Layout:
    """A mapping of records to turns: its parts in the order of their turns."""

    name: str
    parts: tuple[Field | Messages, ...]

    def fingerprints(self) -> set[str]:
        return {digest(set().union(*shape)) for shape in itertools.product(*(p.shapes() for p in self.parts))}

    def turns(self, record: Column) -> Column:
        return F.concat(*(p.turns(record) for p in self.parts))


#: Field names of the usual layouts.
LAYOUTS = (
    Layout("messages", (Messages("messages", "role", "content"),)),
    Layout("from_value", (Field("system", "system", optional=True), Messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"}))),
    Layout("instruction", (Field("system", "system", optional=True), Field("instruction", "user", second="input"), Field("output", "assistant"))),
    Layout("prompt_completion", (Field("system", "system", optional=True), Field("prompt", "user"), Field("completion", "assistant"))),
    Layout("prompt_response", (Field("system", "system", optional=True), Field("prompt", "user"), Field("response", "assistant"))),
    Layout("question_answer", (Field("system", "system", optional=True), Field("question", "user"), Field("answer", "assistant"))),
    Layout("message_pair", (Messages("prompt", "role", "content"), Messages("completion", "role", "content"))),
)


@dataclass(frozen=True)
class Template:
    opening: str = "<s>"
    after_role: str = "\n"
    closing: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def __post_init__(self) -> None:
        marks = (self.opening, self.closing)
        if any(len(c) < 2 or "\\" in c for c in self.control) or not set(marks) <= set(self.control):
            raise ValueError("control strings have two characters or more and no backslash, and the marks of turns are among them")
        if any(self.closing[i:] == self.closing[: len(self.closing) - i] for i in range(1, len(self.closing))) or not re.fullmatch(r"[^A-Za-z0-9.*_%+-]+", self.after_role):
            raise ValueError("the closing mark must not begin as it ends, and the mark after roles must not look like one")

    def escaped(self, text: Column) -> Column:
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(set(self.control)))
        return F.regexp_replace(text, rf"\\|{starts}", r"$0\\")

    @staticmethod
    def restored(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def segments(self, turns: Column) -> Column:
        """The formatted text in segments (text, loss)."""

        def turn(t: Column) -> Column:
            opening = F.concat(F.lit(self.opening), F.url_encode(t["role"]), F.lit(self.after_role))
            body = F.struct(self.escaped(t["text"]).alias("text"), (t["role"] == MASKED_ROLE).alias("loss"))
            return F.array(F.struct(opening.alias("text"), F.lit(False).alias("loss")), body, F.struct(F.lit(self.closing).alias("text"), F.lit(False).alias("loss")))

        return F.flatten(F.transform(turns, turn))

    def read_back(self, formatted: Column) -> Column:
        """Turns (role, text) of a formatted text."""
        pieces = F.split(formatted, re.escape(self.closing))

        def turn(piece: Column) -> Column:
            at = F.instr(piece, self.after_role)
            role = F.url_decode(F.substring(piece, F.lit(len(self.opening) + 1), at - len(self.opening) - 1))
            return F.struct(role.alias("role"), self.restored(F.substring(piece, at + len(self.after_role), F.length(piece))).alias("text"))

        return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def digest(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _string(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _marked(at: Column, v: Column) -> Column:
    return F.concat(at, F.when(_elements(v).isNotNull(), "[]").when(_members(v).isNotNull(), "{}").otherwise(""))


def field_paths(record: Column) -> Column:
    """The sorted nested field paths of a record (a variant); null if it is no object."""

    none = F.array().cast("array<string>")

    def inner(at: Column, members: Column) -> Column:
        return F.coalesce(F.transform(F.map_entries(members), lambda e: _marked(F.concat(at, F.lit("."), e["key"]), e["value"])), none)

    def outer(e: Column) -> Column:
        at = _marked(e["key"], e["value"])
        objects = F.coalesce(_elements(e["value"]), F.array(e["value"]))
        return F.concat(F.array(at), F.flatten(F.transform(objects, lambda x: inner(at, _members(x)))))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries(_members(record)), outer))))


def canonical(records: DataFrame, *, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with fingerprint, layout and turns (role, text)."""
    known = sorted({p for one in layouts for part in one.parts for shape in part.shapes() for p in shape})
    table = {print_: one.name for one in layouts for print_ in one.fingerprints()}
    if len(table) != sum(len(one.fingerprints()) for one in layouts):
        raise ValueError("two layouts share a fingerprint")
    parsed = F.try_parse_json(F.col(record))
    fingerprint = F.left(F.sha2(F.array_join(F.array_intersect(F.col("chat__paths"), F.array(*map(F.lit, known))), "\n"), 256), F.lit(16))
    layout = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair)), F.col("chat__print"))
    turns = F.lit(None)
    for one in layouts:
        turns = F.when(F.col("chat__layout") == one.name, one.turns(F.col("chat__record"))).otherwise(turns)
    stay = [c for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    read = records.withColumn("chat__record", parsed).withColumn("chat__paths", field_paths(F.col("chat__record"))).withColumn("chat__print", fingerprint).withColumn("chat__layout", layout)
    return read.select(*(F.col(f"`{c}`") for c in stay), F.col("chat__print").alias("fingerprint"), F.col("chat__layout").alias("layout"), turns.alias("turns"))


def formatted(turned: DataFrame, *, template: Template = Template()) -> DataFrame:  # noqa: B008 - frozen
    """``turned`` with segments (text, loss) and formatted, their concatenation."""
    stay = [F.col(f"`{c}`") for c in turned.columns if c not in ("segments", "formatted")]
    return turned.select(*stay, template.segments(F.col("turns")).alias("segments")).withColumn("formatted", F.array_join("segments.text", ""))


def records_of_turns(rows: DataFrame) -> DataFrame:
    """conv_id, record: a log of turns (conv_id, turn, role, text) as JSON, each conversation in the layout that data of its form come in.

    A lone question and answer is a prompt with its completion, with a system text before them an instruction with its output, any other
    conversation a list of messages. Turns of one number are ordered by role and text; null texts and roles are empty.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_conversation = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    text = [F.get("t.text", F.lit(i)) for i in range(3)]
    roles = F.array_join("t.role", "\n")
    pair = F.to_json(F.struct(text[0].alias("prompt"), text[1].alias("completion")))
    task = F.to_json(F.struct(text[0].alias("system"), text[1].alias("instruction"), text[2].alias("output")))
    chat = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    return by_conversation.select("conv_id", F.when(roles == "user\nassistant", pair).when(roles == "system\nuser\nassistant", task).otherwise(chat).alias("record"))


def digest_columns(out: DataFrame, *, template: Template = Template()) -> DataFrame:  # noqa: B008 - frozen
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and layout, all read back from the formatted output."""
    turns = template.read_back(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.restored(s["text"])), "")
    back = out.select("conv_id", "layout", "formatted", turns.alias("back"), loss.alias("loss"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout")
