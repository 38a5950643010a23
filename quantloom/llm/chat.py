"""Chat formatting by schema fingerprints.

Records of chats come in many layouts. A record's nested field paths (those
that some layout knows) are hashed; the hash selects a declarative mapping,
which tells where the turns are, who speaks and what is said. What comes out
are canonical turns, a row each, so that a chat of any length is no single row.
A template then marks turns; control strings inside of roles and texts get a
backslash after their first character, one more if they have some already, so
that only marks are control strings and every text can be read back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Turn:
    """Where turns are: the paths of text (several are joined by an empty line) and
    of the role, or the role itself (`says`), in the record or in each item of a list."""

    text: tuple[str, ...]
    role: str | None = None
    says: str | None = None
    each: str | None = None
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """A layout is told by its paths; some of `may` can be missing."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Turn, ...]
    may: tuple[str, ...] = ()

    def known(self) -> Iterator[frozenset[str]]:
        for n in range(len(self.may) + 1):
            for some in combinations(self.may, n):
                if self.paths or some:
                    yield frozenset((*self.paths, *some))


#: Other names of speakers.
NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
SYSTEM = Turn(("system",), says="system")


def _asked(name: str, asked: tuple[str, ...], answer: str, may: tuple[str, ...] = ()) -> Layout:
    return Layout(name, (asked[0], answer), (SYSTEM, Turn(asked, says="user"), Turn((answer,), says="assistant")), ("system", *may))


LAYOUTS = (
    Layout("turn", ("role", "text"), (Turn(("text",), "role"),)),
    Layout("message", ("role", "content"), (Turn(("content",), "role"),)),
    Layout("speech", ("from", "value"), (Turn(("value",), "from", names=NAMES),)),
    Layout("export", ("message.author.role", "message.content.parts[]"), (Turn(("message.content.parts[]",), "message.author.role"),)),
    Layout("speakers", (), (SYSTEM, Turn(("user",), says="user"), Turn(("assistant",), says="assistant")), ("system", "user", "assistant")),
    Layout("messages", ("messages[].role", "messages[].content"), (Turn(("content",), "role", each="messages"),)),
    Layout("message_parts", ("messages[].role", "messages[].content[].text"), (Turn(("content[].text",), "role", each="messages"),), ("messages[].content[].type",)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (SYSTEM, Turn(("value",), "from", each="conversations", names=NAMES)), ("system",)),
    _asked("prompt_completion", ("prompt",), "completion"),
    _asked("prompt_response", ("prompt",), "response"),
    _asked("question_answer", ("question",), "answer"),
    _asked("instruction", ("instruction", "input"), "output", ("input",)),
)


def paths(x, at: str = "") -> Iterator[str]:
    """The paths of a value's leaves: names joined by dots, [] for the items of a list."""
    if isinstance(x, dict):
        for k, v in x.items():
            k = re.sub(r"([\\.\[])", r"\\\1", k)
            yield from paths(v, f"{at}.{k}" if at else k)
    elif isinstance(x, list):
        for v in x:
            yield from paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(found: frozenset[str] | set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(found)).encode())


def _values(x, steps: list[str]) -> Iterator[str]:
    """The leaves under a path, as text; null is empty."""
    if not steps:
        yield x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    elif steps[0] == "[]":
        for v in x if isinstance(x, list) else ():
            yield from _values(v, steps[1:])
    elif isinstance(x, dict) and steps[0] in x:
        yield from _values(x[steps[0]], steps[1:])


def _steps(path: str) -> list[str]:
    return re.findall(r"\[\]|[^.\[\]]+", path)


def _sound(s: str) -> str:
    """Halves of surrogate pairs, which JSON may hold and no text can, become U+FFFD."""
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Mappings:
    """Layouts by fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.words = frozenset(p for x in layouts for p in (*x.paths, *x.may))
        self.of: dict[int, Layout] = {}
        for x in layouts:
            for some in x.known():
                if self.of.setdefault(fingerprint(some), x) is not x:
                    raise ValueError(f"layouts {x.name} and {self.of[fingerprint(some)].name} can't be told apart")
        self.steps = {p: _steps(p) for x in layouts for t in x.turns for p in (*t.text, *filter(None, (t.role, t.each)))}

    def turns(self, record: str | None) -> tuple[int | None, str | None, list[tuple[str, str]]]:
        """Fingerprint, layout's name and turns (role, text); no name if none is known."""
        try:
            x = json.loads(record)
        except (TypeError, ValueError, RecursionError):
            return None, None, []
        print_ = fingerprint(self.words.intersection(paths(x)))
        layout = self.of.get(print_)
        if not layout:
            return print_, None, []
        out = []
        for t in layout.turns:
            items = [x] if t.each is None else x.get(t.each) or []
            for item in items:
                texts = [v for p in t.text for v in _values(item, self.steps[p])]
                if not texts:  # a field that may be missing
                    continue
                role = t.says if t.role is None else next(_values(item, self.steps[t.role]), "")
                some = [v for v in texts if v] if len(texts) > 1 else texts
                out.append((_sound(dict(t.names).get(role, role)), _sound("\n\n".join(some))))
        return print_, layout.name, out


def canonical(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The turns of records (JSON text): the other columns of records, fingerprint,
    layout, place (from 0, within the record), role, text.

    Columns of those names are replaced. Fields that no layout knows don't count.
    A record without a known layout, without turns, of null or of broken JSON
    gives one row whose place, role and text are null, so none is lost. Repeated
    records give their turns each; turns with null texts have empty ones.
    """
    new = "fingerprint string, layout string, place int, role string, text string"
    made = StructType.fromDDL(new)
    own = [c for c in records.columns if c != record_col and c not in made.names]
    source = records.select(F.col(f"`{record_col}`").cast("string").alias("record"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Mappings(layouts)
        for b in batches:
            at, rows = [], []
            for i, r in enumerate(b.column(0)):
                print_, name, turns = known.turns(r.as_py())
                print_ = None if print_ is None else f"{print_:016x}"
                found = [(print_, name, k, *t) for k, t in enumerate(turns)] or [(print_, name, None, None, None)]
                at += [i] * len(found)
                rows += found
            kept = b.take(pa.array(at, pa.int32()))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*kept.columns[1:], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*kept.schema.names[1:], *made.names])

    found = source.mapInArrow(each, StructType([*source.schema.fields[1:], *made.fields]))
    return found.toDF(*own, *made.names)


@dataclass(frozen=True)
class Template:
    """Marks of a turn: begin, role, line end, text, end. learn: roles whose texts are under the loss mask."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    learn: tuple[str, ...] = ("assistant",)
    #: Control strings of public chat templates, none of which may come from a text.
    controls: tuple[str, ...] = (
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
        "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )

    def __post_init__(self):
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")
        for a in self.controls:  # a backslash put into one must not change another
            for i in range(1, len(a)):
                for c in self.controls if a[i] in self._heads() else ():
                    rest, tail = a[i + 1 :], c[1:]
                    if rest.startswith(tail) or tail.startswith(rest):
                        raise ValueError(f"control strings {a} and {c} overlap")

    def _heads(self) -> str:
        return "".join(sorted({c[0] for c in self.controls}))

    def _pattern(self) -> str:
        quoted = lambda s: re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", s)
        return "([" + "".join(map(quoted, self._heads())) + "])%s(\\\\*(?:" + "|".join(map(quoted, sorted({c[1:] for c in self.controls}))) + "))"

    def escaped(self, c: Column) -> Column:
        return F.regexp_replace(c, self._pattern() % "", r"$1\\$2")

    def plain(self, c: Column) -> Column:
        """escaped() undone."""
        return F.regexp_replace(c, self._pattern() % r"\\", "$1$2")


def formatted(turns: DataFrame, template: Template = Template(), role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with formatted (the turn in its marks), mask_start and mask_end: the
    text under the loss mask, in code points of formatted, end exclusive; null
    for turns that aren't learned. Columns of those names are replaced, null
    roles and texts are empty. A chat is its turns' texts one after another."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    # a line end ends the role, so those inside are named, and backslashes doubled
    named = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    text = template.escaped(F.coalesce(F.col(text_col), F.lit("")))
    start = F.char_length("_head")
    out = turns.withColumns({"_head": F.concat(F.lit(template.begin), template.escaped(named), F.lit("\n")), "_text": text})
    learn = role.isin(*template.learn)
    own = [c for c in turns.columns if c not in ("formatted", "mask_start", "mask_end")]
    return out.select(
        *[F.col(f"`{c}`") for c in own],
        F.concat("_head", "_text", F.lit(template.end)).alias("formatted"),
        F.when(learn, start).alias("mask_start"),
        F.when(learn, start + F.char_length("_text")).alias("mask_end"),
    )


def role_of(template: Template = Template(), piece: str = "formatted") -> Column:
    """The role, read back from a formatted turn."""
    head = F.substring_index(F.substring(piece, len(template.begin) + 1, 2**31 - 1), "\n", 1)
    halves = F.split(template.plain(head), r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def text_of(template: Template = Template(), piece: str = "formatted") -> Column:
    """The text, read back from a formatted turn."""
    inner = F.substring(piece, len(template.begin) + 1, 2**31 - 1)
    text = F.substring(inner, F.char_length(F.substring_index(inner, "\n", 1)) + 2, F.lit(2**31 - 1))
    return template.plain(F.substring(text, F.lit(1), F.char_length(text) - len(template.end)))


def learned(template: Template = Template(), piece: str = "formatted") -> Column:
    """The text under the loss mask, without escapes; null outside of it."""
    return template.plain(F.substring(piece, F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start")))
