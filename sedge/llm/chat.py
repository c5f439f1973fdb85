"""Chat formatting: heterogeneous layouts to canonical turns by schema fingerprint, then a reversible template.

Only DataFrame functions are used. A layout is a declaration of the nested field paths it consists of. A frame, or each
JSON record, is matched to a layout by hashing those of its field paths that layouts know; other fields may be present.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sedge.llm.quality import let

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where turns are found.

    ``listed``: path of an array of messages with the fields ``role`` and ``text``. ``fields``: or (role, paths) pairs, one turn
    for each, its texts joined by a blank line; a path ending in ``?`` may be missing. ``rows``: or one row for each turn,
    with the columns (id, order, role, text). ``roles`` renames roles.
    """

    name: str
    listed: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str, str] | tuple = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def variants(self) -> list[frozenset[str]]:
        """The sets of paths that this layout shows, one for each choice of its optional paths."""
        if self.listed:
            return [frozenset({f"{self.listed}[].{self.role}", f"{self.listed}[].{self.text}"})]
        if self.rows:
            return [frozenset(self.rows)]
        paths = [p for _, group in self.fields for p in group]
        must, may = [p for p in paths if p[-1] != "?"], [p[:-1] for p in paths if p[-1] == "?"]
        return [frozenset([*must, *some]) for n in range(len(may) + 1) for some in combinations(may, n)]


LAYOUTS = (
    Layout("messages", listed="messages", role="role", text="content"),
    Layout("conversations", listed="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", fields=(("system", ("system?",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", fields=(("system", ("system?",)), ("user", ("instruction", "input?")), ("assistant", ("output",)))),
    Layout("rows", rows=("conv_id", "turn", "role", "text")),
)


def fingerprint(paths) -> str:
    """Hex SHA-256 of the sorted paths, one a line."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested paths of the leaves of a schema; ``[]`` stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _registry(layouts) -> dict[str, tuple[Layout, frozenset[str]]]:
    return {fingerprint(v): (layout, v) for layout in layouts for v in layout.variants()}


def layout_of(df: DataFrame, layouts=LAYOUTS) -> tuple[Layout, frozenset[str]]:
    """The layout of a typed frame, with the paths found.

    The fingerprint of all known paths decides; if extra columns bear known names, the largest layout whose own paths are
    all there. ValueError if there is none.
    """
    known, there = _registry(layouts), set(field_paths(df.schema))
    vocabulary = set().union(*(v for _, v in known.values()))
    if (found := known.get(fingerprint(there & vocabulary))) is not None:
        return found
    fitting = [x for key, x in known.items() if fingerprint(there & x[1]) == key]
    if not fitting:
        raise ValueError(f"no layout fits the fields {sorted(there)}")
    return max(fitting, key=lambda x: (len(x[1]), x[0].name))


def _role(layout: Layout, role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    for old, new in layout.roles.items():
        role = F.when(role == old, new).otherwise(role)
    return role


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _message(layout: Layout):
    return lambda x: _turn(_role(layout, x[layout.role]), x[layout.text])


def _prefixed(prefix: str):
    return lambda key: F.concat(F.lit(prefix), key)


def _field_turns(layout: Layout, there, value) -> Column:
    """Turns of a layout of single fields; a turn of an optional field that is absent or null is left out."""
    turns = []
    for role, group in layout.fields:
        paths = [p.rstrip("?") for p in group if p.rstrip("?") in there]
        if not paths:
            continue
        turn = _turn(F.lit(role), F.concat_ws("\n\n", *[F.when(value(p) != "", value(p)) for p in paths]))
        optional = all(p[-1] == "?" for p in group)
        turns.append(F.when(value(paths[0]).isNotNull(), F.array(turn)).otherwise(F.array().cast(TURNS)) if optional else F.array(turn))
    return F.concat(*turns)


def to_turns(df: DataFrame, layouts=LAYOUTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical turns (array of role and text) of a typed frame in any known layout, with the columns ``keep``.

    A layout of rows gives one row per id, ordered by its order column (null first), then role and text, so that ties and
    repeated rows have one result; its id column is kept. The turns of an id meet in one row, since one example is
    one row. Null role or text: empty. Null list: no turns.
    """
    layout, there = layout_of(df, layouts)
    if layout.rows:
        at, order, role, text = layout.rows
        rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), _role(layout, F.col(role)).alias("role"), F.coalesce(text, F.lit("")).alias("text"))))
        return df.groupBy(at).agg(rows.alias("_rows")).select(at, F.transform("_rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    if layout.listed:
        items = F.coalesce(F.col(layout.listed), F.array().cast(df.schema[layout.listed].dataType))
        turns = F.transform(items, _message(layout))
    else:
        turns = _field_turns(layout, there, F.col)
    return df.select(*keep, turns.cast(TURNS).alias("turns"))


def json_turns(df: DataFrame, record: str, layouts=LAYOUTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, layout and turns of JSON records whose layouts differ from row to row.

    Each record's fingerprint is computed from its own keys (of the first element for arrays). A record of no known
    layout, a null or malformed one gets a null layout and null turns.
    """
    known = {k: x for k, x in _registry(layouts).items() if not x[0].rows}
    vocabulary = sorted(set().union(*(v for _, v in known.values())))
    whole = F.col(record)
    paths = [F.coalesce(F.json_object_keys(whole), F.array().cast("array<string>"))]
    for listed in sorted({x.listed for x, _ in known.values() if x.listed}):
        inner = F.coalesce(F.json_object_keys(F.get_json_object(whole, f"$.{listed}[0]")), F.array().cast("array<string>"))
        paths.append(F.transform(inner, _prefixed(f"{listed}[].")))
    own = F.sort_array(F.array_intersect(F.concat(*paths), F.array(*map(F.lit, vocabulary))))
    found = df.withColumn("_print", F.sha2(F.array_join(own, "\n"), 256))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for key, (layout, there) in known.items():
        if layout.listed:
            items = F.from_json(F.get_json_object(whole, f"$.{layout.listed}"), f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
            own = F.transform(items, _message(layout))
        else:
            own = _field_turns(layout, there, lambda p: F.get_json_object(whole, f"$.{p}"))
        name = F.when(F.col("_print") == key, layout.name).otherwise(name)
        turns = F.when(F.col("_print") == key, own.cast(TURNS)).otherwise(turns)
    return found.select(*keep, name.alias("layout"), turns.alias("turns"))


@dataclass(frozen=True)
class Template:
    """A turn is written start, role, middle, text, end. ``control`` lists the strings that no role or text may show unescaped."""

    start: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def escape(self, text: Column) -> Column:
        r"""Double every backslash, then put one behind the first character of each control string."""
        ahead = "|".join(map(re.escape, self.control))
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?s)(?={ahead})(.)", r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def pieces(self, formatted: Column) -> Column:
        """The formatted turns, without their ends."""
        parts = F.split(formatted, re.escape(self.end))
        return let(parts, lambda p: F.slice(p, 1, F.size(p) - 1))

    def parse(self, formatted: Column) -> Column:
        """Turns read back from formatted text."""

        def turn(piece):
            return let(F.split(piece, re.escape(self.middle), 2), lambda x: F.struct(self.unescape(F.substring(x[0], len(self.start) + 1, 2**31 - 1)).alias("role"), self.unescape(x[1]).alias("text")))

        return F.transform(self.pieces(formatted), turn)

    def masked(self, formatted: Column, mask: Column) -> Column:
        """The unescaped text under the loss mask."""
        return let(self.pieces(formatted), lambda p: F.array_join(F.transform(mask, lambda m: self.unescape(F.substring(F.get(p, m["turn"]), m["start"] + 1, m["length"]))), ""))


def format_chat(df: DataFrame, template: Template = Template(), learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``loss_mask`` to a frame with ``turns``.

    The mask is an array of (turn, start, length): code points within that turn's formatted piece, covering the escaped texts
    of the roles in ``learned``. Null turns count as none: an empty text and mask.
    """
    turns = F.coalesce(F.col("turns"), F.array().cast(TURNS))
    safe = df.withColumn("_safe", F.transform(turns, lambda t: F.struct(template.escape(F.coalesce(t["role"], F.lit(""))).alias("role"), template.escape(F.coalesce(t["text"], F.lit(""))).alias("text"), F.coalesce(t["role"].isin(*learned), F.lit(False)).alias("learned"))))
    piece = lambda t: F.concat(F.lit(template.start), t["role"], F.lit(template.middle), t["text"], F.lit(template.end))
    spans = F.transform(F.col("_safe"), lambda t, i: F.struct(i.alias("turn"), (F.length(t["role"]) + len(template.start) + len(template.middle)).alias("start"), F.length(t["text"]).alias("length"), t["learned"].alias("learned")))
    mask = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    return safe.withColumn("formatted", F.array_join(F.transform("_safe", piece), "")).withColumn("loss_mask", mask).drop("_safe")


def chat_digest(df: DataFrame, at: str = "conv_id", template: Template = Template()) -> DataFrame:
    """Per example, read back from its formatted text and mask: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = df.select(at, "formatted", template.parse(F.col("formatted")).alias("_turns"), template.masked(F.col("formatted"), F.col("loss_mask")).alias("_loss"))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        at,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
