"""Chat formatting by schema fingerprinting, with DataFrame functions only.

A layout is a declarative mapping: the nested field paths it needs and where roles and texts stand. All nested field
paths of a schema (or, for JSON records, of each record) are read; for each layout those that it knows are sorted and
hashed, and the layout whose own fingerprint comes out fits. Of the layouts that fit, the one with the most paths is
selected, so extra fields change nothing. None that fits, or two of most paths, is an error for a schema and gives no
turns for a JSON record; tables with a row per turn take the first layout listed that fits.

Null roles and texts count as empty, texts of any length and repeated rows are kept, rows of a conversation stand by
turn, then role, then text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """kind "list": paths (role, text) below the array `at`; "fields": (role, path) in order; "rows": one row a turn."""

    name: str
    kind: str
    turns: tuple[tuple[str, str], ...]
    at: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> list[str]:
        if self.kind == "fields":
            return sorted(p for _, p in self.turns)
        (role, text), = self.turns
        return sorted(f"{self.at}[].{x}" if self.kind == "list" else x for x in (role, text))


_ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("messages", "list", (("role", "content"),), "messages", _ALIASES),
    Layout("share", "list", (("from", "value"),), "conversations", _ALIASES),
    Layout("dialog", "list", (("speaker", "text"),), "dialog", _ALIASES),
    Layout("instruction_input", "fields", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", "fields", (("user", "instruction"), ("assistant", "output"))),
    Layout("system_prompt", "fields", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_response", "fields", (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", "fields", (("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", "fields", (("user", "question"), ("assistant", "answer"))),
    Layout("rows", "rows", (("role", "text"),)),
    Layout("rows_content", "rows", (("role", "content"),), "", _ALIASES),
    Layout("rows_share", "rows", (("from", "value"),), "", _ALIASES),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; [] stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str], layout: Layout | None = None) -> str:
    """Hash of the paths, or of those of them that a layout knows."""
    return hashlib.sha256("\n".join(sorted(p for p in set(paths) if layout is None or p in layout.paths)).encode()).hexdigest()


#: fingerprint -> layout
REGISTRY = {fingerprint(x.paths): x for x in LAYOUTS}


def select_layout(paths: list[str], kinds: tuple[str, ...]) -> Layout:
    """The most specific layout of these kinds that the paths hold; of layouts for rows the one listed first."""
    fit = [x for x in LAYOUTS if x.kind in kinds and REGISTRY.get(fingerprint(paths, x)) is x]
    best = [x for x in fit if len(x.paths) == max(len(y.paths) for y in fit)]
    if best and best[0].kind == "rows":
        return best[0]
    if len(best) != 1:
        raise ValueError(f"{'no layout' if not best else 'more than one layout'} for {sorted(paths)}")
    return best[0]


def _role(c: Column, layout: Layout) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for old, new in layout.roles.items():
        c = F.when(c == old, new).otherwise(c)
    return c


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def canonical_turns(df: DataFrame, out_col: str = "turns") -> DataFrame:
    """df with out_col, an array of (role, text), by the layout that the schema's fingerprint selects.

    For rows of one turn each use format_rows(). An optional field that is null or empty (an instruction's input) gives no turn."""
    layout = select_layout(field_paths(df.schema), ("list", "fields"))
    if layout.kind == "list":
        return df.withColumn(out_col, F.coalesce(_listed(F.col(f"`{layout.at}`"), layout), F.array().cast(TURN)))
    return df.withColumn(out_col, _fields([(r, F.col(f"`{p}`")) for r, p in layout.turns]))


def _listed(c: Column, layout: Layout) -> Column:
    (role, text), = layout.turns
    return F.transform(c, lambda x: F.struct(_role(x[role], layout).alias("role"), _text(x[text]).alias("text")))


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    """One turn a field; neighbours of one role are joined by an empty line, empty optional ones go."""
    turns: list[tuple[str, list[Column]]] = []
    for role, c in pairs:
        if turns and turns[-1][0] == role:
            turns[-1][1].append(c)
        else:
            turns.append((role, [c]))
    one = lambda cs: _text(cs[0]) if len(cs) == 1 else F.concat_ws("\n\n", *[F.nullif(_text(c), F.lit("")) for c in cs])
    made = [F.when(F.lit(r != "system") | (one(cs) != ""), F.struct(F.lit(r).alias("role"), one(cs).alias("text"))) for r, cs in turns]
    return F.filter(F.array(*made), lambda x: x.isNotNull()).cast(TURN)


def json_turns(df: DataFrame, json_col: str, out_col: str = "turns") -> DataFrame:
    """Records of mixed layouts in one JSON column: the fingerprints of each record's own paths select its mapping; other
    keys, in list elements too, are passed over.

    Null and unreadable records, unknown layouts and records that fit two layouts equally give null."""
    layouts = sorted((x for x in LAYOUTS if x.kind != "rows"), key=lambda x: len(x.paths))
    d, record = df.withColumn("__record", F.try_parse_json(F.col(f"`{json_col}`"))), F.col("__record")
    known = {p: F.when(_has(record, p), F.lit(p)) for p in sorted({p for x in layouts for p in x.paths})}
    print_of = lambda x: F.sha2(F.array_join(F.array_compact(F.array(*[known[p] for p in x.paths])), "\n"), 256)
    d = d.withColumn("__fits", F.array(*[print_of(x) == fingerprint(x.paths) for x in layouts]))
    fits = [F.get("__fits", F.lit(i)) for i in range(len(layouts))]
    size = F.greatest(F.lit(0), *[F.when(f, F.lit(len(x.paths))) for f, x in zip(fits, layouts, strict=True)])
    d = d.withColumn("__size", size)
    turns, n = F.lit(None).cast(TURN), F.lit(0)
    for f, layout in zip(fits, layouts, strict=True):
        if layout.kind == "list":
            (role, text), = layout.turns
            value = _listed(F.try_variant_get(record, f"$.{layout.at}", f"array<struct<`{role}`:string,`{text}`:string>>"), layout)
        else:
            value = _fields([(r, F.try_variant_get(record, f"$.{p}", "string")) for r, p in layout.turns])
        best = f & (F.col("__size") == len(layout.paths))
        turns, n = F.when(best, value).otherwise(turns), n + F.coalesce(best, F.lit(False)).cast("int")
    return d.withColumn(out_col, F.when(n == 1, turns)).drop("__record", "__fits", "__size")


def _has(record: Column, path: str) -> Column:
    """Whether a record has a plain value at a layout's path; an empty list has all paths below it."""
    kind = lambda v, name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(""))
    plain = lambda k: ~k.startswith("OBJECT") & ~k.startswith("ARRAY")
    at, _, name = path.rpartition("[].")
    if not at:
        return (kind(record, name) != "") & plain(kind(record, name))
    items = F.try_variant_get(record, f"$.{at}", "array<variant>")
    objects = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")).rlike("^(OBJECT|VOID)"))
    some = (F.size(items) == 0) | F.exists(items, lambda x: kind(x, name) != "")
    return F.coalesce(objects & some & F.forall(items, lambda x: plain(kind(x, name))), F.lit(False))


# Template: <|turn:ROLE|>\nTEXT<|end|>\n ; inside roles and texts \ is doubled and the bars of <| and |> get a \.
OPEN, HEAD_END, END = "<|turn:", "|>\n", "<|end|>\n"


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<|", "<\\|"), ("|>", "|\\>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("|\\>", "|>"), ("<\\|", "<|"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of a table with a row per turn: formatted, and loss_spans, the (start, length) in code
    points of what is learned. One shuffle, by conversation; a conversation is one training text, so its rows meet.

    Rows with a null conversation id form one conversation."""
    layout = select_layout(field_paths(rows.schema), ("rows",))
    (role, text), = layout.turns
    t = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), _role(F.col(f"`{role}`"), layout).alias("role"), _text(F.col(f"`{text}`")).alias("text"))
    t = t.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END))).withColumn("body", escape(F.col("text")))
    t = t.withColumn("segment", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.select("conv_id", before.alias("at"), "segment", (before + F.length("head")).alias("start"), F.length("body").cast("long").alias("size"), F.col("role").isin(*learn).alias("learn"))
    all_of = F.sort_array(F.collect_list(F.struct("at", "segment", "start", "size", "learn")))
    return t.groupBy("conv_id").agg(all_of.alias("all")).select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x.segment), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x.learn), lambda x: F.struct(x.start.alias("start"), x["size"].alias("size"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    parts = F.split(formatted, "\\Q" + END + "\\E", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, HEAD_END, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(x, F.length(head) + len(HEAD_END) + 1)).alias("text"))

    return F.transform(parts, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s["size"].cast("int")))), "")


def chat_digests(rows: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations."""
    f = format_rows(rows)
    f = f.select("conv_id", parse(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    canonical = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return f.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(canonical, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )
