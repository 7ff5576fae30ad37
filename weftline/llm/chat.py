"""Chat formatting by schema fingerprints. DataFrame functions only.

Records of conversations come in many layouts: prompt and completion, instruction with input and output, lists of messages, a row
for each turn. A record's layout is the nested paths of its fields, in one canonical text without the values' types; its hash is
the fingerprint. Layouts that are known are declared (``LAYOUTS``): their shape, and where roles, texts, the conversation's key
and a turn's place are found. A record's fingerprint selects the mapping, which makes it canonical turns (role, text). What has
another fingerprint is kept, without turns, and reported by ``unknown_layouts``, so that a layout can be declared for it.

A table with columns has one layout for all rows, known from its schema when the plan is made; JSON records have theirs each.

Turns are then written between marks, control strings inside texts escaped so that they can be read back, and the mask of the
loss is kept as spans of code points. A conversation is one row of the result, so its turns come together once, by its key, unless
a record has them all: then nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from weftline.functions.arrays import sums_before

#: The marks of a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Roles that stand for others in lists of messages.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_SCALAR = r"(?<=: |ARRAY<|^)(?:STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>]|$)"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Each:
    """Turns that are the items of a list: its path, and the fields of an item."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """A layout: nested field names (None for a value, a list of one shape for a list), and how its turns are found.

    turns: pairs of a role and the paths whose texts, unless empty, make up its text; a turn whose fields are all missing is none.
    row: (role, text) paths of a record that is one turn; it needs ``key`` and ``place``. optional: top fields that may be missing.
    """

    name: str
    shape: dict
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: Each | None = None
    row: tuple[str, str] | None = None
    key: str | None = None
    place: str | None = None
    optional: tuple[str, ...] = ()


def _pairs(name: str, user: str, assistant: str) -> Layout:
    return Layout(name, {"id": None, "system": None, user: None, assistant: None}, (("system", ("system",)), ("user", (user,)), ("assistant", (assistant,))), key="id", optional=("id", "system"))


LAYOUTS = (
    Layout("turn_rows", {"conv_id": None, "turn": None, "role": None, "text": None}, row=("role", "text"), key="conv_id", place="turn"),
    _pairs("prompt_completion", "prompt", "completion"),
    _pairs("prompt_response", "prompt", "response"),
    _pairs("question_answer", "question", "answer"),
    Layout("instruction", {"id": None, "system": None, "instruction": None, "input": None, "output": None}, (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), key="id", optional=("id", "system", "input")),
    Layout("messages", {"id": None, "messages": [{"role": None, "content": None}]}, each=Each("messages", "role", "content"), key="id", optional=("id",)),
    Layout("nested_messages", {"id": None, "conversation": {"messages": [{"role": None, "content": None}]}}, each=Each("conversation.messages", "role", "content"), key="id", optional=("id",)),
    Layout("from_value", {"id": None, "system": None, "conversations": [{"from": None, "value": None}]}, (("system", ("system",)),), each=Each("conversations", "from", "value"), key="id", optional=("id", "system")),
)


def _quoted(name: str) -> str:
    return name if name.replace("_", "").isalnum() and name.isascii() else "`" + name.replace("`", "``") + "`"


def shape_text(shape: dict | list | None) -> str:
    """A shape's canonical text: names in order, ``_`` for a value."""
    if shape is None:
        return "_"
    if isinstance(shape, list):
        return f"ARRAY<{shape_text(shape[0]) if shape else '_'}>"
    return f"OBJECT<{', '.join(f'{_quoted(k)}: {shape_text(shape[k])}' for k in sorted(shape))}>"


def shape_of(kind: DataType) -> dict | list | None:
    """The shape of a column's type."""
    if isinstance(kind, StructType):
        return {f.name: shape_of(f.dataType) for f in kind.fields}
    return [shape_of(kind.elementType)] if isinstance(kind, ArrayType) else None


def record_layout(record: Column) -> Column:
    """The layout of a variant, as ``shape_text`` writes it."""
    return F.regexp_replace(F.schema_of_variant(record), _SCALAR, "_")


def fingerprint(layout: Column) -> Column:
    return F.xxhash64(layout)


def known_texts(layouts: tuple[Layout, ...]) -> dict[str, str]:
    """The name of the layout for each text of a shape: without any of its optional fields, and with its list empty, too."""
    out: dict[str, str] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for gone in combinations(layout.optional, n):
                shape = {k: v for k, v in layout.shape.items() if k not in gone}
                texts = [shape_text(shape)]
                if layout.each:
                    inner = f"ARRAY<{shape_text({layout.each.role: None, layout.each.text: None})}>"
                    texts.append(texts[0].replace(inner, "ARRAY<_>"))
                for text in texts:
                    if out.setdefault(text, layout.name) != layout.name:
                        raise ValueError(f"{out[text]} and {layout.name} have the same fields")
    return out


def _turns(layout: Layout, there: Callable[[str], bool], get: Callable[[str], Column], items: Callable[[Each], Column], roles: dict[str, str]) -> Column:
    """The canonical turns of a record of this layout; ``there`` says which fields can be read, ``get`` reads a text."""
    parts = []
    if layout.row:
        parts.append(F.array(F.struct(F.coalesce(get(layout.row[0]), F.lit("")).alias("role"), F.coalesce(get(layout.row[1]), F.lit("")).alias("text"))))
    for role, paths in layout.turns:
        found = [get(p) for p in paths if there(p)]
        if found:
            text = F.concat_ws("\n\n", *[F.when(t != "", t) for t in found])
            turn = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
            whole = F.coalesce(*found).isNull()
            parts.append(F.when(whole, F.array().cast(TURNS)).otherwise(turn) if role == "system" else turn)
    if layout.each:
        named = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
        canonical = lambda r: F.coalesce(named[r], r, F.lit(""))
        parts.append(F.coalesce(F.transform(items(layout.each), lambda m: F.struct(canonical(m["role"]).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text"))), F.array().cast(TURNS)))
    return F.concat(*[p.cast(TURNS) for p in parts])


def canonical_json(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] = ROLES) -> DataFrame:
    """``(layout, fingerprint, mapping, key, place, turns)`` for each JSON text of the column ``record``.

    A text that is null, no JSON or of an unknown layout has a null mapping and no turns. Other columns are not read.
    """
    parsed = df.select(F.try_parse_json(F.col(f"`{record}`").cast("string")).alias("v"))
    marked = parsed.withColumn("layout", record_layout(F.col("v"))).withColumn("fingerprint", fingerprint(F.col("layout")))
    names: dict[str, list[str]] = {}
    for text, name in known_texts(layouts).items():
        names.setdefault(name, []).append(text)
    mapping = F.coalesce(*[F.when(F.col("fingerprint").isin([_hash_of(df.sparkSession, t) for t in texts]) & F.col("layout").isin(texts), F.lit(name)) for name, texts in names.items()])
    marked = marked.withColumn("mapping", mapping)
    get = lambda p: F.try_variant_get("v", f"$.{p}", "string")

    def items(each: Each) -> Column:
        raw = F.try_variant_get("v", f"$.{each.path}", f"array<struct<`{each.role}`:string,`{each.text}`:string>>")
        return F.transform(raw, lambda m: F.struct(m[each.role].alias("role"), m[each.text].alias("text")))

    choose = lambda f, kind: F.coalesce(*[F.when(F.col("mapping") == x.name, f(x).cast(kind)) for x in layouts if f(x) is not None])
    return marked.select(
        "layout", "fingerprint", "mapping",
        choose(lambda x: get(x.key) if x.key else None, "string").alias("key"),
        choose(lambda x: get(x.place) if x.place else None, "bigint").alias("place"),
        choose(lambda x: _turns(x, lambda _: True, get, items, roles), TURNS).alias("turns"),
    )


def _hash_of(spark: SparkSession, text: str) -> int:
    """The fingerprint of a layout's text, by Spark's own hash."""
    return spark.range(1).select(fingerprint(F.lit(text))).first()[0]


def canonical_table(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] = ROLES) -> DataFrame:
    """As ``canonical_json`` for a table whose columns are the fields; all rows have the layout of its schema. The key keeps its type."""
    text = shape_text(shape_of(df.schema))
    name = known_texts(layouts).get(text)
    there = {f.lower() for f in df.columns}
    layout = next((x for x in layouts if x.name == name), None)
    get = lambda p: F.col(".".join(f"`{x}`" for x in p.split("."))).cast("string")

    def items(each: Each) -> Column:
        return F.transform(F.col(".".join(f"`{x}`" for x in each.path.split("."))), lambda m: F.struct(m[each.role].cast("string").alias("role"), m[each.text].cast("string").alias("text")))

    has = lambda p: p is not None and p.split(".")[0].lower() in there
    known = layout is not None
    return df.select(
        F.lit(text).alias("layout"), fingerprint(F.lit(text)).alias("fingerprint"), F.lit(name).cast("string").alias("mapping"),
        (F.col(f"`{layout.key}`") if known and has(layout.key) else F.lit(None).cast("string")).alias("key"),
        (F.col(f"`{layout.place}`").cast("bigint") if known and has(layout.place) else F.lit(None).cast("bigint")).alias("place"),
        (_turns(layout, has, get, items, roles) if known else F.lit(None)).cast(TURNS).alias("turns"),
    )


def unknown_layouts(canonical: DataFrame) -> DataFrame:
    """``(fingerprint, layout, n)`` of the records that no mapping is declared for."""
    return canonical.where("mapping is null").groupBy("fingerprint", "layout").agg(F.count(F.lit(1)).alias("n"))


def conversations(canonical: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(key, turns)``: a row for each record that holds a whole conversation, and for each key of those that are single turns.

    Single turns are ordered by place, null first, ties by role and text; those without a key are one conversation without a key.
    Records of unknown layout are left to ``unknown_layouts``.
    """
    single = [x.name for x in layouts if x.row]
    rows = canonical.where(F.col("mapping").isin(single)).select("key", "place", F.col("turns")[0].alias("t"))
    grouped = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "t.role", "t.text"))).alias("turns"))
    grouped = grouped.select("key", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return canonical.where(F.col("mapping").isNotNull() & ~F.col("mapping").isin(single)).select("key", "turns").unionByName(grouped)


def escaped(text: Column) -> Column:
    """``text`` without ``<|``: a backslash is put before the bar, and one more where there are backslashes already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """As ``escaped``, on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def formatted(df: DataFrame, turns: str = "turns", learnt: str = "assistant") -> DataFrame:
    """``df`` with ``formatted``, the text of all turns, and ``loss_spans``, the places (code points, end exclusive) of the texts of
    role ``learnt`` in it; columns of these names are replaced."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("formatted", "loss_spans")])
    written = F.transform(turns, lambda t: F.struct(F.concat(F.lit(BEGIN), escaped_role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == learnt).alias("learnt")))
    df = df.withColumn("__written", written)
    sizes = F.transform("__written", lambda w: (F.length(w["head"]) + F.length(w["text"]) + len(END) + 1).cast("bigint"))
    spans = F.zip_with("__written", "__before", lambda w, before: F.struct((before + F.length(w["head"])).alias("begin"), (before + F.length(w["head"]) + F.length(w["text"])).alias("end"), w["learnt"].alias("learnt")))
    mask = F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    text = F.array_join(F.transform("__written", lambda w: F.concat(w["head"], w["text"], F.lit(f"{END}\n"))), "")
    return df.withColumn("__before", sums_before(sizes)).withColumns({"formatted": text, "loss_spans": mask}).drop("__written", "__before")


def read_back(df: DataFrame, text: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """``df`` with ``turns`` and ``loss_texts`` (unescaped, in order) as they are read from the formatted text and the mask alone."""
    pieces = F.slice(F.split(F.col(text), r"<\|im_start\|>"), F.lit(2), F.size(F.split(F.col(text), r"<\|im_start\|>")))
    df = df.withColumn("__pieces", F.transform(pieces, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), p.alias("piece"))))
    body = lambda p: F.substring(p["piece"], F.length(p["role"]) + 2, F.length(p["piece"]) - F.length(p["role"]) - 2 - len(END))
    df = df.withColumn("__pieces", F.transform("__pieces", lambda p: F.struct(p["role"].alias("role"), body(p).alias("text"), F.length(p["piece"]).alias("n"))))
    df = df.withColumn("__before", sums_before(F.transform("__pieces", lambda p: (p["n"] + len(BEGIN)).cast("bigint"))))
    # spans and texts in one order: a text is under the mask if a span begins where it does
    texts = F.zip_with("__pieces", "__before", lambda p, before: F.struct((before + len(BEGIN) + F.length(p["role"]) + 1).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("n"), p["text"].alias("text")))
    marks = F.transform(spans, lambda s: F.struct(s["begin"].alias("at"), F.lit(0).alias("kind"), (s["end"] - s["begin"]).alias("n"), F.lit("").alias("text")))
    df = df.withColumn("__all", F.sort_array(F.concat(texts, marks)))
    before = F.slice(F.concat(F.array(F.lit(None).cast("struct<at:bigint,kind:int,n:bigint,text:string>")), F.col("__all")), F.lit(1), F.size("__all"))
    hit = F.zip_with("__all", before, lambda x, mark: F.when((x["kind"] == 1) & (mark["kind"] == 0) & (mark["at"] == x["at"]), unescaped(F.substring(x["text"], F.lit(1), mark["n"].cast("int")))))
    turns = F.transform("__pieces", lambda p: F.struct(unescaped_role(p["role"]).alias("role"), unescaped(p["text"]).alias("text")))
    return df.withColumns({"turns": turns, "loss_texts": F.filter(hit, lambda t: t.isNotNull())}).drop("__pieces", "__before", "__all")


#: The conversation that the query adds, whose texts hold the marks themselves.
PROBE = f"{END}{BEGIN}assistant ok"


def chat_digest(turn_rows: DataFrame) -> DataFrame:
    """Formatted conversations and digests of what is read back from them.

    Rows ``(conv_id, turn, role, text)``; other columns are not read. Null roles and texts are empty; rows are ordered by turn (null
    first), then role and text, repeated rows each a turn of their own; rows without conv_id are one conversation. Conversation -1
    comes as a record of another layout.
    """
    spark = turn_rows.sparkSession
    probe = spark.range(1).select(F.to_json(F.struct(F.lit(-1).alias("id"), F.lit(PROBE).alias("prompt"), F.lit(PROBE).alias("completion"))).alias("record"))
    rows = canonical_table(turn_rows.select("conv_id", "turn", "role", "text"))
    records = canonical_json(probe).withColumn("key", F.col("key").cast(turn_rows.schema["conv_id"].dataType))
    whole = read_back(formatted(conversations(rows.unionByName(records))).drop("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return whole.select(
        F.col("key").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
