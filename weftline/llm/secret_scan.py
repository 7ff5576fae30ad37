"""Secret scans with multipart credential linking. DataFrame functions only; nothing is shuffled.

Spans are found in each whole text by regular expressions. Positions come from the pieces between the matches: a match starts
where the pieces and matches before it end. Parts that prove little alone are linked by an interval join inside their document:
key material (a bare key, or a base span of kind assign or hex) with an anchor (an account name, an endpoint, or a base span of
kind access). A sweep over the ends and beginnings of all parts in order carries the end of the last part of each role forward,
and another one the beginning of the next part backward; a weak part is reported when one of the other role lies within the
scope. Parts that overlap never complete each other, and a bare key that begins inside another part (the path of a URL, the value
of an account name) is no key material. A document is its own partition of that join, so no row leaves its task.

Sweeps go over blocks of parts, so that a text's work grows with its parts and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns of the base spans. Letters of either case are spelled out, so that no other letter folds to them.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: The patterns of the weak parts.
IDENTIFIER = r"""(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
BARE_KEY = r"[A-Za-z0-9+/_-]{32,}={0,2}"
#: Key material has letters and digits, and capitals among small letters or no marks: words joined by dashes are a title, no key.
UNBROKEN = "^[A-Za-z0-9+]+={0,2}$"
ENDPOINT = r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/._-]*"

#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", "link_id", "link_key", "link_endpoint")
SCOPE = 256
#: Items of a block of a sweep.
SWEEP = 32
#: A span inside the sweeps: its rank says its kind, as texts would be copied with every step.
MARK = "start:int,rank:int,stop:int"
SPAN = f"{MARK},kind:string"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def in_blocks(items: Column) -> Column:
    some = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SWEEP).cast("int")), lambda b: F.slice(items, b * SWEEP + 1, F.lit(SWEEP)))
    return F.when(F.size(items) > 0, some)


def swept(items: Column, begin: Column, state: str, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, item)``, which returns the next state and one value of the type ``out``, gives for each item in order.

    An aggregate copies all it has gathered with every step. So the first pass gathers only the state before each block, and
    the second gathers values inside blocks.
    """

    def before(acc: Column, b: Column) -> Column:
        after = F.aggregate(b, acc["state"], lambda s, x: step(s, x)[0])
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        after, value = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(value)).alias("out"))

    def run(blocks: Column) -> Column:
        states = F.aggregate(blocks, F.struct(begin.alias("state"), empty(state).alias("out")), before, lambda acc: acc["out"])
        values = lambda b, s: F.aggregate(b, F.struct(s.alias("state"), empty(out).alias("out")), one, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, states, values))

    return F.coalesce(let(let(items, in_blocks), run), empty(out))


def marks(x: Column) -> list[Column]:
    return [x[f].alias(f) for f in ("start", "rank", "stop")]


def spans(found: Column) -> Column:
    """Spans with their kinds, by start and then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.transform(F.sort_array(found), lambda x: F.struct(*marks(x), F.element_at(kinds, x["rank"] + 1).alias("kind")))


def found(text: Column, pattern: str, kind: str, good: Callable[[Column], Column] | None = None) -> Column:
    """All leftmost non-overlapping matches as structs (start, rank, stop), those with a ``good`` hit; positions in code points,
    end exclusive."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = let(F.struct(hits.alias("hits"), gaps.alias("gaps")), lambda x: F.zip_with(x["hits"], F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), lambda hit, gap: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), (good(hit) if good else F.lit(True)).alias("good"))))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, stop = at + x["gap"], at + x["gap"] + x["size"]
        return stop, F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"), x["good"].alias("good"))

    every = swept(pairs, F.lit(0), "int", f"struct<{MARK},good:boolean>", step)
    return F.when(text.rlike(pattern), F.transform(F.filter(every, lambda x: x["good"]), lambda x: F.struct(*marks(x)))).otherwise(empty(f"struct<{MARK}>"))


def roles(every: Column) -> Column:
    """Spans (in order) with ``is_key`` and ``fresh``, not covered by a base span. Bare keys that begin inside another part go."""
    base, bare = lambda x: x["rank"] < KINDS.index("link_id"), lambda x: x["rank"] == KINDS.index("link_key")

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        part = F.struct(
            *marks(x),
            x["rank"].isin(*[KINDS.index(k) for k in ("assign", "hex", "link_key")]).alias("is_key"),
            (~base(x) & (reach["base"] < x["stop"])).alias("fresh"),
            (~bare(x) | (reach["any"] <= x["start"])).alias("good"),
        )
        return F.struct(F.when(base(x), F.greatest(reach["base"], x["stop"])).otherwise(reach["base"]).alias("base"), F.when(bare(x), reach["any"]).otherwise(F.greatest(reach["any"], x["stop"])).alias("any")), part

    done = swept(every, F.struct(F.lit(0).alias("base"), F.lit(0).alias("any")), "struct<base:int,any:int>", f"struct<{MARK},is_key:boolean,fresh:boolean,good:boolean>", step)
    return F.filter(done, lambda x: x["good"])


def near_other(parts: Column, scope: int) -> Column:
    """The fresh parts that have one of the other role within ``scope`` code points before or after them."""
    far = F.lit(-(2**30))
    event = lambda at, opens: lambda p: F.struct(p[at].alias("at"), F.lit(opens).alias("opens"), p.alias("part"))

    def sweep(events: Column, sign: int, entry: int) -> Column:
        """At its near edge a part looks back at what has been left behind; at its far edge it is left behind itself."""

        def step(last: Column, e: Column) -> tuple[Column, Column]:
            here, p = sign * e["at"], e["part"]
            enters = e["opens"] == entry
            near = here - F.when(p["is_key"], last["anchor"]).otherwise(last["key"]) <= scope
            after = lambda own, name: F.when(~enters & own, here).otherwise(last[name]).alias(name)
            return F.struct(after(p["is_key"], "key"), after(~p["is_key"], "anchor")), F.struct(*marks(p), near.alias("near"), (enters & p["fresh"]).alias("real"))

        done = swept(events, F.struct(far.alias("key"), far.alias("anchor")), "struct<key:int,anchor:int>", f"struct<{MARK},near:boolean,real:boolean>", step)
        return F.sort_array(F.filter(done, lambda x: x["real"]))

    # ends come before beginnings at one place
    events = F.sort_array(F.concat(F.transform(parts, event("start", 1)), F.transform(parts, event("stop", 0))))
    both = let(events, lambda e: F.zip_with(sweep(e, 1, 1), sweep(F.reverse(e), -1, 0), lambda a, b: F.struct(F.struct(*marks(a)).alias("span"), (a["near"] | b["near"]).alias("near"))))
    return F.transform(F.filter(both, lambda x: x["near"]), lambda x: x["span"])


def scanned(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: arrays of (start, rank, stop, kind), by start and then kind."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.concat(
        found(body, ASSIGN, "assign", lambda hit: F.length(F.regexp_extract(hit, ASSIGN_VALUE, 1)) >= 6),
        found(body, ACCESS, "access"),
        found(body, HEX, "hex"),
    )
    weak = F.concat(
        found(body, IDENTIFIER, "link_id"),
        found(body, BARE_KEY, "link_key", lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (hit.rlike(UNBROKEN) | (hit.rlike("[a-z]") & hit.rlike("[A-Z]")))),
        found(body, ENDPOINT, "link_endpoint"),
    )
    first = docs.withColumns({"__base": base, "__weak": weak})
    linked = let(F.sort_array(F.concat("__base", "__weak")), lambda every: let(roles(every), lambda parts: near_other(parts, scope)))
    linked = F.when((F.size("__weak") > 0) & (F.size("__base") + F.size("__weak") > 1), linked).otherwise(empty(f"struct<{MARK}>"))
    every = first.withColumn("__spans", spans(F.concat("__base", linked)))
    return every.withColumn("__base", spans(F.col("__base"))).drop("__weak")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, stop): the base spans and the linked weak ones.

    A null or empty text has none. Rows are never merged or dropped; an input column ``secrets`` is replaced.
    """
    out = scanned(docs.drop("secrets"), text, scope)
    return out.withColumn("secrets", F.transform("__spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))).drop("__base", "__spans")


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``; spans that overlap become one. Other texts stay as they are."""
    out = scanned(docs, text, scope)
    body = F.col(f"`{text}`")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(at, x["stop"]), F.struct(at.alias("at"), x["start"].alias("start"), (x["start"] >= at).alias("fresh"))

    gaps = F.filter(swept(F.col("__spans"), F.lit(0), "int", "struct<at:int,start:int,fresh:boolean>", step), lambda x: x["fresh"])

    def pieces(block: Column) -> Column:
        """The text of a block of gaps, cut out of the whole once."""
        begin = F.element_at(block, 1)["at"]
        part = body.substr(begin + 1, F.element_at(block, -1)["start"] - begin)
        return let(part, lambda own: F.array_join(F.transform(block, lambda g: F.concat(own.substr(g["at"] - begin + 1, g["start"] - g["at"]), F.lit(mark))), ""))

    last = F.array_max(F.transform("__spans", lambda x: x["stop"]))
    clean = F.concat(F.array_join(F.transform(let(gaps, in_blocks), pieces), ""), body.substr(last + 1, F.length(body)))
    done = F.when(F.size("__spans") > 0, clean).otherwise(body)
    return out.select(*[(done.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])


def secret_digest(docs: DataFrame) -> DataFrame:
    """The spans of each document as counts, a digest of the base spans, and a text of all spans.

    A null text is empty and has none; repeated rows and rows without an id each have their row.
    """
    n = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long")
    return scanned(docs).select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))
