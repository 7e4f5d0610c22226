"""Secret scans in DataFrame expressions: fixed patterns, and sliding-window entropy over candidate strings.

Base spans come from three patterns (assign, access, hex), leftmost and
non-overlapping per kind; matches that are too short are dropped.  Positions are those
of code points: the gaps between the matches of a pattern and the matches themselves
add up to the offsets.

Entropy spans come from candidate strings, runs of token characters of 20 or more that
hold a digit and a letter.  Over each, a window slides by one character; the counts of the
characters in the window are kept up to date as one enters and one leaves, and with
them the sum of c * log2(c), from which the Shannon entropy follows.  The threshold
depends on the candidate's character class (hex, alphanumeric, or base64 with
punctuation).  A candidate whose best window reaches its threshold is a span of kind
``entropy`` unless the allow-list covers it (paths and dotted or hyphenated words, UUIDs, runs of
one repeated group) or one base span holds all of it.

Null text is empty and has no spans.  Only texts that hold a candidate or a keyword are
looked at closely; the test for that reads every whole text.  Very long texts are read whole, and
take time in proportion to their length: no pattern backtracks over nested groups, arrays are bound once,
and running totals are kept by chunks.  Repeated rows and ties (spans of several kinds at
one place) all stay, by start, then kind.  An empty table gives an empty result.  Extra columns are left alone,
whatever their names (but for ``__base`` and ``__spans``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import table, whole_text

#: Base kinds in their order: pattern, and the group that must have at least so many characters.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What a text must hold for the pattern of a kind to give a span.
HINTS = {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Least entropy (bits) of the best window by character class.
LEAST = {"hex": 2.9, "alnum": 3.5, "base64": 3.7}
#: Candidates that are no secrets: UUIDs, and one group repeated.
ALLOWED = [r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^(.{1,8}?)\1+.{0,8}$"]
#: What candidates other than words and numbers joined by hyphens, slashes or underscores hold.
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Elements of a chunk of a running total.
CHUNK = 256
SPAN = "array<struct<start:int,stop:int,kind:string,place:int>>"
PLACES = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, wherever the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(parts: Column, fields: dict[str, str], value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """``parts`` (an array of structs of ``fields``, names and types) with ``before``: the joined values (int) of all earlier parts, from 0.

    Chunks are totalled first, and then gone through from the total before each, so that no step copies more than a chunk.
    """
    schema = f"array<struct<{','.join(f'{k}:{t}' for k, t in fields.items())},before:int>>"
    none = F.array().cast(schema)

    def total(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0), lambda at, p: join(at, value(p)))

    def carried(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.transform(chunks, total), start, lambda s, t: F.struct(join(s["at"], t).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def through(chunk: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), none.alias("out"))
        one = lambda s, p: F.struct(*[p[k].alias(k) for k in fields], s["at"].alias("before"))
        return F.aggregate(chunk, start, lambda s, p: F.struct(join(s["at"], value(p)).alias("at"), F.array_append(s["out"], one(s, p)).alias("out")), lambda s: s["out"])

    def whole(all_parts: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_parts, c * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(all_parts) > 0, let(chunks, lambda cs: F.flatten(F.zip_with(cs, carried(cs), through)))).otherwise(none)

    return let(parts, whole)


def _spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern as spans (start, stop, text); gaps between matches come from splitting at them."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(g.alias("gap"), F.length(m).alias("size"), m.alias("text"))), lambda p: p["text"].isNotNull())
    placed = running(parts, {"gap": "int", "size": "int", "text": "string"}, lambda p: p["gap"] + p["size"], lambda x, y: x + y)
    first = lambda p: p["before"] + p["gap"]
    return F.transform(placed, lambda p: F.struct(first(p).alias("start"), (first(p) + p["size"]).alias("stop"), p["text"].alias("text")))


def _long_enough(pattern: str, group: int, least: int):
    return lambda m: F.length(F.regexp_extract(m["text"], pattern, group) if group else m["text"]) >= least


def _as(kind: str):
    return lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(kind).alias("kind"), F.lit(PLACES[kind]).alias("place"))


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, by start, then kind."""
    out = []
    none = F.array().cast(SPAN)
    for kind, (pattern, group, least) in KINDS.items():
        kept = F.filter(_spans(text, r"[0-9a-f]{24,}" if kind == "hex" else pattern), _long_enough(pattern, group, least))
        out.append(F.when(text.rlike(HINTS[kind]), F.transform(kept, _as(kind))).otherwise(none))
    return F.sort_array(F.concat(*out))


def best_window(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of any window of a candidate, from counts kept incrementally."""
    slot = lambda c: F.position(c, F.lit(ALPHABET)) - 1
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), slot)
    xlog = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).alias("seen"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def put(counts: Column, at: Column, value: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at), F.array(value), F.slice(counts, at + 2, F.lit(len(ALPHABET))))

    def step(state: Column, x: Column) -> Column:
        had, lost = F.get(state["n"], x["comes"]), F.when(x["goes"] >= 0, F.get(state["n"], x["goes"])).otherwise(F.lit(0))
        same = x["comes"] == x["goes"]
        left = F.when(x["goes"] >= 0, xlog(lost - 1) - xlog(lost)).otherwise(F.lit(0.0))
        total = F.when(same, state["s"]).otherwise(state["s"] + xlog(had + 1) - xlog(had) + left)
        more = put(state["n"], x["comes"], had + 1)
        counts = F.when(same, state["n"]).when(x["goes"] >= 0, let(more, lambda n: put(n, x["goes"], lost - 1))).otherwise(more)
        entropy = F.when(state["seen"] >= window - 1, F.log2(F.lit(float(window))) - total / F.lit(float(window))).otherwise(F.lit(0.0))
        return F.struct(counts.alias("n"), (state["seen"] + 1).alias("seen"), total.alias("s"), F.greatest(state["best"], entropy).alias("best"))

    def slide(all_codes: Column) -> Column:
        before = F.slice(F.concat(F.array_repeat(F.lit(-1), window), all_codes), F.lit(1), F.size(all_codes))
        return F.aggregate(F.zip_with(all_codes, before, lambda c, g: F.struct(c.alias("comes"), g.alias("goes"))), start, step, lambda s: s["best"])

    return let(codes, slide)


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates of high entropy that neither the allow-list nor one base span covers."""
    least = lambda w: F.when(w.rlike("^([0-9a-f]+|[0-9A-F]+)$"), LEAST["hex"]).when(w.rlike("^[A-Za-z0-9]+$"), LEAST["alnum"]).otherwise(LEAST["base64"])
    secret = lambda w: F.when(w.rlike(MIXED) & ~w.rlike(ALLOWED[0]) & ~w.rlike(ALLOWED[1]), best_window(w) >= least(w)).otherwise(F.lit(False))
    one = lambda m, later, word: F.struct(m["start"].alias("start"), F.lit(later).alias("later"), m["stop"].alias("stop"), word.alias("text"))
    events = F.sort_array(F.concat(F.transform(base, lambda m: one(m, 0, F.lit(""))), F.transform(_spans(text, CANDIDATE), lambda m: one(m, 1, m["text"]))))
    # how far the base spans reach that begin no later
    reached = running(events, {"start": "int", "later": "int", "stop": "int", "text": "string"}, lambda e: F.when(e["later"] == 0, e["stop"]).otherwise(0), lambda x, y: F.greatest(x, y))
    kept = F.filter(reached, lambda e: F.when((e["later"] == 1) & (e["before"] < e["stop"]), secret(e["text"])).otherwise(F.lit(False)))
    return F.when(text.rlike(CANDIDATE), F.transform(kept, _as("entropy"))).otherwise(F.array().cast(SPAN))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__base`` and ``__spans`` (base and entropy spans by start, then kind) to the rows."""
    with_base = df.withColumn("__base", base_spans(whole_text(text)))
    return with_base.withColumn("__spans", F.sort_array(F.concat("__base", entropy_spans(whole_text(text), F.col("__base")))))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """Replace every span (overlapping ones together) by a mark; all other text and all columns stay."""
    found = scan(df, text)
    merged = running(F.col("__spans"), {"start": "int", "stop": "int"}, lambda x: x["stop"], lambda x, y: F.greatest(x, y))
    bound = F.struct(F.filter(F.split(text, ""), lambda c: c != "").alias("chars"), merged.alias("spans"))

    def masked(v: Column) -> Column:
        kept = lambda a, b: F.array_join(F.slice(v["chars"], a + 1, b - a), "")
        pieces = F.transform(v["spans"], lambda x: F.when(x["start"] >= x["before"], F.concat(kept(x["before"], x["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), kept(F.array_max(F.transform(v["spans"], lambda x: x["stop"])), F.size(v["chars"])))

    return found.withColumn(text, F.when(F.size("__spans") > 0, let(bound, masked)).otherwise(F.col(text))).select(*df.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind, at="__base": F.size(F.filter(at, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"), count("entropy", "__spans"))
