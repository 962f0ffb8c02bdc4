"""Secret scans by multipart credential linking, in DataFrame functions only.

Base findings are assignments, access identifiers and long hexadecimal runs. Weak candidates
(identifier assignments, endpoints, unlabelled high-entropy tokens) say little alone, so they are
reported only where complementary parts fall into one scope. Parts are interval-joined with
scopes: stretches of text of ``2 * reach`` code points, one begun every ``reach``, so that two
parts that begin within ``reach`` of each other always share a scope, and no pairs of parts are made.

Defined results: a null text is an empty text; texts are read whole, and work grows in proportion to
their matches; spans that begin together stand in the order of the kinds; rows that repeat doc_id and
text are each returned; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut

# The patterns of the base kinds, in their listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
GUARD = r"[0-9=:]|AKIA|[a-f]{24}"

# The patterns of the weak kinds.
IDENT = r"""(?i:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"(?i:https?|s3|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@-]+"
BLOB = r"[A-Za-z0-9+/_-]{32,}={0,2}"
WEAK = ("ident", "endpoint", "blob")
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "id", "ident": "id", "endpoint": "endpoint"}
SPAN = "struct<start:bigint,ord:int,kind:string,end:bigint>"
RUN = 256


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sizes(text: Column, pattern: str, value_group: int | None, least: int) -> Column:
    """Per match: code points since the match before, code points of the match, whether it is kept."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    whole = F.filter(rows, lambda x: x["hit"].isNotNull())  # there is one gap more than there are matches
    return F.transform(
        whole, lambda x: F.struct(F.char_length(x["gap"]).cast("bigint").alias("gap"), F.char_length(x["hit"]).alias("hit"), (F.char_length(x["value"]) >= least).alias("good"))
    )


def _spans(text: Column, kind: str, pattern: str, value_group: int | None = None, least: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, from the lengths of the matches and of what lies between.

    Appending to an array copies it, so sums run over runs of ``RUN`` matches first and then within each run.
    """
    order = (BASE + WEAK).index(kind)
    none = F.array().cast(f"array<{SPAN}>")
    place = lambda at, out: F.struct(at.cast("bigint").alias("at"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["hit"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end")).cast(SPAN)
        return place(end, F.when(x["good"], F.array_append(acc["out"], span)).otherwise(acc["out"]))

    def in_runs(sizes: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int"))
        return F.transform(numbers, lambda i: F.slice(sizes, i * RUN + 1, F.lit(RUN)))

    def starts(runs: Column) -> Column:
        total = lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + x["hit"])
        zero = place(F.lit(0), F.array().cast("array<bigint>"))
        return F.aggregate(runs, zero, lambda acc, run: place(acc["at"] + total(run), F.array_append(acc["out"], acc["at"])), lambda acc: acc["out"])

    def spans(runs: Column) -> Column:
        each = F.arrays_zip(runs.alias("run"), starts(runs).alias("start"))
        return F.flatten(F.transform(each, lambda r: F.aggregate(r["run"], place(r["start"], none), step, lambda acc: acc["out"])))

    found = _let(_sizes(text, pattern, value_group, least), lambda sizes: _let(in_runs(sizes), spans))
    return F.when(text.rlike(pattern), found).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """Per document: spans of the base kinds, and of the weak kinds.

    Documents that ``GUARD`` doesn't meet can hold no finding and skip the patterns: an assignment, an
    identifier and an endpoint have ``=`` or ``:``, a hexadecimal run a digit or letters only, and an
    unlabelled token is reported only beside an identifier.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    spans = F.array_sort(
        F.concat(
            _spans(text, "assign", ASSIGN, value_group=2, least=6),
            _spans(text, "access", ACCESS),
            _spans(text, "hex", HEX),
        )
    )
    weak = F.concat(_spans(text, "ident", IDENT), _spans(text, "endpoint", ENDPOINT), _spans(text, "blob", BLOB))
    some = text.rlike(GUARD)
    return docs.select("doc_id", F.xxhash64("text").alias("h"), text.alias("text")).select(
        "doc_id", "h", F.when(some, spans).otherwise(none).alias("base"), F.when(some, weak).otherwise(none).alias("loose")
    )


def _free(flat: DataFrame) -> DataFrame:
    """Base spans, and those weak spans that overlap none of their document's base spans."""
    up = Window.partitionBy("doc_id", "h").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("doc_id", "h").orderBy(F.desc("start"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("ord") < len(BASE)
    clear = (F.coalesce(F.max(F.when(base, F.col("end"))).over(up), F.lit(-1)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(down), F.col("end")) >= F.col("end")
    )
    return flat.withColumn("_clear", base | clear).where("_clear").drop("_clear")


def link(found: DataFrame, reach: int = 200) -> DataFrame:
    """Weak spans whose scope holds complementary parts, one row per document that has any.

    An unlabelled token counts beside an identifier, an identifier beside a secret, an endpoint
    beside both.
    """
    flat = (
        found.where(F.size("loose") > 0)
        .select("doc_id", "h", F.explode(F.concat("base", "loose")).alias("s"))
        .select("doc_id", "h", "s.*")
        .distinct()
    )
    flat = _free(flat)
    role = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), ROLE.items(), F.when(F.lit(False), ""))
    bucket = F.floor(F.col("start") / reach)
    flat = flat.withColumn("role", role).withColumn("bucket", bucket)
    scopes = (
        flat.select("doc_id", "h", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"))).alias("scope"))
        .distinct()
        .select("*", (F.col("scope") * reach).alias("lo"), ((F.col("scope") + 2) * reach).alias("hi"))
        .select("*", F.explode(F.array(F.col("scope"), F.col("scope") + 1)).alias("bucket"))
    )
    p, s = flat.alias("p"), scopes.alias("s")
    inside = p.join(
        s,
        F.col("p.doc_id").eqNullSafe(F.col("s.doc_id"))
        & (F.col("p.h") == F.col("s.h"))
        & (F.col("p.bucket") == F.col("s.bucket"))
        & (F.col("p.start") >= F.col("s.lo"))
        & (F.col("p.start") < F.col("s.hi")),
    ).select("p.*", "s.scope")
    has = inside.groupBy("doc_id", "h", "scope").agg(
        F.max(F.col("role") == "id").alias("has_id"), F.max(F.col("role") == "secret").alias("has_secret")
    )
    i, a = inside.where(F.col("kind").isin(*WEAK)).alias("i"), has.alias("a")
    near = i.join(a, F.col("i.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("i.h") == F.col("a.h")) & (F.col("i.scope") == F.col("a.scope")))
    whole = (
        F.when(F.col("kind") == "blob", F.col("has_id"))
        .when(F.col("kind") == "ident", F.col("has_secret"))
        .otherwise(F.col("has_id") & F.col("has_secret"))
    )
    span = F.struct("start", "ord", "kind", "end")
    return near.where(whole).groupBy(F.col("i.doc_id").alias("doc_id"), F.col("i.h").alias("h")).agg(F.collect_set(span).alias("linked"))


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Per document its base spans and all spans (base and linked), ordered by start, then kind."""
    found = cut(parts(docs))
    linked = link(found, reach)
    f, l = found.alias("f"), linked.alias("l")
    both = f.join(l, F.col("f.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("f.h") == F.col("l.h")), "left")
    more = F.coalesce("linked", F.array().cast(f"array<{SPAN}>"))
    return both.select("f.doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: str) -> Column:
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def digest(docs: DataFrame, reach: int = 200) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return scan(docs, reach).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
