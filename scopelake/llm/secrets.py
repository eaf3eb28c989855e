"""Secret scan with multipart credential linking, in DataFrame expressions only.

Base spans (kinds assign, access, hex) stand alone.  Weak parts - an account name, a
short access identifier, a short assigned value, a random-looking token, a service
address - are reported only where their complements lie within ``scope`` code points:
an identifier needs a secret, a secret needs an identifier, an endpoint needs both.

Matches and the gaps between them are taken inside the row (one split and one
extraction per pattern); texts are dropped before anything is shuffled.  Only redaction
carries a row that holds a match along, with its first part.  Starts are
running sums over (row, kind).  The interval join of parts with complements is a sweep
over the parts of a row in order of start: the nearest complement on either side
decides whether the widened intervals meet, so no pairs are made.

Defined results: a null text is the empty text and has no spans.  Offsets are in code
points, end exclusive.  Equal starts are in the order of KINDS.  Texts of any length are
scanned whole.  Repeated rows give repeated results; a null doc_id is kept; extra columns
are ignored (redact: kept as they are); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base patterns, and the least code points of what they must hold.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Weak parts.
ACCOUNT = r"""(?<![A-Za-z0-9_])(?:[uU][sS][eE][rR](?:_?[nN][aA][mM][eE]|_?[iI][dD])?|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[kK][eE][yY]_?[iI][dD])["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
RANDOM = r"(?<![A-Za-z0-9+/_])(?=[A-Za-z0-9+/]{16})(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{16,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?<![A-Za-z0-9_])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}(?![A-Za-z0-9_])"
#: Code points within which complementary parts belong together.
SCOPE = 200

#: Pattern by raw kind, in the order of ties.
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": r"(?<![0-9a-f])[0-9a-f]{%d,}" % LEAST_HEX, "account": ACCOUNT, "random": RANDOM, "endpoint": ENDPOINT}
_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16}"
#: What a text must hold for a pattern to match at all: cheaper to look for than the pattern.
NEEDS: dict[str, Callable[[Column], Column]] = {
    "assign": lambda t: t.contains(":") | t.contains("="),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(_RUN),
    "account": lambda t: t.contains(":") | t.contains("="),
    "random": lambda t: t.rlike(_RUN),
    "endpoint": lambda t: t.contains("://") | (t.contains(".") & t.contains(":")),
}
#: Every kind of span in the order of ties; the last four are weak parts with complements.
KINDS = ["assign", "access", "hex", "account", "short_access", "short_assign", "random", "endpoint"]


#: One match as _matches() gives it.
PART = "array<struct<raw:string,n:int,gap:int,len:int,value:int>>"


def _hit(kind: str, text: Column) -> Column:
    return NEEDS[kind](text) & text.rlike(PATTERNS[kind])


def _matches(kind: str, pattern: str) -> Column:
    """[(kind, n, gap before, length, length of the assigned value)] of one pattern."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    value = (lambda m: F.length(F.regexp_extract(m, pattern, 2))) if kind == "assign" else (lambda m: F.lit(0))
    numbered = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("m")),
        lambda x, n: F.struct(
            F.lit(kind).alias("raw"), n.alias("n"), x["gap"].alias("gap"), F.length(x["m"]).alias("len"), value(x["m"]).alias("value")
        ),
    )
    return F.when(_hit(kind, text), numbered)


def _parts(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per part: row_id, doc_id, kind, start, end; rows without parts have null kinds.  keep: only on one part of a row."""
    a = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)
    arrays = [_matches(k, p).alias(f"_{k}") for k, p in PATTERNS.items()]
    a = a.select("row_id", "doc_id", *keep, *arrays)
    none = F.array().cast(PART)
    parts = F.concat(*[F.coalesce(F.col(f"_{k}").cast(PART), none) for k in PATTERNS])
    a = a.select("row_id", "doc_id", *keep, F.posexplode_outer(parts).alias("at", "x"))
    first = [F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c) for c in keep]
    a = a.select("row_id", "doc_id", *first, "x.*").repartition("row_id")
    w = Window.partitionBy("row_id", "raw").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(w)).withColumn("start", F.col("end") - F.col("len"))
    kind = (
        F.when((F.col("raw") == "assign") & (F.col("value") < LEAST_ASSIGN), "short_assign")
        .when((F.col("raw") == "access") & (F.col("len") < LEAST_ACCESS), "short_access")
        .otherwise(F.col("raw"))
    )
    return a.select("row_id", "doc_id", *keep, kind.alias("kind"), "start", "end")


def find_spans(docs: DataFrame, scope: int = SCOPE, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, doc_id, kind, start, end of every reported span; rows with nulls for what is not reported, one at least."""
    p = _parts(docs, *keep)
    k = F.col("kind")
    identifier = k.isin("access", "account", "short_access")
    secret = k.isin("assign", "hex", "random", "short_assign")
    order = Window.partitionBy("row_id").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    start, end = F.col("start"), F.col("end")

    def near(part: Column) -> Column:
        """Whether a part of that sort, other than the row's own, lies within the scope."""
        gap_before = start - F.max(F.when(part, end)).over(before)
        gap_after = F.min(F.when(part, start)).over(after) - end
        return F.coalesce(gap_before <= scope, F.lit(False)) | F.coalesce(gap_after <= scope, F.lit(False))

    p = p.withColumns({"near_id": near(identifier), "near_secret": near(secret)})
    weak = (
        F.when(k.isin("account", "short_access"), F.col("near_secret"))
        .when(k.isin("short_assign", "random"), F.col("near_id"))
        .when(k == "endpoint", F.col("near_id") & F.col("near_secret"))
        .otherwise(F.lit(True))
    )
    return p.select("row_id", "doc_id", *keep, F.when(weak, k).alias("kind"), F.when(weak, start).alias("start"), F.when(weak, end).alias("end"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, found = [(start, order, kind, end)] by start, then kind."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    one = F.when(F.col("kind").isNotNull(), F.struct(F.col("start"), rank.alias("rank"), F.col("kind"), F.col("end")))
    return (
        find_spans(docs, scope)
        .groupBy("row_id", "doc_id")
        .agg(F.sort_array(F.collect_list(one)).alias("found"))
        .select("doc_id", "found")
    )


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "<SECRET>") -> DataFrame:
    """docs with every reported span of ``text`` replaced by the mask; all rows and columns stay.

    Overlapping and touching spans become one mask; n_chars, where there, is counted anew.
    """
    hit = F.coalesce(reduce(lambda a, b: a | b, [_hit(kind, F.col("text")) for kind in PATTERNS]), F.lit(False))
    clean = docs.where(~hit)
    held = docs.where(hit).select(F.lit(None).cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("__held"))
    found = find_spans(held, scope, ("__held",))
    order = Window.partitionBy("row_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("__new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    found = found.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.first("__held", ignorenulls=True).alias("__held")
    merged = found.groupBy("row_id", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), row)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    joined = merged.groupBy("row_id").agg(F.sort_array(F.collect_list(span)).alias("__spans"), row).select("__spans", "__held.*")
    n = F.size("__spans")
    pieces = F.transform(
        "__spans",
        lambda x, i: F.concat(
            F.substring(
                F.col("text"),
                F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0)).cast("int") + 1,
                (x["start"] - F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0))).cast("int"),
            ),
            F.lit(mask),
        ),
    )
    rest = F.expr("substring(text, cast(element_at(__spans, -1).end as int) + 1)")
    masked = joined.withColumn("text", F.when(n > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:  # after the text has its value: a lambda is not evaluated twice in one projection
        counted = F.when(n > 0, F.length("text")).otherwise(F.col("n_chars"))
        masked = masked.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return clean.union(masked.select(*docs.columns))
