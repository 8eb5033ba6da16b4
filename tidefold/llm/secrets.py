"""Secret scans: fixed patterns, and a battery of randomness tests; DataFrame functions only.

Base kinds (leftmost, non-overlapping matches of each; those that fail a length test are dropped):
``assign`` (a name such as password or token, then : or =, then 6 characters or more), ``access``
(AKIA and so on, 20 characters or more) and ``hex`` (24 or more hexadecimal digits).

Kind ``random`` comes from the battery.  Candidates are runs of ``[A-Za-z0-9+/_=-]`` of at least
``least`` characters whose alphabet can be inferred: hexadecimal (of either case, with digits and
letters), base 32 (capitals and 2-7) or base 64 (capitals, small letters and digits).  Tests:

1. chi-squared of the character counts against a uniform alphabet, read in two ways.  As random
   text the statistic must not be too high (its z below ``tolerance``); and there is a chance that
   *natural* text of this length, with the index of coincidence below, comes out as even as this.
   Fisher's method joins it with the chance that the kind of character changes as often in natural
   text: the candidate's p value.  The longer the text, the smaller it can get.
2. Wald-Wolfowitz runs of characters in the upper and lower half of the alphabet, |z| < tolerance.
3. Serial correlation of neighbours' places in the alphabet, |z| < tolerance.

Candidates that pass 2, 3 and the first reading of 1 then compete under Benjamini-Hochberg at
rate ``fdr``, apart for each class of lengths, over the whole corpus: p values are counted in
log-spaced bins, so the table that decides has a bounded number of rows.

Offsets are code points, end exclusive.  Null texts count as empty.  Each input row gives one row.
A random span inside a base span is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import cut

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Alphabet (places are 1-based), and of natural text and names written in it: the index of
#: coincidence, and how often the kind of character (small, capital, other) changes.
ALPHABETS = {
    "hex": ("0123456789abcdef", 0.12, 0.25),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065, 0.25),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065, 0.35),
}
CHANGE = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^A-Za-z])(?=[A-Za-z])"
#: p values are binned by floor(BINS_PER_E * -ln p), at most LAST_BIN.
BINS_PER_E, LAST_BIN = 8, 800
#: Places of an array, and code points of a text, that are taken together.
CHUNK, BLOCK = 128, 1024


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, as in a LET."""
    return F.transform(F.array(c), f)[0]


def running(values: Column, op) -> Column:
    """array<int>: ``op`` (a sum, say) over the values up to each place; the values start from 0.

    Places are taken in chunks, then the chunks, so the time is about linear in the array's length.
    """
    empty = F.from_json(F.lit("[]"), "array<int>")

    def appended(xs: Column) -> Column:
        return F.aggregate(xs, empty, lambda acc, x: F.array_append(acc, op(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x)))

    def joined(chunks: Column) -> Column:
        ends = appended(F.transform(chunks, lambda c: F.get(c, F.size(c) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(chunks, lambda c, i: F.transform(c, lambda x: op(F.coalesce(F.get(e, i - 1), F.lit(0)), x)))))

    def chunked(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        return let(F.transform(numbers, lambda i: appended(F.slice(xs, i * CHUNK + 1, CHUNK))), joined)

    return let(values, lambda xs: F.when(F.size(xs) > 0, chunked(xs)).otherwise(empty))


def hits(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, token, part>> of all matches; part is the group, else the match.

    What lies between the matches is what split() returns, so lengths give the offsets.
    """
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,token:string,part:string>>")
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = tokens if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), tokens.alias("token"), parts.alias("part")), lambda x: x["token"].isNotNull())

    def placed(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: x["gap"] + F.char_length(x["token"])), lambda a, b: a + b)
        return F.zip_with(xs, ends, lambda x, end: F.struct((end - F.char_length(x["token"])).alias("start"), end.alias("end"), x["token"].alias("token"), x["part"].alias("part")))

    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(empty)


def kind(spans: Column, name: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), s["end"].alias("end")))


def normal_tail(z: Column) -> Column:
    """-ln of the lower normal tail for z <= 0 (a bound that is sharp to a few hundredths); 0 above."""
    t = F.greatest(-z, F.lit(0.0))
    return F.when(z >= 0, F.lit(0.0)).otherwise(t * t / 2 + F.log(t + F.sqrt(t * t + 4)) - F.log(F.lit(2.0)))


def battery(token: Column, tolerance: float) -> Column:
    """struct<logp, cls> of a token: -ln of its chance as natural text, or null if a test rejects it."""

    def alphabet(bare: Column) -> Column:
        low, up, num = bare.rlike("[a-z]"), bare.rlike("[A-Z]"), bare.rlike("[0-9]")
        hexa = num & ((low & bare.rlike(r"\A[0-9a-f]+\z")) | (up & bare.rlike(r"\A[0-9A-F]+\z")))
        b32 = num & bare.rlike(r"\A[A-Z2-7]+\z")
        return F.struct(bare.alias("bare"), F.when(hexa, "hex").when(b32, "base32").when(low & up & num, "base64").alias("name"))

    # each value is computed once and named by an inner struct, as in nested LETs
    def judged(v: Column) -> Column:
        n, a = v["n"], v["a"]
        chi = a / n * v["squares"] - n
        chi_z = (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        s = v["natural"]
        mean = a * (1 + (n - 1) * s) - n
        sd = a * F.sqrt(2 * s * (1 - s) + 1.2 * n * s * s)
        changes_z = (v["changes"] - v["rate"] * (n - 1)) / F.sqrt(v["rate"] * (1 - v["rate"]) * (n - 1))
        both = normal_tail((chi - mean) / sd) + normal_tail(-changes_z)
        n1, n2 = v["upper"], n - v["upper"]
        runs_mean = 2 * n1 * n2 / n + 1
        runs_sd = F.sqrt(F.greatest((runs_mean - 1) * (runs_mean - 2) / (n - 1), F.lit(1e-9)))
        runs_z = (v["runs"] - runs_mean) / runs_sd
        serial_z = F.when(v["var"] > 0, v["cov"] / v["var"] * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(99.0)
        fine = (chi_z < tolerance) & (F.abs(runs_z) < tolerance) & (F.abs(serial_z) < tolerance)
        return F.struct(F.when(fine, both - F.log(1 + both)).alias("logp"), F.when(n < 32, 0).when(n < 64, 1).otherwise(2).alias("cls"))

    def counted(v: Column) -> Column:
        at = v["at"]
        n = F.size(at).cast("double")
        half = v["a"] / 2
        mean = F.aggregate(at, F.lit(0.0), lambda acc, x: acc + x) / n
        nexts = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return let(
            F.struct(at.alias("at"), n.alias("n"), v["a"].alias("a"), v["natural"].alias("natural"), v["rate"].alias("rate"), v["changes"].alias("changes"), mean.alias("mean"), nexts.alias("nexts"), half.alias("half")),
            judged_in,
        )

    def judged_in(w: Column) -> Column:
        squares = F.aggregate(F.array_distinct(w["at"]), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(w["at"], lambda y: y == x)), F.lit(2)))
        return let(
            F.struct(
                w["n"].alias("n"),
                w["a"].alias("a"),
                w["natural"].alias("natural"),
                w["rate"].alias("rate"),
                w["changes"].alias("changes"),
                squares.alias("squares"),
                F.size(F.filter(w["at"], lambda x: x > w["half"])).cast("double").alias("upper"),
                (1 + F.size(F.filter(w["nexts"], lambda p: (p["x"] > w["half"]) != (p["y"] > w["half"])))).cast("double").alias("runs"),
                F.aggregate(w["nexts"], F.lit(0.0), lambda acc, p: acc + (p["x"] - w["mean"]) * (p["y"] - w["mean"])).alias("cov"),
                F.aggregate(w["at"], F.lit(0.0), lambda acc, x: acc + F.pow(x - w["mean"], F.lit(2))).alias("var"),
            ),
            judged,
        )

    def counted_from(v: Column) -> Column:
        at = F.transform(F.split(v["t"], ""), lambda c: F.instr(v["letters"], c).cast("double"))
        return let(F.struct(at.alias("at"), F.char_length(v["letters"]).cast("double").alias("a"), v["natural"].alias("natural"), v["rate"].alias("rate"), F.regexp_count(v["t"], F.lit(CHANGE)).cast("double").alias("changes")), counted)

    def tested(v: Column) -> Column:
        bare, name = v["bare"], v["name"]
        plain = F.when(name == "hex", F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))

        def pick(i):
            c = F.when(name == "hex", F.lit(ALPHABETS["hex"][i]))
            return c.when(name == "base32", F.lit(ALPHABETS["base32"][i])).when(name == "base64", F.lit(ALPHABETS["base64"][i]))

        letters = let(F.struct(plain.alias("t"), pick(0).alias("letters"), pick(1).cast("double").alias("natural"), pick(2).cast("double").alias("rate")), counted_from)
        return F.when(name.isNotNull(), letters)

    return let(let(F.regexp_replace(token, r"=+\z", ""), alphabet), tested)


def outside(base: Column, candidates: Column) -> Column:
    """Candidates within no base span: the farthest end of the base spans that start before or with
    a candidate falls short of its end."""
    base = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("tried"), s["end"].alias("end"), F.lit(None).cast("struct<logp:double,cls:int>").alias("b")))
    tried = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("tried"), c["end"].alias("end"), c["b"].alias("b")))

    def kept(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda x: F.when(x["tried"] == 0, x["end"]).otherwise(0)), F.greatest)
        rows = F.filter(F.zip_with(xs, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), lambda y: (y["x"]["tried"] == 1) & (y["x"]["end"] > y["reach"]))
        return F.transform(rows, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["b"].alias("b")))

    return let(F.array_sort(F.concat(base, tried)), kept)


def found(docs: DataFrame, least: int, tolerance: float, *more: Column) -> DataFrame:
    """doc_id, base (spans), candidates (start, end, b) and further columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(hits(text, ASSIGN, 1), lambda s: F.char_length(s["part"]) >= 6)
    base = F.array_sort(F.concat(kind(assign, "assign"), kind(hits(text, ACCESS), "access"), kind(hits(text, HEX), "hex")))
    tried = F.transform(
        hits(text, r"[A-Za-z0-9+/_=-]{%d,}" % least),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["token"], tolerance).alias("b")),
    )
    tried = F.filter(tried, lambda s: s["b"]["logp"].isNotNull())
    rows = docs.select("doc_id", base.alias("base"), tried.alias("candidates"), *more)
    clear = F.when((F.size("base") > 0) & (F.size("candidates") > 0), outside(F.col("base"), F.col("candidates"))).otherwise(F.col("candidates"))
    return rows.withColumn("candidates", clear)


def cuts(rows: DataFrame, fdr: float) -> DataFrame:
    """Benjamini-Hochberg: for each class of lengths, the lowest bin that is still accepted."""
    # not plain explode: for it the optimizer filters by size, under a copy of all that makes candidates
    each = rows.select(F.explode_outer("candidates").alias("c")).where(F.col("c").isNotNull())
    bins = each.groupBy(F.col("c.b.cls").alias("cls"), bin_of(F.col("c.b.logp")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("cls").orderBy(F.desc("bin"))
    ranked = bins.select("cls", "bin", F.sum("n").over(down).alias("k"), F.sum("n").over(Window.partitionBy("cls")).alias("m"))
    # p of a bin is exp(-bin / BINS_PER_E) at most
    return ranked.where(F.exp(-F.col("bin") / F.lit(float(BINS_PER_E))) <= F.lit(fdr) * F.col("k") / F.col("m")).groupBy("cls").agg(F.min("bin").alias("least_bin"))


def bin_of(logp: Column) -> Column:
    return F.least(F.lit(LAST_BIN), F.floor(BINS_PER_E * logp)).cast("int")


def scan(docs: DataFrame, least: int = 20, tolerance: float = 3.3, fdr: float = 0.01, whole: bool = False) -> DataFrame:
    """doc_id, base and spans (both array<struct<start, kind, end>>, kind as a place in KINDS).

    With ``whole`` also ``row``, a struct of all columns of ``docs``; texts are then read twice.
    """
    more = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []
    rows = found(docs, least, tolerance, *more)
    seen = rows if whole else cut(rows)
    # three rows at most, one for each class of lengths; as literals they keep joins, and a second
    # copy of all these expressions, out of the plan that the driver sends with every task
    bounds = {row["cls"]: row["least_bin"] for row in cuts(seen, fdr).collect()}

    def accepted(c: Column) -> Column:
        least_bin = reduce(lambda other, cls: F.when(c["b"]["cls"] == cls, bounds[cls]).otherwise(other), sorted(bounds), F.lit(LAST_BIN + 1))
        return bin_of(c["b"]["logp"]) >= least_bin

    passed = F.filter("candidates", accepted)
    return seen.select("doc_id", "base", F.array_sort(F.concat("base", kind(passed, "random"))).alias("spans"), *["row"] * whole)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def counts(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(name))).cast("long")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each maximal run of overlapping spans replaced by ``mask``.

    The text is cut once into blocks, so that what lies between two runs is taken from its own
    blocks and not searched for from the start."""

    def between(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(near, start - first * BLOCK + 1, end - start)).otherwise("")

    def rebuilt(v: Column) -> Column:
        blocks, reach = v["blocks"], v["reach"]
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))  # noqa: E731  where the spans before end
        begins = F.filter(F.transform(v["spans"], lambda s, i: F.struct(before(i).alias("from"), s["start"].alias("to"))), lambda g: g["to"] >= g["from"])
        kept = F.transform(begins, lambda g: between(blocks, g["from"], g["to"]))
        return F.concat(F.array_join(kept, mask), F.lit(mask), between(blocks, F.get(reach, F.size(reach) - 1), v["n"]))

    parts = F.struct(
        spans.alias("spans"),
        running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("reach"),
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)).alias("blocks"),
        F.char_length(text).alias("n"),
    )
    return F.when(F.size(spans) > 0, let(parts, rebuilt)).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with every span masked; n_chars, if there, follows the text."""
    rows = scan(docs, whole=True)
    rows = rows.select("row", "spans", redacted(F.col("row.text"), F.col("spans")).alias("text"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        old = F.col("row").getField(name)
        if name == "n_chars":
            old = F.when(F.size("spans") > 0, F.char_length("text").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return rows.select(*map(column, docs.columns))
