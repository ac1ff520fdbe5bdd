"""Secret scans; DataFrame operations only.

Base spans come from three patterns. The method adds strings that look drawn at random. `=` belongs to a string only as its
final padding, and `+` or `/` never stand together with `-` or `_`, so three scans cut a text into strings of 20 or more
characters (padding counts): the longest runs of base64, those of base64url that have a `-` or `_`, and those of letters and
digits next to a `+` or `/`. Thus KEY=value and parts of paths are tested by themselves, and no string is tested twice. Each
goes through a battery of tests over the alphabet of the encoding inferred for it. Of the strings called, those that lie
within another one are left out.

* chi-squared: its symbols, in bins of equal size, against a uniform alphabet
* runs: the number of runs above and below the middle of the alphabet (Wald-Wolfowitz)
* serial correlation of neighbouring symbols

A string passes if none of the three rejects randomness (Bonferroni, level LEVEL). Short natural strings may pass by chance,
so false discoveries are controlled with regard to length: in natural text the chi-squared statistic is noncentral, with
a noncentrality of SKEW per character. The chance p of a statistic as small as the observed one under that law shrinks with the
length. The strings of the corpus are cut on p per group, as Benjamini and Hochberg do at RATE, from counts per bin of log p. A group
has one encoding, one band of lengths and the same classes of characters (capitals, small letters, digits, signs), so paths
and words do not hide rare secrets. Where almost all strings of a group are natural, a short secret among them stays
uncalled: 20 random characters of base64 have a p of about 0.02, 40 of 0.001.

Scale: one scan reads the texts and keeps only the strings found, with the lengths of the gaps before them. Places are
running sums per row and kind; the cuts need one table with at most 301 counts for each of 975 groups. Decimal strings are numbers, not tested.

Defined results: a null text is empty. Rows that repeat an id, or a whole row, are scanned one by one. Other columns are
not looked at. A text's strings meet in one row of the result, as the text itself does.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablens.session import stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
_PADDING = r"(?![A-Za-z0-9+/_=-])"
_SIZED = rf"(?:%s{{20,}}+(?:={{1,2}}{_PADDING})?|%s{{19}}={{1,2}}{_PADDING}|%s{{18}}=={_PADDING})"
STRINGS = (
    r"(?<![A-Za-z0-9+/])" + _SIZED.replace("%s", "[A-Za-z0-9+/]"),
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*+[_-])" + _SIZED.replace("%s", "[A-Za-z0-9_-]"),
    r"(?<![A-Za-z0-9])(?:(?<=[+/])[A-Za-z0-9]{20,}+|[A-Za-z0-9]{20,}+(?=[+/]))",
)
KINDS = ("assign", "access", "hex", "random")
SCANS = (*KINDS[:3], *(f"random{k}" for k in range(len(STRINGS))))
MIN_ASSIGNED = 12
LEVEL = 0.01
RATE = 0.05
# A string confined to half of its alphabet has a noncentrality of 1 per character.
SKEW = 1.0
BINS = 8
_LOG_STEP = 0.1
# Lengths from 20 on, in bands of a factor of the square root of 2; the last one is open.
_LAST_BAND = 12
_CLASSES = ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")
_LETTERS = string.ascii_uppercase + string.ascii_lowercase
# Encodings from the narrowest on: pattern of the whole string, alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", string.ascii_uppercase + "234567"),
    ("^[A-Za-z0-9+/]+$", _LETTERS + string.digits + "+/"),
    ("^[A-Za-z0-9_-]+$", _LETTERS + string.digits + "-_"),
)


def _found(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """For each match: characters between the previous match and it, its own characters, and the matched string."""
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.char_length(piece))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep is None else matches
    found = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(matches)), F.arrays_zip(matches.alias("whole"), second.alias("value")),
        lambda gap, m: F.struct(gap.alias("gap"), F.char_length(m["whole"]).alias("size"), m["value"].alias("value")),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


def _strings(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per document: row, doc_id and the matches of each kind."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    whole = F.lit(True)
    return documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"),
        _found(text, ASSIGN).alias("assign"), _found(text, ACCESS, whole).alias("access"),
        _found(text, HEX, whole).alias("hex"), *[_found(text, pattern, whole).alias(name) for name, pattern in zip(SCANS[3:], STRINGS)],
    )


def _placed(rows: DataFrame) -> DataFrame:
    """One row per match: row, kind (its number), start, stop, value."""
    each = None
    for number, scan in enumerate(SCANS):
        part = rows.filter(F.col(scan).isNotNull()).select("row", F.lit(number).alias("scan"), F.posexplode(scan).alias("i", "m"))
        each = part if each is None else each.unionByName(part)
    upto = Window.partitionBy("row", "scan").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("m.gap") + F.col("m.size")).over(upto)
    kind = F.least("scan", F.lit(len(KINDS) - 1)).alias("kind")
    return each.select("row", kind, (stop - F.col("m.size")).alias("start"), stop.alias("stop"), F.col("m.value").alias("value"))


def normal_cdf(z: Column) -> Column:
    """The normal distribution by a logistic function of a cubic, right to 0.0002; its lower tail stays positive."""
    bounded = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-1.5976 * bounded - 0.07056 * F.pow(bounded, F.lit(3))))


def battery(strings: DataFrame) -> DataFrame:
    """`strings` (with a column value) with p_random (the battery), p_natural (the length-aware chance) and group.

    The p values are null for decimal strings and for those in no known encoding.
    """
    core = F.rtrim(F.col("value"), F.lit("="))
    alphabet = F.when(F.regexp_like("core", F.lit("^[0-9]*$")), F.lit(None).cast("string"))
    for pattern, letters in ENCODINGS:
        alphabet = alphabet.when(F.regexp_like("core", F.lit(pattern)), F.lit(letters))
    coded = strings.withColumn("core", core).withColumn("alphabet", alphabet).withColumn(
        "x", F.transform(F.filter(F.split("core", ""), lambda c: c != ""), lambda c: F.position(c, F.col("alphabet")) - 1)
    ).withColumn("n", F.size("x").cast("double")).withColumn("m", F.char_length("alphabet").cast("double"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    count = lambda k: F.size(F.filter("x", lambda v: F.floor(v * BINS / F.col("m")) == k)).cast("double")
    expected = F.col("n") / BINS
    chi = sum((F.pow(count(k) - expected, F.lit(2)) / expected for k in range(1, BINS)), F.pow(count(0) - expected, F.lit(2)) / expected)
    high = F.transform("x", lambda v: (v * 2 >= F.col("m")).cast("int"))
    pairs = lambda values: F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    stats = coded.withColumn("chi", chi).withColumn("high", high).withColumns({
        "ones": total(F.transform("high", lambda v: v.cast("double"))),
        "mean": total(F.transform("x", lambda v: v.cast("double"))) / F.col("n"),
    }).withColumns({
        "runs": 1 + F.size(F.filter(pairs(F.col("high")), lambda p: p["a"] != p["b"])),
        "spread": total(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))),
        "lagged": total(F.transform(pairs(F.col("x")), lambda p: (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))),
    })
    df = BINS - 1
    # Wilson-Hilferty for the upper tail of chi-squared.
    z_chi = (F.pow(F.col("chi") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    zeros = F.col("n") - F.col("ones")
    twice = 2 * F.col("ones") * zeros
    spread_runs = twice * (twice - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    # All symbols in one half, or all equal: as far from random as can be.
    z_runs = F.when(spread_runs > 0, (F.col("runs") - twice / F.col("n") - 1) / F.sqrt(spread_runs)).otherwise(F.lit(8.0))
    z_serial = F.when(F.col("spread") > 0, F.col("lagged") / F.col("spread") * F.sqrt("n")).otherwise(F.lit(8.0))
    two_sided = lambda z: 2 * normal_cdf(-F.abs(z))
    least = F.least(normal_cdf(-z_chi), two_sided(z_runs), two_sided(z_serial))
    beyond = F.lit(SKEW) * F.col("n")
    natural = normal_cdf((F.col("chi") - df - beyond) / F.sqrt(2 * df + 4 * beyond))
    known = F.col("alphabet").isNotNull()
    band = F.least(F.lit(_LAST_BAND), F.greatest(F.lit(0), F.floor(2 * F.log2(F.col("n") / 20)))).cast("int")
    classes = sum((F.regexp_like("core", F.lit(c)).cast("int") * (1 << k) for k, c in enumerate(_CLASSES)), F.lit(0))
    return stats.select(
        *strings.columns, F.when(known, F.least(F.lit(1.0), 3 * least)).alias("p_random"), F.when(known, natural).alias("p_natural"),
        F.concat_ws(" ", "alphabet", band, classes).alias("group"),
    )


def natural_cuts(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """Benjamini-Hochberg cut on p_natural within each group, to a bin of log p; groups of which none may be called are left out."""
    counts = tested.filter(F.col("p_natural").isNotNull()).select(
        "group", F.ceil(F.log10(F.greatest(F.col("p_natural"), F.lit(1e-30))) / _LOG_STEP).cast("int").alias("bin"),
        (F.col("p_random") >= LEVEL).alias("passed"),
    ).groupBy("group", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))
    whole = Window.partitionBy("group")
    called = F.sum("passed").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = counts.select("group", called.alias("called"), F.sum("n").over(whole).alias("n"), F.pow(F.lit(10.0), F.col("bin") * _LOG_STEP).alias("edge"))
    may = (F.col("called") > 0) & (F.col("edge") <= F.lit(rate) * F.col("called") / F.col("n"))
    return edges.filter(may).groupBy("group").agg(F.max("edge").alias("cut"))


def _outermost(strings: DataFrame) -> DataFrame:
    """The strings that lie within no other one of their row."""
    before = Window.partitionBy("row").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    reached = strings.withColumn("reached", F.max("stop").over(before))
    return reached.filter(F.col("reached").isNull() | (F.col("stop") > F.col("reached"))).drop("reached")


def find_secrets(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, kind, stop) by start and kind.

    kind is a number in KINDS; places are code points, stop exclusive.
    """
    rows = stored(_strings(documents, id_column, text_column), "strings")
    placed = _placed(rows)
    base = placed.filter((F.col("kind") == 1) | (F.col("kind") == 2) | ((F.col("kind") == 0) & (F.char_length("value") >= MIN_ASSIGNED)))
    tested = stored(battery(placed.filter(F.col("kind") == 3)), "tested")
    passed = tested.filter(F.col("p_random") >= LEVEL).join(F.broadcast(natural_cuts(tested)), "group")
    random = _outermost(passed.filter(F.col("p_natural") <= F.col("cut")))
    columns = ["row", "start", "kind", "stop"]
    spans = base.select(*columns).unionByName(random.select(*columns)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans")
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
