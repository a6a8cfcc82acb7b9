"""Secret scans: known formats, and a battery of randomness tests on other strings.

Long runs of letters, digits and the signs of common encodings are candidates. The smallest
alphabet that has all signs of a candidate is its inferred encoding; its signs become numbers.
Three tests ask whether the numbers can be uniform and independent draws: chi-squared over the
signs of the alphabet, runs above and below the middle, and serial correlation.
Their three probabilities are combined by Fisher's method.

Text is not random, so its probability is tiny. Discarding a candidate as text is a discovery, and
the Benjamini-Hochberg rule per class of length keeps the share of random strings among the
discarded below ``FALSE_SHARE``: short strings, which prove little, need stronger evidence where
few of them are text. What is left is reported as a secret.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stage
from .registry import query

# Formats of secrets. Group 2 of the first is the value.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

MATCHES = "array<struct<skipped:int,length:int,good:boolean,match:string>>"
#: In lower case, one of these is in every text with an assignment.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A run of signs that encodings use, as long as it goes, of 20 signs or more.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
# Encodings and their signs in order of value.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("[0-9a-f]+", DIGITS + "abcdef"),
    ("[0-9A-F]+", DIGITS + "ABCDEF"),
    ("[A-Z2-7]+", UPPER + "234567"),
    ("[0-9a-z]+", DIGITS + LOWER),
    ("[0-9A-Z]+", DIGITS + UPPER),
    ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
    ("[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    (".+", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Of the candidates discarded as text, no more than this share is random.
FALSE_SHARE = 0.05
#: Probabilities are counted in steps of a twentieth of a power of ten, down to 10 ** -16.
STEPS, POWERS = 20, 16


def found_in(text: Column, may: Column, pattern: str, value: int = 0, least: int = 1) -> Column:
    """Every match of a pattern: characters since the match before, length, whether the value is as
    long as ``least``, and the match.

    Pieces between matches and the matches themselves are zipped, so each is cut out once. ``may``
    is a cheap test that every text with a match passes.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"),
    )
    matches = F.filter(parts, lambda p: p["match"].isNotNull())
    found = F.transform(matches, lambda p: F.struct(
        F.length(p["between"]).alias("skipped"), F.length(p["match"]).alias("length"),
        (F.length(p["value"]) >= least).alias("good"), p["match"].alias("match"),
    ))
    return F.when(may, found).otherwise(F.array().cast(MATCHES))


def _tail(z: Column) -> Column:
    """Probability that a standard normal number exceeds z (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / F.lit(2.0)
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def with_probability(candidates: DataFrame) -> DataFrame:
    """Add ``p``: how likely a random string is to look as little random as ``match``."""
    sign = F.col("match")
    alphabet = F.coalesce(*[F.when(sign.rlike(f"^(?:{p})$"), F.lit(a)) for p, a in ENCODINGS])
    df = candidates.withColumn("alphabet", alphabet).withColumn("k", F.length("alphabet"))
    df = df.withColumn("v", F.expr(
        "transform(filter(split(match, ''), c -> c <> ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    df = df.withColumn("n", F.size("v").cast("double"))
    # Sums of squared counts of each sign; expected counts are equal, so this is chi-squared.
    df = df.withColumn("chi", F.expr(
        "aggregate(transform(sequence(1, k), i -> length(match) - length(replace(match, substring(alphabet, i, 1), ''))),"
        " 0D, (a, x) -> a + x * x) * k / n - n"))
    free = F.col("k") - 1
    spread = F.lit(2.0) / (F.lit(9.0) * free)
    df = df.withColumn("z_chi", (F.pow(F.col("chi") / free, 1 / 3) - (F.lit(1.0) - spread)) / F.sqrt(spread))
    df = df.withColumn("high", F.expr("transform(v, x -> if(x >= k / 2, 1, 0))"))
    df = df.withColumn("n1", F.expr("aggregate(high, 0, (a, x) -> a + x)").cast("double"))
    df = df.withColumn("n0", F.col("n") - F.col("n1"))
    df = df.withColumn("runs", F.expr(
        "1D + aggregate(zip_with(slice(high, 1, size(high) - 1), slice(high, 2, size(high) - 1),"
        " (a, b) -> if(a = b, 0, 1)), 0, (a, x) -> a + x)"))
    both = F.lit(2.0) * F.col("n1") * F.col("n0")
    df = df.withColumn("z_runs", F.when(both > 0, (F.col("runs") - (both / F.col("n") + 1)) / F.sqrt(
        F.greatest(F.lit(1e-9), both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))))))
    df = df.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x)") / F.col("n"))
    df = df.withColumn("spread", F.expr("aggregate(v, 0D, (a, x) -> a + power(x - mean, 2))"))
    df = df.withColumn("z_serial", F.expr(
        "if(spread = 0, null, sqrt(n) * (1 / n + aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1),"
        " (a, b) -> (a - mean) * (b - mean)), 0D, (a, x) -> a + x) / spread))"))
    sided = [F.lit(2.0) * _tail(F.abs(F.col(z))) for z in ("z_runs", "z_serial")]
    # Fisher's sum of three logarithms; a string of one sign only has no runs and no correlation.
    parts = [_tail(F.col("z_chi")), *[F.coalesce(p, F.lit(0.0)) for p in sided]]
    h = -sum((F.log(F.greatest(p, F.lit(10.0 ** -POWERS))) for p in parts[1:]),
             F.log(F.greatest(parts[0], F.lit(10.0 ** -POWERS))))
    df = df.withColumn("h", h)
    return df.withColumn("p", F.expr("exp(-h) * (1 + h + h * h / 2)")).select(*candidates.columns, "p")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, rank, kind, end).

    Kinds are assign, access, hex and random, ranked in this order; positions count characters, the
    end is exclusive. Spans of different kinds may overlap. A null text counts as empty; repeated
    rows are scanned one by one; an empty table gives an empty result.
    """
    # A byte string that isn't UTF-8 is out of scope: text columns hold UTF-8.
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyword = reduce(lambda a, b: a | b, [F.contains("lowered", F.lit(k)) for k in KEYWORDS])
    # A run of hexadecimal digits is part of a run of any signs, so one search settles both.
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("body"), F.lower(body).alias("lowered"))
    tested = texts.select("doc_id", "body", keyword.alias("keyword"),
                          F.contains("body", F.lit("AKIA")).alias("akia"), F.col("body").rlike(RUN).alias("run"))
    body = F.col("body")
    rows = stage(tested.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        found_in(body, F.col("keyword"), ASSIGN, 2, 6).alias("assign"),
        found_in(body, F.col("akia"), ACCESS, 0, 20).alias("access"),
        found_in(body, F.col("run"), HEX, 0, 24).alias("hex"),
        found_in(body, F.col("run"), RUN, 0, 20).alias("random"),
    ))
    matches = None
    for rank, kind in enumerate(KINDS):
        some = rows.where(F.size(kind) > 0).select(
            "row", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("nth", "m"),
        ).select("row", "rank", "kind", "nth", "m.*")
        matches = some if matches is None else matches.unionByName(some)
    upto = Window.partitionBy("row", "rank").orderBy("nth")
    placed = (
        matches.withColumn("end", F.sum(F.col("skipped") + F.col("length")).over(upto))
        .withColumn("start", F.col("end") - F.col("length")).where("good")
        .select("row", "rank", "kind", "start", "end", "match")
    )
    known = placed.where("kind <> 'random'").drop("match")
    tried = with_probability(placed.where("kind = 'random'")).withColumn(
        "class", F.floor(F.log2(F.length("match").cast("double"))).cast("int")
    ).withColumn("step", F.least(F.lit(STEPS * POWERS), F.floor(
        -F.log10(F.greatest(F.col("p"), F.lit(10.0 ** -POWERS))) * STEPS)).cast("int"))
    # At most 321 steps in each of some 20 classes, whatever the number of candidates.
    steps = tried.groupBy("class", "step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("class").orderBy(F.col("step").desc())
    whole = Window.partitionBy("class")
    limit = (
        steps.withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum("n").over(whole))
        .where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= F.lit(false_share) * F.col("upto") / F.col("all"))
        .groupBy("class").agg(F.min("step").alias("text_from"))
    )
    random = (
        tried.join(F.broadcast(limit), "class", "left")
        .where(F.col("text_from").isNull() | (F.col("step") < F.col("text_from")))
        .select("row", "rank", "kind", "start", "end")
    )
    spans = known.unionByName(random).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans"))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))

    def named(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
        count("random").alias("n_random"),
    )
