"""URL filter: block and allow rules first, then a logistic regression on hashed
character n-grams of host and path. DataFrame functions only.

Training works on a small labelled table, or a sample of ``most`` of its rows. Its gradient descent runs in the dual: the weight vector is a sum of the
labelled rows' feature vectors, so each step updates one coefficient a row from the
table's Gram matrix; the weights of the hash buckets, a bounded array, follow from the
coefficients. Scoring is one projection of the url column, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Hash buckets, n-gram lengths, labelled rows at most, and gradient steps.
BUCKETS, GRAMS, MAX_LABELLED, STEPS = 4096, (3, 4, 5), 512, 200
RATE, DECAY = 2.0, 0.002

#: Rules: (host, path prefix, verdict). A host stands for its subdomains too.
RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]

_BAD = ["casino", "casino-win", "win-casino", "bets", "free-bets", "best-bets", "poker-win", "slots-free", "pills", "cheap-pills", "pills-cheap", "cheap-meds", "adult", "adult-x", "x-adult", "xxx-cams", "spam", "spam-farm", "link-farm", "ads", "ads-track", "track-ads", "click-track", "free-win"]
_GOOD = ["news", "library", "museum", "weather", "school", "garden", "history", "science", "recipes", "travel", "music", "maps", "physics", "theater", "other", "nation", "thing", "heron", "tenor", "station", "reader", "therein", "another", "inland"]
_HOSTS = ["{}.example.com", "www.{}.example.net", "blog.{}.example.org", "m.{}.example.com"]
_PATHS = ["/en/12", "/de/904", "/fr/33.html", "/es/7?page=2"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table ``(url, bad)``: invented hosts, half to block."""
    rows = [(f"http://{_HOSTS[(i + k) % 4].format(w)}{_PATHS[(i + 2 * k) % 4]}", bad) for bad, words in ((1, _BAD), (0, _GOOD)) for i, w in enumerate(words) for k in (0, 1)]
    return spark.createDataFrame(rows, "url string, bad int")


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased. Path: then
    up to ? or #. Both are empty for a null url or one without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _grams(host: Column, path: Column) -> Column:
    """Hash buckets of the n-grams of ``^host$`` and ``|path``; a place's own prefix
    keeps the two apart."""
    parts = []
    for text, seed in ((F.concat(F.lit("^"), host, F.lit("$")), 1), (F.concat(F.lit("|"), path), 2)):
        for n in GRAMS:
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _bucket_at(text, n, seed)))
    return F.concat(*parts)


def _bucket_at(text: Column, n: int, seed: int) -> Callable[[Column], Column]:
    return lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n)), F.lit(seed)), F.lit(BUCKETS)).cast("int")


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def train(labelled: DataFrame, most: int = MAX_LABELLED) -> tuple[list[float], float]:
    """Weights of the buckets and the bias, from ``(url, bad)``; bad: 1 to block, 0 to
    allow, other values and null urls take no part. An empty table gives zero weights.
    Of more than ``most`` different rows a sample of so many is fitted, the first by a hash
    of the row: the descent holds their Gram matrix.

    A url's features are its n-gram counts divided by their Euclidean norm, so a Gram
    matrix entry is a cosine.
    """
    host, path = url_parts("url")
    rows = labelled.filter("url is not null and bad in (0, 1)").select("url", "bad").distinct()
    rows = materialize(rows.orderBy(F.xxhash64("url", "bad"), "url", "bad").limit(most), "url-labelled")
    n = rows.count()
    if not n:
        return [0.0] * BUCKETS, 0.0
    numbered = rows.withColumn("i", F.row_number().over(Window.orderBy("url", "bad")) - 1)
    counts = numbered.select("i", F.explode(_grams(host, path)).alias("bucket")).groupBy("i", "bucket").agg(F.count("*").alias("c"))
    norms = counts.groupBy("i").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    features = materialize(counts.join(norms, "i").select("i", "bucket", (F.col("c") / F.col("norm")).alias("x")), "url-features")
    other = features.select(F.col("i").alias("j"), "bucket", F.col("x").alias("z"))
    gram = features.join(other, "bucket").groupBy("i", "j").agg((F.sum(F.col("x") * F.col("z")) + 1.0).alias("g"))
    gram = gram.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "g"))).alias("g"))
    line = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("g", j), F.lit(1.0)))
    lines = numbered.join(gram, "i", "left").select("i", "bad", line.alias("g"))
    table = lines.agg(F.array_sort(F.collect_list(F.struct("i", "bad", "g"))).alias("t"))
    table = materialize(table, "url-gram")  # else the steps below would evaluate it anew

    def step(coefficients: Column, _: Column) -> Column:
        def moved(c: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(F.get(F.col("t"), i)["g"], coefficients, lambda g, w: g * w), F.lit(0.0), lambda s, v: s + v)
            return c * (1.0 - DECAY * RATE) + RATE / n * (F.get(F.col("t"), i)["bad"] - _sigmoid(margin))

        return F.transform(coefficients, moved)

    fitted = table.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("t", lambda _: F.lit(0.0)), step).alias("a"))
    fitted = materialize(fitted.select(F.posexplode("a").alias("i", "a")), "url-fit")
    weights = [0.0] * BUCKETS
    for bucket, w in features.join(fitted, "i").groupBy("bucket").agg(F.sum(F.col("a") * F.col("x"))).collect():  # BUCKETS rows at most
        weights[bucket] = w
    return weights, fitted.agg(F.sum("a")).head()[0]


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest comes last, so it wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def filter_urls(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, probability)``, a row for each input row.

    verdict: the longest fitting rule's, else block where the model's probability is
    0.5 or more, else allow. A null, empty or malformed url has empty host and path,
    fits no rule and is judged by the model like any other text; long urls are judged
    whole; repeated rows are judged alike; other columns are ignored; an empty table gives no
    rows.
    """
    weights, bias = model
    array = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    host, path = url_parts("url")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    grams = parts.withColumn("grams", F.array_sort(_grams(F.col("host"), F.col("path"))))
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(array, b))
    # equal neighbours in the sorted buckets: the sum of squared counts is the number of equal pairs
    squares = F.aggregate(
        "grams",
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda s, b: F.struct(b.alias("last"), F.when(b == s["last"], s["run"] + 1.0).otherwise(1.0).alias("run"), (s["sum"] + F.when(b == s["last"], 2.0 * s["run"] + 1.0).otherwise(1.0)).alias("sum")),
        lambda s: s["sum"],
    )
    scored = grams.withColumn("probability", _sigmoid(total / F.sqrt(F.greatest(squares, F.lit(1.0))) + F.lit(bias)))
    judged = F.coalesce(verdict, F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", text.alias("rule"), judged.alias("verdict"), "probability")
