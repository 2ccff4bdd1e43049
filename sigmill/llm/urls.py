"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

All of it is DataFrame and SQL expressions inside the JVM. The model is fitted with the DataFrame-based ML library on a
small labelled table of URLs (at most ``MAX_LABELLED`` rows are taken, the first by hash of the URL) and comes back as
``2 ** BITS`` weights, a size that no input changes. Pages are scored in place, without a shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule fits it, and the model judges
it by its intercept; repeated rows are judged each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import json
from importlib import resources

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 13
SIZES = (3, 4, 5)
MAX_LABELLED = 10_000
MAX_INLINE_RULES = 500

#: (verdict, host, path); a rule stands for its host and all subdomains.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

_FRONT = ["", "www.", "blog.", "m."]
_BACK = ["/en/12", "/de/3.html", "/fr/88/", "/es/4", "/en/22089.html", "/en/703/", "/de/6151", "/", "/es/978.html"]


def labelled_sites() -> list[tuple[float, str]]:
    """(1 to block or 0 to allow, host) from the data file."""
    lines = resources.files("sigmill.llm").joinpath("data/labelled_sites.txt").read_text("utf-8").splitlines()
    return [(float(x[0]), x[2:]) for x in lines if x and not x.startswith("#")]


def labelled_urls(spark: SparkSession, sites: list[tuple[float, str]] | None = None) -> DataFrame:
    """url string, label double: the labelled table of the sites (the data file's by default). Each stands with several
    subdomains and paths, the same for both kinds, so that these tell nothing."""
    sites = labelled_sites() if sites is None else sites
    rows = [(f"https://{_FRONT[(k + j) % 4]}{host}{_BACK[(k + 2 * j) % 9]}", label) for kind in (1.0, 0.0) for k, (label, host) in enumerate(x for x in sites if x[0] == kind) for j in range(4)]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {label}D)" for u, label in rows) + " AS t(url, label)")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def slots(host: Column, path: Column) -> Column:
    """The distinct hashed character n-grams of a host and a path, each end marked."""

    def grams(text: Column, kind: str, n: int) -> Column:  # by looking ahead from each place: time in proportion to the text
        all_ = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(all_, lambda g: F.pmod(F.xxhash64(F.lit(kind), g), F.lit(1 << BITS)).cast("int"))

    return F.array_distinct(F.concat(*(grams(t, k, n) for t, k in ((host, "h"), (path, "p")) for n in SIZES)))


def fit(labelled: DataFrame, ridge: float = 0.003) -> tuple[list[float], float]:
    """Weights by slot, and the intercept, from (url, label) rows."""
    few = labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull()).orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED)
    on = slots(host_of(F.col("url")), path_of(F.col("url")))
    rows = few.select("label", on.cast("array<string>").alias("on")).coalesce(1)
    terms = CountVectorizer(inputCol="on", outputCol="features", binary=True, minDF=1.0, vocabSize=1 << BITS).fit(rows)
    model = LogisticRegression(maxIter=40, regParam=ridge, standardization=False).fit(terms.transform(rows))
    weights = [0.0] * (1 << BITS)
    for term, w in zip(terms.vocabulary, model.coefficients.toArray()):
        weights[int(term)] = round(float(w), 9)
    return weights, float(model.intercept)


def score(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """Probability that a URL should be blocked. The weights are one array literal of a fixed size."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(slots(host, path), F.lit(intercept), lambda s, k: s + F.get(table, k))
    return 1 / (1 + F.exp(-total))


def rule_inline(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null; for a short list."""
    found = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    if not found:
        return F.expr("cast(null as struct<size:int,rule:string,verdict:string>)")
    return F.array_max(F.array(*found)) if len(found) > 1 else found[0]


def rule_joined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the column fit as rule_inline does, for any number of rules (verdict, host, path).

    Each distinct host and path meets the rules of its host's suffixes by equality, so a frequent site is joined once.
    """
    host = F.col("host")
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    urls = pages.select("host", "path").distinct()
    near = urls.withColumn("_suffix", F.explode(suffixes)).join(rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_path"), "verdict"), "_suffix")
    best = F.max(F.struct(F.length(F.concat("_suffix", "_path")).alias("size"), F.concat("_suffix", "_path").alias("rule"), "verdict"))
    fits = near.filter(F.col("path").startswith(F.col("_path"))).groupBy("host", "path").agg(best.alias("fit"))
    return pages.join(fits, ["host", "path"], "left")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] | DataFrame = RULES, threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the model) for each row."""
    weights, intercept = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    df = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(rules, list) and len(rules) > MAX_INLINE_RULES:
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    df = df.withColumn("fit", rule_inline(F.col("host"), F.col("path"), rules)) if isinstance(rules, list) else rule_joined(df, rules)
    df = df.withColumn("score", score(F.col("host"), F.col("path"), weights, intercept))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return df.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigmill.llm.workspace import table

    return judge(table(spark, sf_dir, "pages"))
