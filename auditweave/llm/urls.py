"""URL filter: fixed rules by host and path, and gradient-boosted trees on lexical features for the rest.

Only DataFrame operations and the DataFrame-based learner run here. The trees learn from URLs that a
rule decides: these are the labelled ones.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Labelled URLs of each class that the trees are fitted on, at most.
PER_CLASS = 5000
TREES, DEPTH = 10, 3
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "host_entropy", "path_entropy", "n_parameters", "query_length",
    "hyphens", "labels", "longest_label", "suffix_seen", "suffix_blocked", "domain_seen", "domain_blocked",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) as page_id, url, host, path and the rest behind the path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", i)
    return pages.select("page_id", url.alias("url"), F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"), part(3).alias("query"))


def with_rules(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``parts`` with ``rule`` and ``decided``, those of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, decision in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return parts.withColumn("rule", name).withColumn("decided", verdict)


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def _suffixes() -> dict[str, Column]:
    labels = F.split("host", r"\.")
    return {"suffix": F.element_at(labels, -1), "domain": F.concat_ws(".", F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2)))}


def lexical(parts: DataFrame, labelled: DataFrame) -> DataFrame:
    """``parts`` with the columns ``FEATURES``; suffix statistics are those of ``labelled`` (host, decided).

    How often a suffix and a domain are labelled, and the smoothed share of blocked ones, come from counts
    over all labelled rows; the row's own label is not taken out, so the shares are smoothed by 20.
    """
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "query"))
    digits = F.regexp_count(url, F.lit("[0-9]"))
    out = parts.withColumns(_suffixes()).withColumns(
        {
            "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
            "depth": F.regexp_count(path, F.lit("/[^/]")), "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
            "host_entropy": _entropy(host), "path_entropy": _entropy(path),
            "n_parameters": F.regexp_count(query, F.lit(r"[?&][^&#]")), "query_length": F.length(query),
            "hyphens": F.regexp_count(host, F.lit("-")), "labels": F.size(F.split(host, r"\.")),
            "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
        }
    )
    for key, column in _suffixes().items():
        blocked = F.sum((F.col("decided") == "block").cast("int"))
        counts = labelled.select(column.alias(f"{key}_at"), "decided").groupBy(f"{key}_at").agg(F.count("*").alias("n"), blocked.alias("blocked"))
        counts = counts.select(f"{key}_at", F.log1p("n").alias(f"{key}_seen"), ((F.col("blocked") + 10) / (F.col("n") + 20)).alias(f"{key}_blocked"))
        out = out.join(counts, out[key] == counts[f"{key}_at"], "left").drop(f"{key}_at")
    return out.fillna({"suffix_seen": 0.0, "suffix_blocked": 0.5, "domain_seen": 0.0, "domain_blocked": 0.5}).withColumns({f: F.col(f).cast("double") for f in FEATURES})


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, per_class: int = PER_CLASS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): a row per row of ``pages`` (page_id, url).

    The verdict is that of the longest fitting rule. Without one it is ``block`` where the trees' probability
    of blocking is above one half, else ``allow``. A URL that is null or has no ``://`` has an empty host
    and path and is judged by the trees like any other. If the rules label URLs of one class only, or none, the
    trees are not grown, the others are allowed and ``block_score`` is null. Only page_id and url are read.
    """
    parts = with_rules(split_url(pages), rules)
    labelled = parts.filter("decided is not null")
    known = lexical(labelled, labelled).withColumn("label", (F.col("decided") == "block").cast("double"))
    order = F.xxhash64("url", "page_id")
    sides = [known.filter(F.col("label") == side).orderBy(order, "page_id").limit(per_class).select(*FEATURES, "label") for side in (0.0, 1.0)]
    sample = sides[0].unionByName(sides[1]).persist()
    verdict = lambda other: F.coalesce(F.col("decided"), other)
    if sample.select("label").distinct().count() < 2:
        sample.unpersist()
        return parts.select("page_id", "host", "path", "rule", verdict(F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, maxBins=16, stepSize=0.3, seed=5).fit(gather.transform(sample))
    sample.unpersist()
    scored = model.transform(gather.transform(lexical(parts, labelled)))
    return scored.select("page_id", "host", "path", "rule", verdict(F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"), F.element_at(vector_to_array("probability"), 2).alias("block_score"))
