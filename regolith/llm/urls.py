"""URL filters: rules by host and path, then logistic regression on hashed character n-grams.

The regression is trained on a small labelled table (made by a rule from the words in url_words.txt, or any table of url
and block) with the DataFrame API of spark.ml; no Python runs on the executors.

Defined results: a null url or one without :// has an empty host and path, no rule and the method's verdict for empty
text; an empty table gives no rows; repeated rows and null ids each get their row; urls of any length are read whole;
further columns may have any name.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (rule, verdict); a rule is host/path-prefix.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: What the labelled table is made of: words, common words and paths of hosts to block and to allow.
WORDS = Path(__file__).with_name("url_words.txt")
FEATURES = 1 << 16
REGULARIZATION = 0.003
#: Probability from which the model's verdict is to block; see the README for how it does on labelled hosts held out.
THRESHOLD = 0.25
_SUBDOMAINS = ("", "www.", "m.", "blog.", "shop.")
_ENDS = ("com", "net", "org", "de", "info", "fr", "es", "co.uk", "example.com", "example.net", "example.org")


def labelled_urls(path: Path = WORDS) -> list[tuple[str, int]]:
    """(url, block): each word alone and with others, in the forms that hosts have, and with a path of its kind."""
    parts: dict[str, list[str]] = {}
    for line in path.read_text().splitlines()[1:]:
        if line.startswith("["):
            name = line.strip("[]")
        elif line:
            parts.setdefault(name, []).extend(line.split())
    out = []
    for kind, block in (("block", 1), ("allow", 0)):
        words, common, paths = parts[kind], parts[f"{kind} common"], parts[f"{kind} paths"]
        for i, w in enumerate(words):
            near, far = words[(i + 1) % len(words)], words[(7 * i + 29) % len(words)]
            other, more = common[i % len(common)], common[(5 * i + 3) % len(common)]
            for j, name in enumerate((f"{w}-{far}", f"{other}-{w}", f"{w}{more}", f"{near}{w}", f"{w}-{more}", f"{far}{w}", f"{w}{other}", w)):
                k = 8 * i + j
                out.append((f"http{'s' * (k % 2)}://{_SUBDOMAINS[(3 * k + i) % len(_SUBDOMAINS)]}{name}.{_ENDS[(7 * k + i) % len(_ENDS)]}{paths[(5 * k + i) % len(paths)]}", block))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, block int")


def split(table: DataFrame, of: int = 5) -> tuple[DataFrame, DataFrame]:
    """The labelled rows of four fifths of the hosts, and of the others, by a hash of the host."""
    out = F.pmod(F.xxhash64(host_and_path(F.col("url"))[0]), F.lit(of)) == 0
    return table.filter(~out), table.filter(out)


def measure(judged: DataFrame, threshold: float = THRESHOLD) -> dict[str, float]:
    """Precision and recall of (block, block_score) rows."""
    said = F.col("block_score") > threshold
    r = judged.agg(F.count_if(said & (F.col("block") == 1)).alias("hit"), F.count_if(said).alias("said"), F.count_if(F.col("block") == 1).alias("true")).first()
    return {"precision": r["hit"] / max(r["said"], 1), "recall": r["hit"] / max(r["true"], 1)}


def ngrams(host: Column, path: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams of host and of path, each marked with its part."""
    parts = []
    for mark, part in (("h:", F.concat(F.lit("^"), host, F.lit("$"))), ("p:", F.concat(F.lit("^"), F.translate(path, UPPER, LOWER), F.lit("$")))):
        for n in range(least, most + 1):
            places = F.when(F.length(part) >= n, F.sequence(F.lit(1), F.length(part) - n + 1)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(places, _gram(mark, part, n)))
    return F.flatten(F.array(*parts))


def _gram(mark: str, part: Column, n: int):
    return lambda i: F.concat(F.lit(mark), F.substring(part, i, F.lit(n)))


def features(df: DataFrame, url_col: str) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    df = df.withColumns({"host": host, "path": path})
    df = df.withColumn("_grams", ngrams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(df).drop("_grams")


def train(table: DataFrame, url_col: str = "url", label_col: str = "block", reg: float = REGULARIZATION) -> LogisticRegressionModel:
    """Fit on the labelled table, which is small by contract."""
    return LogisticRegression(featuresCol="_features", labelCol=label_col, regParam=reg, maxIter=100, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction").fit(features(table.coalesce(1), url_col))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def ruled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule) alone."""
    host, path = host_and_path(F.col(url_col))
    return pages.select(F.col(id_col), host.alias("host"), path.alias("path"), matching_rule(host, path, rules).alias("rule"))


def judge(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_score (the model's probability of block)."""
    df = features(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url")
    df = model.transform(df).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    score = F.element_at(vector_to_array("_probability"), 2)
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    df = df.withColumn("block_score", score)
    verdict = F.coalesce(by_rule, F.when(F.col("block_score") > threshold, "block").otherwise("allow"))
    return df.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")
