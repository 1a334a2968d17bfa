"""URL filters: rules by host and path, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import free_name, least_hashed, written

#: Distinct labelled URLs that the trees are trained on at most, those of least hash.
MAX_TRAINING = 20_000
#: Suffixes of a table of statistics that is broadcast; larger ones are joined as Spark sees fit.
BROADCAST = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: A suffix's share of blocked URLs counts as many more URLs of the overall share.
PRIOR = 5.0
#: Folds of the labelled URLs, by hash: the share that a URL is trained with leaves its own fold out.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """verdict for the hosts and subdomains of `pattern` up to its first slash, and paths that start with the rest."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.pattern.partition("/")
        on = (host == name) | host.endswith("." + name)
        return on & path.startswith(slash + rest)


def host_of(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and verdict (the rule's, else null).

    Ties of length go to the smaller pattern. Columns of these names are replaced.
    """
    order = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    found = F.coalesce(*(F.when(r.fits(F.col("host"), F.col("path")), F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in order), F.lit(None).cast("struct<rule: string, verdict: string>"))
    name = free_name("found", pages)
    return out.withColumn(name, found).withColumns({"rule": F.col(f"{name}.rule"), "verdict": F.col(f"{name}.verdict")}).drop(name)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    terms = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", -share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


SUFFIXES = ("suffix_1", "suffix_2", "suffix_path")
LEXICAL = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "escapes", "has_fragment", "https")


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages (with host and path) with LEXICAL features and SUFFIXES; a null url has those of an empty one."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    labels = F.split(host, r"\.")
    last = F.element_at(labels, -1)
    return pages.withColumns(
        {
            "length": F.length(u).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": _count(path, "/"),
            "host_labels": F.size(labels).cast("double"),
            "digit_ratio": _count(u, "[0-9]") / n,
            "entropy": _entropy(u),
            "parameters": _count(F.regexp_extract(u, r"\?([^#]*)", 1), "[^&]+"),
            "hyphens": _count(host, "-"),
            "escapes": _count(u, "%"),
            "has_fragment": u.contains("#").cast("double"),
            "https": u.startswith("https:").cast("double"),
            "suffix_1": last,
            "suffix_2": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            "suffix_path": F.concat_ws("/", last, F.regexp_extract(path, "^/([^/]*)", 1)),
        }
    )


class UrlModel:
    """Trees trained on at most MAX_TRAINING labelled URLs, with suffix statistics of all of them.

    A labelled URL is trained with the shares of the other folds, so that its own label is
    in none of its features; URLs that are judged get the shares of all folds.
    """

    def __init__(self, labelled: DataFrame, url: str = "url") -> None:
        """labelled: url, host, path and verdict (allow or block; null rows take no part). One verdict alone is given to all, allow without any."""
        from pyspark.ml.classification import GBTClassifier

        rows = labelled.where(F.col("verdict").isin("allow", "block"))
        rows = rows.select(F.coalesce(url, F.lit("")).alias("url"), "host", "path", (F.col("verdict") == "block").cast("double").alias("label")).distinct()
        rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(FOLDS)).cast("int")), "labelled_urls")
        n, blocked = rows.agg(F.count("*"), F.sum("label")).first()
        self.constant = None if n and 0 < blocked < n else "block" if n and blocked else "allow"
        self.statistics: dict[str, DataFrame] = {}
        if self.constant is None:
            self.share = blocked / n
            every = with_features(rows)
            training = least_hashed(rows, ["url", "label"], MAX_TRAINING, n)
            training = written(with_features(training), "training_urls")
            for s in SUFFIXES:
                by_fold = written(every.groupBy(s, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")), "suffix_folds")
                found = written(by_fold.groupBy(s).agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")), "suffix_statistics")
                self.statistics[s] = _bounded(found.select(s, self._share("blocked", "n").alias(f"{s}_share")), found.count())
                others = by_fold.join(found.withColumnsRenamed({"blocked": "all_blocked", "n": "all_n"}), s)
                others = others.select(s, "fold", self._share("all_blocked - blocked", "all_n - n").alias(f"{s}_share"))
                training = training.join(_bounded(others, by_fold.count()), [s, "fold"], "left").fillna(self.share, [f"{s}_share"])
            training = written(_vectors(training).select("features", "label", "fold"), "training_vectors")
            self.fitted = lambda r: GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(r)
            self.training, self.model = training, self.fitted(training)

    def _share(self, blocked: str, n: str) -> Column:
        return (F.expr(blocked) + PRIOR * self.share) / (F.expr(n) + PRIOR)

    def held_out_accuracy(self, fold: int = 0) -> tuple[float, float]:
        """The share of one fold's training URLs that trees of the other folds judge as labelled, and that of its more frequent label."""
        model, rest = self.fitted(self.training.where(F.col("fold") != fold)), self.training.where(F.col("fold") == fold)
        right = (F.col("prediction") == F.col("label")).cast("double")
        found, mean = model.transform(rest).agg(F.avg(right), F.avg("label")).first()
        return found, max(mean, 1 - mean)

    def verdicts(self, pages: DataFrame, name: str, url: str = "url") -> DataFrame:
        """pages (with host and path) with the column `name`: allow or block; the other columns and rows as they are."""
        if self.constant is not None:
            return pages.withColumn(name, F.lit(self.constant))
        packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("own"), F.col(url).alias("url"), "host", "path")
        rows = with_features(packed)
        for s in SUFFIXES:
            rows = rows.join(self.statistics[s], s, "left").fillna(self.share, [f"{s}_share"])
        out = self.model.transform(_vectors(rows))
        return out.select("own.*", F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias(name))


def _bounded(table: DataFrame, n: int) -> DataFrame:
    """A table of n suffixes, to be broadcast if they are few."""
    return F.broadcast(table) if n <= BROADCAST else table


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[*LEXICAL, *(f"{s}_share" for s in SUFFIXES)], outputCol="features").transform(rows)


def judged(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict: the longest fitting rule's, else the trees'.

    labelled: (url, verdict); without it the URLs that a rule decides are the labelled
    ones. Null and malformed URLs have an empty host and path and are judged by the
    trees; repeated rows stay; no rows give no rows. Columns named as the new ones are
    replaced; any others pass through, whatever their names.
    """
    found = with_rules(pages, rules, url)
    if labelled is None:
        labelled = found.select(F.col(url).alias("url"), "host", "path", "verdict")
    else:
        labelled = labelled.select(F.col(url).alias("url"), "verdict").withColumns({"host": host_of("url"), "path": path_of("url")})
    name = free_name("judged", found)
    return UrlModel(labelled).verdicts(found, name, url).withColumn("verdict", F.coalesce("verdict", name)).drop(name)
