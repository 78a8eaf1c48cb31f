"""URL filter: ordered host and path rules, then logistic regression on hashed character n-grams.

The regression reads n-grams of host and path, each marked with its field, and
is fitted on a small labelled URL table: ``sample_rows`` rows at most, whatever
the table given. All of it is DataFrame work; no row passes through Python.

Defined results: a null url, or one without ``://``, has empty host and path
and gets the verdict of the intercept; urls of any length are read whole;
repeated rows get equal verdicts; an empty table gives an empty result; columns
of any name pass through, since a row travels as one struct. Without both
labels in the labelled table every url that no rule fits is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import literal_table, lower_ascii

#: (verdict, host, path prefix); a rule fits its host and all subdomains, the longest rule wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Labelled rows that are fitted at most, hashed features, n-gram lengths, regularisation, threshold.
SAMPLE_ROWS, FEATURES, GRAMS, PENALTY, THRESHOLD = 10_000, 1 << 15, (3, 4, 5), 0.002, 0.5

#: Hosts of the built-in labelled table, hand-written: unwanted ones, then ordinary ones.
UNWANTED = """casino-royal online-casino casino-bonus win-big win-jackpot slots-win free-spins free-chips bets-today
sports-bets best-bets poker-bets cheap-meds cheap-watches pills-direct diet-pills pills-shop pharma-pills spam-mail
spam-links mail-spam link-farm content-farm farm-clicks ads-server ads-click pop-ads track-click click-track
track-pixel adult-cams adult-video adult-chat xxx-adult hot-x sex-x free-movies-x warez-crack keygen-crack
payday-loans fast-loans get-rich prize-winner lottery-win replica-bags free-gift""".split()
ORDINARY = """weather library museum university gardening history cooking recipes travel mountain physics biology
chemistry astronomy letters theatre orchestra painting photos archive journal science nature health school
college students teachers courier gazette tribune herald market harbour station railway bridge castle river
forest island village townhall council parliament ministry justice engineering software compiler database
network handbook manual reference dictionary thesaurus encyclopedia cycling running swimming hiking football
tennis chess music guitar piano violin thomas theodor heather other another brother winter pillar tractor
addison adelaide spanish farmer warehouse better betty bethany""".split()


def parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end."""
    pattern = r"://([^/?#]*)([^?#]*)"
    found = [F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2)]
    return lower_ascii(found[0]), found[1]


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    chain = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if chain is None else chain


def grams(host: Column, path: Column, lengths: Sequence[int] = GRAMS) -> Column:
    """Distinct character n-grams of both fields; ``^`` and ``$`` mark their ends.

    Each field is split into characters once and bound to a lambda variable, so
    that the time is linear in its length: an expression inside a lambda is
    evaluated for every element, and a substring is looked for from the start.
    """

    def starting(mark: str, chars: Column, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]))

    def of(mark: str, field: Column) -> Column:
        chars = F.split(F.concat(F.lit("^"), field, F.lit("$")), "")
        return F.transform(F.array(chars), lambda c: F.concat(*[starting(mark, c, n) for n in lengths]))

    return F.array_distinct(F.flatten(F.concat(of("h", host), of("p", path))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in table (url, blocked): every host above with the endings and paths of ordinary and tracked links."""
    rows = [
        {"url": f"https://{sub}{host}.{top}{path}", "blocked": float(host in UNWANTED)}
        for host in (*UNWANTED, *ORDINARY)
        for sub, top, path in (("", "example.com", "/en/10"), ("www.", "example.org", "/fr/22.html"), ("m.", "example.net", "/es/3/"))
    ]
    return literal_table(spark, rows, "url string, blocked double")


def _features(urls: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return hashing.transform(urls.withColumn("_grams", grams(F.col("_host"), F.col("_path"))))


def url_verdicts(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    carry: Sequence[str] | None = None,
    url_column: str = "url",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Per row ``_row``, ``_host``, ``_path``, ``_rule``, ``_score`` (probability of block) and ``_verdict``.

    ``labelled`` has url and blocked (0 or 1; other rows are left out); fitted are the ``sample_rows`` of smallest url hash.
    """
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    host, path = parts(F.col("url"))
    usable = labelled.filter("blocked IN (0, 1)").orderBy(F.xxhash64("url"), "url", "blocked").limit(sample_rows)
    train = _features(usable.select(F.col("blocked").cast("double").alias("_label"), host.alias("_host"), path.alias("_path")))
    classes = train.select("_label").distinct().count()

    host, path = parts(F.col(url_column))
    rows = pages.select(F.struct(*(carry or pages.columns)).alias("_row"), host.alias("_host"), path.alias("_path"))
    ruled = rows.withColumn("_fit", rule_for(F.col("_host"), F.col("_path"), rules))
    if classes == 2:
        fitting = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=PENALTY, standardization=False, maxIter=50)
        fitting.setProbabilityCol("_probability").setPredictionCol("_prediction").setRawPredictionCol("_raw")
        scored = fitting.fit(train.repartition(1)).transform(_features(ruled))
        scored = scored.withColumn("_score", vector_to_array("_probability")[1])
    else:
        scored = ruled.withColumn("_score", F.lit(0.0))
    judged = F.when(F.col("_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(F.col("_fit.verdict"), judged)
    return scored.select("_row", "_host", "_path", F.col("_fit.rule").alias("_rule"), "_score", verdict.alias("_verdict"))
