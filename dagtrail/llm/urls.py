"""URL filter: rules on host and path, and where none fits a linear model on n-grams.

The model is a logistic regression on hashed character n-grams of host and path, trained from
a small table of labelled URLs.
"""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagtrail.sources.paths import removed_afterwards, shared_folder

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16
REGULARISATION = 0.001
# Blocked from this probability on.
THRESHOLD = 0.4
ITERATIONS = 50

# Verdict and host with path, as a user would write them.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

# Sites labelled by hand: what a corpus should not hold, and ordinary ones.
BLOCKED_SITES = (
    "casino-royal online-casino win-big poker-win free-slots bets-today sport-bets free-spins jackpot-win casino-bonus "
    "bets-online free-casino win-casino ad-track ads-network adult-cams xxx-adult adult-video hot-sex-x porn-x escort-x "
    "spam-links link-farm seo-spam content-farm cheap-pills free-viagra payday-loans free-money crack-keygen "
    "free-bets-win ads-server track-ads ads-banner click-tracker"
).split()
ALLOWED_SITES = (
    "meadow village rivers library thehill weather science university wiki garden museum recipes cityhall therewith "
    "thought another nation brother thread station earth theory harbour handbook notion ocean mountain winter freedom "
    "farmers-market open-data road-map anderer schule naturelle ciudades thanks therein thereof others strength shining "
    "southern northern stone storm string interest internet energy entry trains trend theatre threshold thirteen those "
    "tonight outing house mouse shore heron hearth leather feather weathered shelter anthem tension passion intention "
    "nature reading evening morning rating hanging hesitate restore orient instead ready bread breath wheel whole that "
    "thesis shadow shepherd tower iron season lesson reason person ration torch north smooth month tenth growth"
).split()
# Each site is met with all of these, so that they say nothing about it.
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = ("example.com", "example.net", "example.org")
PATHS = ("/en/12", "/de/745.html", "/fr/340?page=2&ref=x", "/es/81/", "/en/455#top", "/de/9", "/fr/67/", "/es/202", "/")


def host(url: Column) -> Column:
    """From the first `://` to the next `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), capitals, capitals.lower())


def path(url: Column) -> Column:
    """From the end of the host to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The verdict and text of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    chosen = None
    for verdict, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("text"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<verdict:string,text:string>")


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with what it is of."""

    def of(mark: str, text: Column) -> list[Column]:
        # which digits they are says nothing
        framed = F.concat(F.lit("^"), F.regexp_replace(F.lower(text), "[0-9]", "0"), F.lit("$"))
        found = []
        for n in GRAMS:
            last = F.length(framed) - n + 1
            starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            found.append(F.transform(starts, lambda i, n=n: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n)))))
        return found

    return F.concat(*of("h", host), *of("p", path))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The table of labelled URLs: url, and label 1.0 for what is blocked."""

    def each(values: tuple[str, ...] | list[str]) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    one = spark.range(1, numPartitions=1)
    blocked = one.select(each(BLOCKED_SITES).alias("site"), F.lit(1.0).alias("label"))
    sites = blocked.unionByName(one.select(each(ALLOWED_SITES).alias("site"), F.lit(0.0).alias("label")))
    forms = sites.withColumn("prefix", each(PREFIXES)).withColumn("ending", each(ENDINGS))
    # paths go round, so that each kind of site is met with each of them
    nth = F.pmod(F.xxhash64("site", "prefix", "ending"), F.lit(len(PATHS))).cast("int")
    path = F.get(F.array(*[F.lit(p) for p in PATHS]), nth)
    return forms.select(F.concat(F.lit("https://"), "prefix", "site", F.lit("."), "ending", path).alias("url"), "label")


def _with_grams(urls: DataFrame) -> DataFrame:
    return urls.withColumn("_grams", grams(F.col("_host"), F.col("_path")))


def train(labelled: DataFrame) -> PipelineModel:
    """A model from url and label; the table is small, so one task holds it.

    A fitted model holds its summary and by that the session, which cannot be sent to tasks once anything
    in it has been observed; a stored and loaded one holds what it has learnt alone.
    """
    rows = labelled.select("label", host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True)
    regression = LogisticRegression(
        featuresCol="_features", labelCol="label", predictionCol="_blocked", rawPredictionCol="_raw",
        probabilityCol="_probability", regParam=REGULARISATION, maxIter=ITERATIONS, standardization=False,
        threshold=THRESHOLD,
    )
    fitted = Pipeline(stages=[hashing, regression]).fit(_with_grams(rows).coalesce(1))
    spark = labelled.sparkSession
    with removed_afterwards(spark):
        stored = shared_folder(spark, "url-model")
        fitted.save(stored)
        return PipelineModel.load(stored)


def judge(pages: DataFrame, model: PipelineModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row: the rule's verdict, else the model's.

    A null url, or one without `://`, has an empty host and path; the model then has no n-gram but
    that of the frame. Rows are judged one by one; repeated rows stay; very long urls count whole; an empty table
    gives none.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    known = model.transform(_with_grams(rows))
    own = rule(F.col("_host"), F.col("_path"), rules)
    learned = F.when(F.col("_blocked") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return known.select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        own["text"].alias("rule"),
        F.coalesce(own["verdict"], learned).alias("verdict"),
    )
