"""URL filter: host and path rules, then a character language-model ratio, all in DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Characters that the models tell apart: a-z, one class for digits, and these. All others share one class.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%~+"
ALPHABET = len(SYMBOLS) + 2  # and the class of other characters, and the edge of a URL
ORDER = 3
#: A URL on more than one of so many rows counts as frequent.
OFTEN = 1000
KINDS = {"accepted": "allow", "rejected": "block"}

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as ``host/path`` text, the earlier listed of equals; null if none fits.

    A rule ``(verdict, domain, path)`` fits its domain and all subdomains where the
    path starts with the rule's.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        ((host == F.lit(d)) | host.endswith("." + d)) & (path.startswith(p) if p else F.lit(True)) for _, d, p in ordered
    ]
    return F.coalesce(*[F.when(f, F.lit(d + p)) for f, (_, d, p) in zip(fits, ordered, strict=True)], F.lit(None).cast("string"))


def with_grams(urls: DataFrame) -> DataFrame:
    """The columns of ``urls(url, ...)`` and a row ``gram`` for each character of a URL and its end.

    ``gram`` writes ORDER character classes in base ALPHABET. The first characters
    have the edge class before them. Digits are one class and case is folded, so
    there are at most ALPHABET**ORDER grams whatever the input.
    """
    folded = F.translate(F.lower("url"), "123456789", "0" * 9)
    spots = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    other, edge = F.lit(len(SYMBOLS) + 1), F.lit(0)
    classes = F.concat(
        F.array(*[edge] * (ORDER - 1)), F.transform(spots, lambda n: F.when(n == 0, other).otherwise(n)), F.array(edge)
    )

    def gram(i: Column) -> Column:
        return reduce(
            lambda sofar, k: sofar * ALPHABET + F.element_at("classes", i + k),
            range(1, ORDER),
            F.element_at("classes", i),
        )

    numbers = F.transform(F.sequence(F.lit(1), F.size("classes") - (ORDER - 1)), gram)
    return urls.withColumn("classes", classes).select(*urls.columns, F.explode(numbers).alias("gram"))


def log_probability(counts: DataFrame, kind: str) -> DataFrame:
    """``(gram, logp)``: log P(last character | those before) for every gram of ``counts(gram, kind)``.

    The model mixes contexts of 0 to ORDER-1 characters by Witten-Bell weights: a
    context that t different characters followed, n times in all, trusts its own
    counts n/(n+t) and leaves the rest to the next shorter one, so that a context
    never seen falls back as a whole. Below order 0 all classes are alike.
    """
    out, p = counts.select("gram"), F.lit(1.0 / ALPHABET)
    for size in range(1, ORDER + 1):
        of_size = counts.groupBy(F.pmod("gram", F.lit(ALPHABET**size)).alias("s")).agg(F.sum(kind).alias("c"))
        before = of_size.groupBy(F.floor(F.col("s") / ALPHABET).alias("b")).agg(
            F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("t")
        )
        own = of_size.join(before, F.floor(F.col("s") / ALPHABET) == F.col("b")).select("s", "c", "n", "t")
        p = F.when(F.col("n") > 0, (F.col("c") + F.col("t") * p) / (F.col("n") + F.col("t"))).otherwise(p)
        out = out.join(own, F.pmod("gram", F.lit(ALPHABET**size)) == F.col("s")).withColumn(f"p{size}", p)
        out, p = out.drop("s", "c", "n", "t"), F.col(f"p{size}")
    return out.select("gram", F.log(p).alias("logp"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``.

    URLs that a rule allows train the accepted model, those that a rule blocks the
    rejected one. A URL's score is its log-likelihood difference under the two,
    divided by its characters. It is blocked below the score that lies equally
    many standard deviations from the two training means. Where no URL was blocked
    by a rule all others are allowed; where some were and none was allowed, all
    others are blocked. A null URL is judged as an empty one. Rows that repeat stay;
    an empty table gives no rows; other columns are ignored.
    """
    kept = pages.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"))
    urls = kept.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = {d + p: v for v, d, p in rules}
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in verdicts.items()], F.lit(None).cast("string"))
    urls = materialise(urls.withColumn("by_rule", by_rule), "urls")

    parts = with_grams(urls.select("url", "n", "by_rule"))
    trained = {k: F.sum(F.when(F.col("by_rule") == v, F.col("n")).otherwise(0)).alias(k) for k, v in KINDS.items()}
    counts = materialise(parts.groupBy("gram").agg(*trained.values()), "url-grams")
    gains = (
        log_probability(counts, "accepted")
        .join(log_probability(counts, "rejected").withColumnRenamed("logp", "rejected"), "gram")
        .select("gram", (F.col("logp") - F.col("rejected")).alias("gain"))
    )
    gains = materialise(gains, "url-gains")
    # at most ALPHABET**ORDER rows of 16 bytes, about 1 MB
    scored = materialise(
        with_grams(urls.select("url")).join(F.broadcast(gains), "gram").groupBy("url").agg(F.avg("gain").alias("score")),
        "url-scores",
    )
    judged = urls.join(scored, "url")
    moments = {
        r["by_rule"]: r
        for r in judged.filter("by_rule IS NOT NULL")
        .groupBy("by_rule")
        .agg(
            F.sum(F.col("n") * F.col("score")).alias("s"),
            F.sum(F.col("n") * F.col("score") * F.col("score")).alias("ss"),
            F.sum("n").alias("n"),
        )
        .collect()
    }
    verdict = F.coalesce("by_rule", method_verdict(moments)).alias("verdict")
    judged = materialise(judged.select("url", "host", "path", "rule", "n", verdict), "url-verdicts")
    # Fewer than OFTEN URLs stand on one of OFTEN rows each; their verdicts go to the rows, not the rows to one task.
    often = F.col("n") * OFTEN > F.lit(judged.agg(F.sum("n")).first()[0] or 0)
    hot, rest = judged.filter(often).drop("n"), judged.filter(~often).drop("n")
    told = kept.join(F.broadcast(hot), "url").unionByName(
        kept.join(F.broadcast(hot.select("url")), "url", "left_anti").join(rest, "url")
    )
    return told.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


def method_verdict(moments: dict) -> Column:
    """The verdict by ``score``, from each class's count and sums of scores and squared scores."""
    if "block" not in moments:
        return F.lit("allow")
    if "allow" not in moments:
        return F.lit("block")
    (ma, sa), (mb, sb) = (
        (r["s"] / r["n"], max(r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2, 1e-12) ** 0.5)
        for r in (moments["allow"], moments["block"])
    )
    return F.when(F.col("score") < F.lit((ma * sb + mb * sa) / (sa + sb)), "block").otherwise("allow")
