"""URL filter: path rules first, then a ratio of character language models.

URLs that a rule judges train two smoothed variable-order Markov models, one of accepted and one of
rejected URLs, over the characters of whole URLs (A-Z lower-cased). Contexts have up to ORDER - 1
characters, and each order backs off to the next shorter one by Witten-Bell weights, down to a
uniform distribution. A URL without a rule is judged by the mean, over its characters, of the
difference of log-likelihoods, against a threshold that balances the two errors best on the URLs
with a rule. For this they are halved by a hash of the URL, and each half is scored by the models of
the other one: no URL is measured by models that have counted it.

The models are one keyed table: the different runs of ORDER characters that occur in any URL, each
with its difference. It grows with the URLs, is made order by order from pre-aggregated counts, and
meets the URLs' characters by joins: rows that are more than one in BROADCAST_GRAMS of all characters,
so that number at most, are broadcast; the characters of the others meet theirs by a shuffle, in which
no key is frequent. Only built-in functions are used.

Defined results: a null URL, or one without "://", has empty host and path and no rule, and is
scored by its text, null as an empty one, of which only the end counts; if no URL has a rule, all
scores are 0 and all are allowed; repeated URLs count as often as they occur, and each row has its
result, null ids too; ties with the threshold are allowed; a very long URL is one row a character in
the join; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.storage import checkpointed, few, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 6
#: Stand before a URL's first and after its last character.
START, END = "\x02", "\x03"
#: Characters that the uniform distribution counts.
ALPHABET = 256
#: Rows of the models' table that are broadcast to the URLs' characters, the most frequent ones.
BROADCAST_GRAMS = 50_000
#: Bins of the calibration, over score differences from -RANGE to RANGE a character.
CALIBRATION_BINS, RANGE = 1000, 5.0
#: Occurrences in accepted and rejected URLs of both halves.
COUNTS = ("a0", "r0", "a1", "r1")

Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; empty where there is no "://"."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (host/path text) and its verdict, both null if none fits."""
    which = verdict = F.lit(None).cast("string")
    for judged, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        which, verdict = F.when(fits, text).otherwise(which), F.when(fits, judged).otherwise(verdict)
    return which, verdict


def grams(url: Column) -> Column:
    """The run of ORDER characters that ends at each character of a URL, and at its end."""
    text = F.concat(F.lit(START * (ORDER - 1)), F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), F.lit(END))
    run = lambda each, i: F.concat(*[F.get(each, i + k) for k in range(ORDER)])
    runs = lambda each: F.transform(F.sequence(F.lit(0), F.size(each) - ORDER), lambda i: run(each, i))
    # An array around the characters binds them to a name, so that they are split once a URL.
    return F.get(F.transform(F.array(F.split(text, "")), runs), F.lit(0))


def difference_table(counted: DataFrame) -> DataFrame:
    """gram and diff0 to diff2, differences of the log-probabilities of its last character after the
    others, of every gram of counted (gram, COUNTS), by the models of all but the first half's URLs,
    of all but the second's, and of all."""
    used = {0: ("a1", "r1"), 1: ("a0", "r0"), 2: ("a0 + a1", "r0 + r1")}
    sides = {f"{c}{m}": F.expr(pair[i]) for m, pair in used.items() for i, c in enumerate(("accepted", "rejected"))}
    table = None
    for order in range(1, ORDER + 1):
        own = counted.groupBy(F.substring("gram", ORDER - order + 1, order).alias("gram")).agg(*[F.sum(c).alias(c) for c in COUNTS])
        same = Window.partitionBy(F.substring("gram", 1, order - 1))
        rows = own.select("gram", *[x.alias(n) for n, x in sides.items()], *[y for n, x in sides.items() for y in (F.sum(x).over(same).alias(f"n_{n}"), F.count_if(x > 0).over(same).alias(f"t_{n}"))])
        if table is not None:
            shorter = table.select(F.col("gram").alias("_shorter"), *[F.col(f"p_{n}").alias(f"q_{n}") for n in sides])
            rows = rows.join(shorter, F.substring("gram", 2, order - 1) == F.col("_shorter"))

        def smooth(n: str) -> Column:
            seen, kinds, q = F.col(f"n_{n}"), F.col(f"t_{n}"), F.lit(1.0 / ALPHABET) if table is None else F.col(f"q_{n}")
            return F.when(seen > 0, (F.col(n) + kinds * q) / (seen + kinds)).otherwise(q)

        table = rows.select("gram", *[smooth(n).alias(f"p_{n}") for n in sides])
    return table.select("gram", *[(F.ln(f"p_accepted{m}") - F.ln(f"p_rejected{m}")).cast("float").alias(f"diff{m}") for m in used])


def _threshold(rows: DataFrame) -> DataFrame:
    """One row, threshold: the cut of score that balances the errors of rows (judged, score) best."""
    width = 2 * RANGE / CALIBRATION_BINS
    bins = rows.groupBy(F.least(F.greatest(F.floor((F.col("score") + RANGE) / width), F.lit(0)), F.lit(CALIBRATION_BINS - 1)).alias("bin")).agg(
        F.count_if(F.col("judged") == "allow").alias("good"), F.count_if(F.col("judged") == "block").alias("bad")
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(Window.partitionBy(F.lit(0))))
    # Cut below the bin: errors are accepted URLs under it and rejected ones from it on.
    errors = F.coalesce(share("good"), F.lit(0.0)) + 1 - F.coalesce(share("bad"), F.lit(0.0))
    best = F.min(F.struct("errors", F.abs(F.col("bin") - CALIBRATION_BINS // 2).alias("far"), "bin"))["bin"]
    return bins.select("bin", errors.alias("errors")).groupBy().agg(F.coalesce(best * width - RANGE, F.lit(0.0)).alias("threshold"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score and threshold."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_column).alias("page_id"), "url", host.alias("host"), path.alias("path"))
    which, judged = rule_of(F.col("host"), F.col("path"), rules)
    half = F.pmod(F.xxhash64("url"), F.lit(2))
    parsed = stored(parsed.withColumns({"rule": which, "judged": judged, "half": half, "row": F.monotonically_increasing_id()}))
    spelled = parsed.select("row", "judged", "half", F.explode(grams(F.col("url"))).alias("gram"))
    sides = [(F.col("judged") == verdict) & (F.col("half") == h) for h in (0, 1) for verdict in ("allow", "block")]
    counted = stored(few(spelled.groupBy("gram").agg(*[F.count_if(x).alias(c) for c, x in zip(COUNTS, sides)], F.count("*").alias("n"))))
    key = F.xxhash64("gram").alias("key")
    often = counted.select(F.col("gram").alias("_gram"), "n")
    table = stored(few(difference_table(counted).join(often, F.col("gram") == F.col("_gram")).select(key, "diff0", "diff1", "diff2", "n")))
    size = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters")).first()
    spelled, differences = spelled.select("row", "half", key), table.drop("n")
    if size["rows"] <= BROADCAST_GRAMS:
        known = spelled.join(F.broadcast(differences), "key")
    else:
        common = F.col("n") * BROADCAST_GRAMS > size["characters"]
        once = spelled.join(F.broadcast(table.where(common).drop("n")), "key", "left")
        rare = once.where("diff2 IS NULL").select("row", "half", "key").join(table.where(~common).drop("n"), "key")
        known = once.where("diff2 IS NOT NULL").unionByName(rare)
    apart = F.when(F.col("half") == 0, F.col("diff0")).otherwise(F.col("diff1"))
    # Whole millionths, so that a sum does not depend on the order of its terms.
    mean = lambda x: F.sum(F.round(x * 1_000_000).cast("long")) / F.count("*") / 1_000_000
    met = known.groupBy("row").agg(mean(F.col("diff2")).alias("score"), mean(apart).alias("apart"))
    scored = stored(few(parsed.drop("url", "half").join(met, "row")))
    threshold = checkpointed(_threshold(scored.where("judged IS NOT NULL").select("judged", F.col("apart").alias("score"))))
    by_model = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return scored.withColumn("threshold", threshold.scalar()).select("page_id", "host", "path", "rule", F.coalesce("judged", by_model).alias("verdict"), "score", "threshold")
