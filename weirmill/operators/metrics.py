"""Evaluation metrics over scored rows: thresholds, confusion counts, precision-recall, bootstrap, agreement, latency.

Rows with a null label or score take no part and are never read as negative. Ties of a score move together. A rate
without a denominator is null, never zero. Empty input gives null metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.operators.contract import verdict
from weirmill.operators.ordered import running
from weirmill.session import write_table


def hash32(*cols: Column | str) -> Column:
    """A 32-bit number from MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)).cast("binary")), 1, 8), 16, 10).cast("long")


def threshold_table(scored: DataFrame) -> DataFrame:
    """``(score, tp, fp, n_pos, n_neg)``: counts at or above every unique score. Rows are first counted per score, so the
    running sum goes over unique scores, not rows."""
    s = scored.filter("label is not null and score is not null")
    per = s.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    every = per.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg")).first()
    got = running(per, F.col("score"), {"tp": F.col("p"), "fp": F.col("n")}, descending=True)
    return got.select("score", "p", "tp", "fp", F.lit(every["n_pos"]).cast("long").alias("n_pos"), F.lit(every["n_neg"]).cast("long").alias("n_neg"))


def thresholds(scored: DataFrame, target_fprs: list[float]) -> DataFrame:
    """A row a target: the threshold with most true positives whose false-positive rate is within it, the higher of equals;
    ``undefined_reason`` where there is none (``no_benign``, ``no_phishing``, ``no_feasible``). The table of counts is built once."""
    ok = lambda fpr: (F.col("fp") <= F.col("n_neg") * F.lit(fpr)) & (F.col("n_neg") > 0) & (F.col("tp") > 0)
    best = threshold_table(scored).agg(*(F.max(F.when(ok(x), F.struct("tp", "score", "fp"))).alias(f"b{i}") for i, x in enumerate(target_fprs)), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    per = best.select("n_pos", "n_neg", F.inline(F.array(*(F.struct(F.lit(x).alias("target_fpr"), F.col(f"b{i}").alias("b")) for i, x in enumerate(target_fprs)))))
    why = F.when(F.coalesce("n_neg", F.lit(0)) == 0, "no_benign").when(F.coalesce("n_pos", F.lit(0)) == 0, "no_phishing").when(F.col("b").isNull(), "no_feasible")
    return per.select("target_fpr", F.col("b.score").alias("threshold"), F.col("b.tp").alias("tp"), F.col("b.fp").alias("fp"), "n_pos", "n_neg", why.alias("undefined_reason"))


def threshold_at(scored: DataFrame, target_fpr: float) -> DataFrame:
    """:func:`thresholds` for one target."""
    return thresholds(scored, [target_fpr])


def rates() -> list[Column]:
    """Metrics of the columns tp, fn, fp, tn."""
    div = lambda a, b: F.round(F.try_divide(a, b), 9)
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    return [
        div(tp, tp + fn).alias("recall"), div(fp, fp + tn).alias("fpr"), div(tp, tp + fp).alias("precision"),
        div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tp + fn, tp + fn + fp + tn).alias("base_rate"),
    ]


def _cells(threshold: float | Column) -> list[Column]:
    warn, bad = F.col("score") >= threshold, F.col("label") == 1
    return [F.count_if(bad & warn).alias("tp"), F.count_if(bad & ~warn).alias("fn"), F.count_if(~bad & warn).alias("fp"), F.count_if(~bad & ~warn).alias("tn")]


def confusion(scored: DataFrame, threshold: float | Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    known = scored.filter("label is not null and score is not null")
    return known.groupBy(*by).agg(*_cells(threshold)).select(*by, "tp", "fn", "fp", "tn", *rates())


def subgroups(scored: DataFrame, threshold: float, dims: list[str]) -> DataFrame:
    """Confusion and rates for all rows and for every value of each dimension, in one scan."""
    known = scored.filter("label is not null and score is not null").withColumns({d: F.col(d).cast("string") for d in dims})
    got = known.groupingSets([[], *[[d] for d in dims]], *dims).agg(*_cells(threshold), *(F.grouping(d).alias(f"__{d}") for d in dims))
    dim = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dims), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"__{d}") == 0, F.col(d)) for d in dims))
    return got.select(dim.alias("dim"), value.alias("value"), "tp", "fn", "fp", "tn", *rates())


def pr_auc(scored: DataFrame) -> DataFrame:
    """One row: average precision, step by step over unique scores."""
    t = threshold_table(scored)
    step = F.col("p") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return t.select(F.when(F.col("n_pos") > 0, step).alias("s")).agg(F.round(F.sum("s"), 9).alias("pr_auc"))


def group_counts(scored: DataFrame, group: str, configs: dict[str, float]) -> DataFrame:
    """Confusion counts of each group under each configuration's threshold: what the bootstrap draws from."""
    known = scored.filter("label is not null and score is not null")
    return known.groupBy(group).agg(*(c.alias(f"{n}_{k}") for n, t in configs.items() for k, c in zip(("tp", "fn", "fp", "tn"), _cells(t))))


def bootstrap(scored: DataFrame, group: str, configs: dict[str, float], reps: int, seed: int = 17) -> DataFrame:
    """95 % percentile intervals of recall and false-positive rate of each configuration, and of the paired difference
    of the last and the first, over groups drawn with replacement: the same draws for all configurations.

    Pages are counted per group once; a replicate draws as many groups as there are, by number, and adds their counts.
    Draws are made on the executors from a hash of seed, replicate and turn.
    """
    g = group_counts(scored, group, configs)
    g = running(g, hash32(group), {"i": F.lit(1)}, ties=F.asc(group)).withColumn("i", F.col("i") - 1)
    g = write_table(g, "bootstrap_groups")
    n = g.count()
    spark = scored.sparkSession
    draws = spark.range(reps * max(n, 1)).select((F.col("id") / max(n, 1)).cast("long").alias("rep"), (hash32(F.lit(seed), F.col("id")) % max(n, 1)).alias("i"))
    times = draws.groupBy("rep", "i").agg(F.count("*").alias("m"))
    cols = [c for c in g.columns if c not in (group, "i")]
    per = times.join(g.drop(group), "i").groupBy("rep").agg(*(F.sum(F.col(c) * F.col("m")).alias(c) for c in cols))
    rate = lambda n, a, b: F.try_divide(F.col(f"{n}_{a}"), F.col(f"{n}_{a}") + F.col(f"{n}_{b}"))
    names = list(configs)
    made = {("recall", c): rate(c, "tp", "fn") for c in names} | {("fpr", c): rate(c, "fp", "tn") for c in names}
    if len(names) > 1:
        made |= {(f"{m}_delta", f"{names[-1]}-{names[0]}"): made[m, names[-1]] - made[m, names[0]] for m in ("recall", "fpr")}
    long = per.select("rep", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(c).alias("config"), v.alias("v")) for (m, c), v in made.items()))))
    return long.groupBy("metric", "config").agg(
        F.round(F.percentile("v", 0.025), 9).alias("low"), F.round(F.percentile("v", 0.975), 9).alias("high"), F.count("v").alias("n_valid"), F.count_if(F.col("v").isNull()).alias("n_invalid")
    )


def dispersion(per_run: DataFrame, value: str, seed: str, by: list[str]) -> DataFrame:
    """``(by ..., runs, mean, sd_runs, sd_seeds)``: spread of a metric over all runs, and over the means of the seeds, which are
    repetitions and not more data. Null values take no part."""
    per = per_run.filter(F.col(value).isNotNull()).groupBy(*by, seed).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    got = per.groupBy(*by).agg(F.sum("n").alias("runs"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.stddev_samp(F.col("s") / F.col("n")).alias("sd_seeds"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("runs")) / F.nullif(F.col("runs") - 1, F.lit(0))
    return got.select(*by, "runs", F.round(F.col("s") / F.col("runs"), 9).alias("mean"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 6).alias("sd_runs"), F.round("sd_seeds", 6).alias("sd_seeds"))


def effort(df: DataFrame, seconds: str, by: list[str], limit: float, planned: int, reduced: int) -> DataFrame:
    """``(by ..., timed, mean_seconds, total_hours, target)``: time spent a page, and the size of the sample by the rule that a
    mean above ``limit`` seconds reduces it. Untimed rows take no part; without any the target stays as planned."""
    got = df.groupBy(*by).agg(F.count(seconds).alias("timed"), F.avg(seconds).alias("m"), F.sum(seconds).alias("s"))
    return got.select(*by, "timed", F.round("m", 6).alias("mean_seconds"), F.round(F.col("s") / 3600, 6).alias("total_hours"), F.when(F.col("m") > limit, reduced).otherwise(planned).alias("target"))


def verdict_counts(scored: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """``(by ..., warning, no_indication, unable_to_assess)``: rows without a score are unable, never a true negative."""
    v = verdict(F.col("score"), F.lit(threshold))
    return scored.groupBy(*by).agg(*(F.count_if(v == x).alias(x) for x in ("warning", "no_indication", "unable_to_assess")))


def kappa(passes: DataFrame, a: str, b: str) -> DataFrame:
    """One row: observed and expected agreement and Cohen's kappa of two raters; null where all agree by necessity."""
    cells = passes.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("n"))
    either = cells.select(F.inline(F.array(F.struct(F.col("x").alias("v"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"), F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0).alias("same")), F.struct(F.col("y").alias("v"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"), F.lit(0).cast("long").alias("same")))))
    per = either.groupBy("v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    got = per.agg(F.sum("na").alias("n"), F.sum("same").alias("same"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("e"))
    po, pe = F.try_divide("same", "n"), F.try_divide(F.col("e"), F.col("n").cast("double") * F.col("n"))
    return got.select("n", F.round(po, 9).alias("p_o"), F.round(pe, 9).alias("p_e"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 9).alias("kappa"))


def latency(df: DataFrame, value: str, by: list[str], timeout: float) -> DataFrame:
    """Median, 95th percentile and timeouts by group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.percentile(value, 0.5), 9).alias("p50"), F.round(F.percentile(value, 0.95), 9).alias("p95"), F.count_if(F.col(value) > timeout).alias("timeouts"))
