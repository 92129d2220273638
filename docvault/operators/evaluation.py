"""Evaluation: retrieval metrics, answer accuracy, refusals, leaks, latency and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docvault import fixed_values as V
from docvault.session import is_small, lookup_join, materialise


def holds_any(text: Column, wanted: Column) -> Column:
    return F.exists(wanted, lambda e: F.contains(F.lower(text), F.lower(e)))


def _ratio(part: Column, n: Column) -> Column:
    return F.round(part / F.greatest(n, F.lit(1)), 3)


def retrieval_metrics(hits: DataFrame, passages: DataFrame, questions: DataFrame, method: str) -> DataFrame:
    """(method, n, hit1, hit5, mrr, cross_hit1) over answerable questions; a hit's passage holds an expected text."""
    asked = questions.filter(F.col("type").isin(V.ANSWERABLE)).select("qid", "type", "expect")
    # A few hits per question go to the passages; the texts stay in place while the hits are few enough to broadcast.
    few = materialise(hits.select("qid", "coll", "doc", "n", "rank").join(asked.select("qid", "expect"), "qid"), "judged-hits")
    texts = lookup_join(passages.select("coll", "doc", "n", "text"), few, ["coll", "doc", "n"], fits=is_small(few))
    right = texts.filter(holds_any(F.col("text"), F.col("expect")))
    first = right.groupBy("qid").agg(F.min("rank").alias("pos"))
    rows = asked.join(first, "qid", "left")
    n = F.count(F.lit(1))
    top = F.when(F.col("pos") == 0, 1).otherwise(0)
    cross = F.col("type") == "cross"
    return rows.agg(
        F.lit(method).alias("method"), n.alias("n"), _ratio(F.sum(top), n).alias("hit1"),
        _ratio(F.count("pos"), n).alias("hit5"),
        _ratio(F.coalesce(F.sum(1 / (F.col("pos") + 1)), F.lit(0.0)), n).alias("mrr"),
        _ratio(F.coalesce(F.sum(F.when(cross, top)), F.lit(0)), F.count_if(cross)).alias("cross_hit1"))


def judged(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question: whether the answer is right, refused, and which forbidden strings were shown."""
    asked = questions.select("qid", "type", F.col("lang").alias("q_lang"), "expect",
                             F.coalesce("must_not", F.array().cast("array<string>")).alias("must_not"))
    rows = responses.join(asked, "qid")
    shown = F.lower(F.concat_ws(" ", "answer", F.transform(F.coalesce("sources", F.array()), lambda s: s["text"])))
    return rows.select(
        "qid", "type", F.col("q_lang").alias("lang"), "refused", "method", "injections_blocked",
        holds_any(F.col("answer"), F.col("expect")).alias("correct"), F.size("expect").alias("n_expect"),
        F.size(F.filter("must_not", lambda m: F.contains(shown, F.lower(m)))).alias("leaks"),
        F.size("must_not").alias("checks"))


def answer_metrics(rows: DataFrame) -> DataFrame:
    """(metric, value) from judged questions."""
    answerable = F.col("type").isin(V.ANSWERABLE)
    kind = {t: F.col("type") == t for t in ("fact", "cross", "version", "unanswerable", "restricted", "pii", "injection")}

    def share(of: Column, hit: Column) -> Column:
        return _ratio(F.count_if(of & hit), F.count_if(of))

    def total(of: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0)).cast("double")

    right, refused = F.col("correct"), F.col("refused")
    metrics = {
        "answers.n": F.count_if(answerable).cast("double"),
        "answers.accuracy": share(answerable, right & ~refused),
        "answers.english_accuracy": share(kind["fact"] & (F.col("lang") == "en"), right),
        "answers.arabic_accuracy": share(kind["fact"] & (F.col("lang") == "ar"), right),
        "answers.cross_accuracy": share(kind["cross"], right),
        "answers.version_accuracy": share(kind["version"], right),
        "answers.wrongly_refused": share(answerable, refused),
        "refusal.unanswerable": share(kind["unanswerable"], refused),
        "refusal.restricted": share(kind["restricted"], refused),
        "leaks.restricted": total(kind["restricted"], "leaks"),
        "leaks.pii": total(kind["pii"], "leaks"),
        "leaks.injection": total(kind["injection"], "leaks"),
        "leaks.superseded": total(answerable, "leaks"),
        "leaks.checks": total(F.lit(True), "checks"),
        "injection.answered_correctly": share(kind["injection"] & (F.col("n_expect") > 0), right),
        "injection.instructions_removed": total(kind["injection"], "injections_blocked"),
    }
    return long_form(rows.agg(*[c.alias(name) for name, c in metrics.items()]))


def long_form(one_row: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.explode(pairs).alias("m")).select("m.*")


def latency_percentiles(rows: DataFrame, ms: str = "ms") -> DataFrame:
    """Exact median and 95th percentile, interpolated between neighbours; no task holds more than its range of values.

    Values are sorted by range once; counts of the ranges tell which of them hold the wanted places.
    """
    spark = rows.sparkSession
    ordered = rows.select(F.col(ms).cast("double").alias("v")).filter("v is not null").repartitionByRange("v", F.rand(1))
    stored = materialise(ordered.withColumn("part", F.spark_partition_id()), "ranges")
    counts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per task
    total, wanted = sum(r["n"] for r in counts), []
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        place = share * (total - 1)
        for at, weight in ((int(place), 1 - place % 1), (int(place) + 1, place % 1)):
            before = 0
            for r in counts:
                if before <= at < before + r["n"]:
                    wanted.append((name, r["part"], at - before + 1, float(weight)))
                before += r["n"]
    places = F.broadcast(spark.createDataFrame(wanted, "name string, part int, at int, weight double"))
    mine = stored.join(places.select("part").distinct(), "part").withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("v")))
    found = mine.join(places, ["part", "at"])
    return found.agg(*[F.round(F.sum(F.when(F.col("name") == n, F.col("v") * F.col("weight"))), 1).alias(n) for n in ("p50", "p95")])


def retrieval_long(metrics: DataFrame) -> DataFrame:
    names = ["hit1", "hit5", "mrr", "cross_hit1"]
    rows = F.array(*[F.struct(F.concat(F.lit("retrieval."), "method", F.lit(f".{c}")).alias("metric"),
                              F.col(c).cast("double").alias("value")) for c in names])
    return metrics.select(F.explode(rows).alias("m")).select("m.*")


def gate(metrics: DataFrame) -> DataFrame:
    """(metric, value, floor, passed) for the gated metrics: floors, and leak counts that must be zero."""
    floors = [(m, float(v), False) for m, v in V.GATE_FLOORS.items()] + [(m, 0.0, True) for m in V.GATE_ZERO]
    wanted = metrics.sparkSession.createDataFrame(floors, "metric string, floor double, must_be_zero boolean")
    rows = F.broadcast(wanted).join(metrics, "metric", "left")
    ok = F.when(F.col("must_be_zero"), F.col("value") == 0).otherwise(F.col("value") >= F.col("floor"))
    return rows.select("metric", "value", "floor", F.coalesce(ok, F.lit(False)).alias("passed"))


def write_results(metrics: DataFrame, judged_rows: DataFrame, folder: str) -> None:
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
    judged_rows.write.mode("overwrite").json(f"{folder}/questions")


def report(metrics: DataFrame) -> str:
    """The metrics as a Markdown table. Metrics are a fixed list of names, so collecting them is safe."""
    values = {r["metric"]: r["value"] for r in metrics.collect()}
    lines = ["# Evaluation", "", "| metric | value |", "|---|---|"]
    return "\n".join(lines + [f"| {m} | {values[m]:g} |" for m in sorted(values)]) + "\n"


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("metric string, value double").json(f"{folder}/metrics")
