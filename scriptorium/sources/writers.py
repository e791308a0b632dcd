"""Writers: tables, ratings, metric files, merged runs, LaTeX tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """SNK1, SNK5: a Parquet table; ``by`` makes folders of columns (model, type, seed) in place of
    names that carry them."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str, sep: str = ",", null: str = "NA") -> None:
    """SNK2: delimited text with a header."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, nullValue=null)


def json(df: DataFrame, path: str) -> None:
    """SNK3: an object a line."""
    df.write.mode("overwrite").json(path)


def appended(results: DataFrame, path: str) -> None:
    """SNK4: results by key, added as they come; :func:`latest` reads the last one of each key."""
    results.write.mode("append").parquet(path)


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """SNK4: the value that a dictionary under the same writes would hold."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), at).alias("v")).select(key, "v.*")


def metric_file(model: Column, kind: Column, seed: Column, at: Column, trial: Column | None = None) -> Column:
    """SNK5: the name of a metric file."""
    middle = F.when(trial.isNotNull(), F.concat(F.lit("_t"), trial.cast("string"))).otherwise("") if trial is not None else F.lit("")
    return F.concat(model, F.lit("_"), kind, middle, F.lit("_"), seed.cast("string"), F.lit("_"), F.date_format(at, "yyyy-MM-dd-HH-mm-ss"), F.lit(".json"))


def merged_runs(runs: DataFrame, order: str = "file", unsafe: bool = False) -> DataFrame:
    """SNK6: one row of ``prompt, prompt_token_count, models`` from run files ``prompt, prompt_token_count,
    models``: the first of each that is neither null, empty nor 0, and all models with outputs in
    order of file and place. Several prompts are an error unless ``unsafe``. One run's models fit a row,
    as in its files."""
    prompt = F.when(F.col("prompt") != "", F.col("prompt"))
    tokens = F.when(F.col("prompt_token_count") != 0, F.col("prompt_token_count"))
    ok = F.lit(True) if unsafe else F.coalesce(F.count_distinct(prompt) <= 1, F.lit(True))
    models = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "models"))), lambda r: r["models"]))
    out = runs.agg(ok.alias("ok"), F.min_by(prompt, F.when(prompt.isNotNull(), F.col(order))).alias("prompt"), F.min_by(tokens, F.when(tokens.isNotNull(), F.col(order))).alias("prompt_token_count"), F.filter(models, lambda m: F.coalesce(F.size(m["outputs"]), F.lit(0)) > 0).alias("models"))
    return out.select(F.when(F.col("ok"), F.col("prompt")).otherwise(F.raise_error(F.lit("files have different prompts"))).alias("prompt"), "prompt_token_count", "models")


def best_marked(cells: DataFrame, lower: tuple[str, ...] = ("rmse",)) -> DataFrame:
    """SNK7: ``cells`` (``row, column, metric, value``) with ``best``: the least value of a column for
    metrics in ``lower``, else the greatest; ties within a millionth."""
    w = W.partitionBy("column")
    top = F.when(F.col("metric").isin(*lower), F.min("value").over(w)).otherwise(F.max("value").over(w))
    return cells.withColumn("best", F.abs(F.col("value") - top) <= 1e-6 + 1e-5 * F.abs(top))


def latex(cells: DataFrame, digits: int = 3, lower: tuple[str, ...] = ("rmse",)) -> DataFrame:
    """SNK7: ``row, line``: the rows of a LaTeX table, best values bold, missing ones a dash."""
    shown = F.format_number("value", digits)
    cell = F.when(F.col("value").isNull(), "--").when(F.col("best"), F.concat(F.lit(r"\textbf{"), shown, F.lit("}"))).otherwise(shown)
    rows = best_marked(cells, lower).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", cell.alias("cell")))).alias("c"))
    return rows.select("row", F.concat_ws(" & ", F.col("row"), F.array_join(F.transform("c", lambda c: c["cell"]), " & ")).alias("line")).withColumn("line", F.concat("line", F.lit(r" \\")))


def messages(rows: DataFrame, kind: str = "batch") -> DataFrame:
    """SNK9: results as JSON messages of ``type`` and ``content``."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("content"))).alias("message"))


def parity(left: DataFrame, right: DataFrame, key: str, a: str, b: str, most: float = 1e-5) -> DataFrame:
    """SNK10: ``rows, largest, equal``: whether an exported model predicts as the one it comes from."""
    both = left.join(right, key)
    gap = F.max(F.abs(F.col(a) - F.col(b)))
    return both.agg(F.count("*").alias("rows"), gap.alias("largest"), F.coalesce(gap < most, F.lit(False)).alias("equal"))
