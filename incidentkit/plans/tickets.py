"""Ticket flows: cleaning and extraction, hidden tickets, classification input, monthly forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from incidentkit.functions import text as T
from incidentkit.operators import arima, features, windows
from incidentkit.operators.aggregates import error_metrics
from incidentkit.operators.joins import first_claim, match_templates, open_backlog
from incidentkit.operators.similarity import score_pairs
from incidentkit.session import checkpoint


def clean_requests(tickets: DataFrame, request: str = "request", tilde: bool = True) -> DataFrame:
    """Control characters and the entry header out of the request text."""
    return tickets.withColumn(request, T.strip_entry_header(T.clean_controls(F.col(request), tilde)))


def describe_tickets(
    tickets: DataFrame,
    templates: DataFrame,
    keys: Sequence[str] = ("kind", "category"),
    patterns: Sequence[str] = T.REQUEST_PATTERNS,
    group: int = 1,
) -> DataFrame:
    """Add ``description`` (template capture) and ``description_rest`` (what the pattern list leaves).

    The pattern list starts from the capture where there is one, else from the request.
    """
    matched = match_templates(clean_requests(tickets), templates, keys)
    start = F.coalesce("description", "request")
    return matched.withColumn(
        "description_rest", T.ascii_fold(T.extract_cascade(start, patterns, group))
    )


def embed(
    df: DataFrame,
    key: str,
    text: str,
    vectors: DataFrame,
    size: int,
    out: str,
    stopwords: Sequence[str] = (),
    replacements: Mapping[str, str] | None = None,
) -> DataFrame:
    """(key, out): mean word vector of the normalised text."""
    tokens = T.normalize(F.coalesce(F.col(text), F.lit("")), stopwords, replacements)
    return features.mean_embedding(df, key, tokens, vectors, size, out=out)


def link_candidates(
    problems: DataFrame,
    tickets: DataFrame,
    short_vectors: DataFrame,
    request_vectors: DataFrame,
    short_size: int,
    request_size: int,
    threshold: float = 0.75,
    stopwords: Sequence[str] = (),
    replacements: Mapping[str, str] | None = None,
) -> DataFrame:
    """Unlinked tickets claimed by the first problem, or linked ticket, they resemble.

    ``problems``: problem_id, row_no, short_text, request. ``tickets``:
    incident_id, row_no, problem_id (null = unlinked), short_text, request.
    Problems claim first; a ticket claimed there is not offered to linked tickets.
    """

    def embedded(df: DataFrame, key: str) -> DataFrame:
        s = embed(df, key, "short_text", short_vectors, short_size, "short_vector", stopwords, replacements)
        r = embed(df, key, "request", request_vectors, request_size, "request_vector", stopwords, replacements)
        # Both similarity joins read the vectors several times; the texts are normalised once.
        return checkpoint(df.drop("short_text", "request").join(s, key).join(r, key))

    with_vectors = embedded(tickets, "incident_id")
    free = with_vectors.where(F.col("problem_id").isNull()).drop("problem_id", "row_no")
    linked = with_vectors.where(F.col("problem_id").isNotNull()).withColumnRenamed("incident_id", "linked_id")

    known = embedded(problems, "problem_id")
    first = checkpoint(
        score_pairs(known, free, "problem_id", "incident_id", threshold=threshold, first="row_no")
        .join(problems.select("problem_id", "row_no"), "problem_id")
        .select("problem_id", F.col("problem_id").alias("level2"), "incident_id", "score_short", "score_request", "row_no", F.lit(1).alias("phase"))
    )
    open_tickets = checkpoint(free.join(first.select("incident_id").distinct(), "incident_id", "left_anti"))
    second = (
        score_pairs(linked, open_tickets, "linked_id", "incident_id", threshold=threshold, first="row_no")
        .join(linked.select("linked_id", "problem_id", "row_no"), "linked_id")
        .select("problem_id", F.col("linked_id").alias("level2"), "incident_id", "score_short", "score_request", "row_no", F.lit(2).alias("phase"))
    )
    return first_claim(first.unionByName(second), "incident_id", ["row_no", "level2"], "phase")


def match_report(claims: DataFrame, problems: DataFrame, tickets: DataFrame) -> DataFrame:
    """Claims with the texts of both sides, in the 16 columns of the report."""
    p = problems.select("problem_id", F.col("short_text").alias("problem_short"), F.col("request").alias("problem_request"))
    t = tickets.select("incident_id", F.col("short_text").alias("incident_short"), F.col("request").alias("incident_request"), "link_kind")
    clean = lambda c: F.array_join(T.normalize(F.coalesce(F.col(c), F.lit(""))), " ")
    return claims.join(p, "problem_id").join(t, "incident_id").select(
        "problem_id", "problem_short", "problem_request", "incident_id", "incident_short", "incident_request",
        "score_short", "score_request", "link_kind",
        F.col("problem_id").alias("level1"), F.col("level2"), F.col("incident_id").alias("level3"),
        clean("problem_short").alias("problem_short_clean"),
        clean("problem_request").alias("problem_request_clean"),
        clean("incident_short").alias("incident_short_clean"),
        clean("incident_request").alias("incident_request_clean"),
    )


def backlog_series(
    tickets: DataFrame, opened: str, closed: str, first: int, last: int, kind: str | None = None
) -> DataFrame:
    """Open tickets per month as a series table, one series per kind."""
    counted = open_backlog(tickets, opened, closed, first, last, [kind] if kind else [])
    series = F.col(kind) if kind else F.lit("all")
    return counted.select(
        series.alias("series_id"),
        F.to_date(F.col("month").cast("string"), "yyyyMM").alias("ts"),
        F.col("open").cast("double").alias("y"),
    )


def monthly_forecast(
    series: DataFrame, orders: Sequence[arima.Order], n: int = 12, band: float = 0.15
) -> DataFrame:
    """Last n months of every series forecast by every order, bias-corrected, side by side with the actual value.

    The bias of an order is the mean residual of the first half of the months;
    the corrected forecast is judged on the other half (``calibration`` says which).
    """
    walked = arima.walk_forward_orders(series, orders, n)
    keys = ["series_id", "order"]
    rank = F.row_number().over(windows.along(keys, "ts"))
    marked = walked.withColumn("calibration", rank <= n // 2)
    corrected = arima.bias_correct(marked, F.col("calibration"), keys)
    return corrected.withColumn(
        "within_band", F.abs(F.col("yhat_corrected") - F.col("y")) <= band * F.abs("y")
    )


def forecast_scores(forecasts: DataFrame) -> DataFrame:
    judged = forecasts.where(~F.col("calibration"))
    return error_metrics(judged, "y", "yhat_corrected", ["series_id", "order"])
