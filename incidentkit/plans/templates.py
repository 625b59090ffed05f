"""From an answer-template export to a table of patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from incidentkit.functions import text as T
from incidentkit.operators.rows import any_contains, unpivot_variants


def prepare_templates(
    df: DataFrame, ids: Sequence[str], variants: Sequence[str], word: str = T.DESCRIPTION_WORD
) -> DataFrame:
    """Templates that mention a description: (ids, request, lines, regex, template_id).

    The id is a digest of the row, so it does not depend on row order.
    """
    rows = unpivot_variants(any_contains(df, variants, word), ids, variants, "request")
    request = F.replace(F.col("request"), F.lit("Ja/Nee"))
    return rows.withColumns(
        {
            "request": request,
            "lines": F.size(T.template_lines(F.regexp_replace(F.col("request"), r"(\r\n|\n|\r)\z", ""))),
            "regex": T.template_to_regex(F.col("request")),
            "template_id": F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ids], "request")),
        }
    )
