"""Providers that turn visual assets into Markdown: named functions over batches, whose failures stay with their rows.

A provider gets a batch of assets and gives a row for each: markdown, regions, confidence. A batch that raises, or gives another number of rows, is asked row by row, so that only the rows
that fail are lost. What comes back is checked and measured outside Python; whatever fails, and every asset without a provider, gives a placeholder with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procloom import workers
from procloom.functions import columns as C

#: States of an asset, and the tokens that its Markdown may take if nothing else is said.
REFINED, UNAVAILABLE = "REFINED", "VISUAL_REFINEMENT_UNAVAILABLE"
LIMIT = 48_000
_FOUND = "markdown string, regions array<string>, confidence double, failure string"


@dataclass(frozen=True)
class Provider:
    """refine: from a frame of assets (asset, locator, content) to one of as many rows (markdown, regions: list of texts, confidence), in order."""

    name: str
    version: str
    refine: Callable[[pd.DataFrame], pd.DataFrame]

    def __post_init__(self) -> None:
        if not self.name or not self.version or not callable(self.refine):
            raise ValueError("a provider has a name, a version and a function")


def _asked(provider: Provider, batch: pd.DataFrame) -> pd.DataFrame:
    """What the provider gives for a batch, with the failure of each row that it gives nothing for."""
    try:
        out = provider.refine(batch).reset_index(drop=True)
        if len(out) == len(batch) and {"markdown", "regions", "confidence"} <= set(out.columns):
            return out[["markdown", "regions", "confidence"]].astype(object).assign(failure=None)
        why = "the provider gave other rows than it was asked for"
    except Exception as e:  # noqa: BLE001 - whatever a provider raises stays with its rows
        why = f"{type(e).__name__}: {e}"
    if len(batch) == 1:
        return pd.DataFrame({"markdown": [None], "regions": [None], "confidence": [None], "failure": [why]}, dtype=object)
    return pd.concat([_asked(provider, batch.iloc[k : k + 1].reset_index(drop=True)) for k in range(len(batch))], ignore_index=True)


def refined(assets: DataFrame, provider: Provider | None, limit: int = LIMIT) -> DataFrame:
    """asset, chunk_id, source_sha256, status, reason, markdown, regions, confidence, tokens, provider of assets (asset, locator, content: binary or string)."""
    workers.ship(assets.sparkSession)
    rows = assets.select(F.col("asset").cast("string").alias("asset"), "locator", "content")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                told = _asked(provider, batch)
                number = pd.to_numeric(told["confidence"], errors="coerce")
                text = told["markdown"].map(lambda t: t if isinstance(t, str) else None)
                regions = told["regions"].map(lambda r: [str(x) for x in r] if isinstance(r, (list, tuple)) else None)
                yield batch[["asset", "locator"]].assign(markdown=text, regions=regions, confidence=number, failure=told["failure"])

    if provider is None:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("markdown", "string"), ("regions", "array<string>"), ("confidence", "double"), ("failure", "string"))]
        found = rows.select("asset", "locator", *none)
    else:
        found = rows.select("asset", "locator", "content").mapInPandas(ask, f"asset string, locator string, {_FOUND}")
    over = C.budget_status(C.estimate_tokens(F.col("markdown")).cast("double"), F.lit(float(limit))) == C.BUDGET_SPLIT
    sure = F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False))
    reason = F.when(F.lit(provider is None), "no provider").when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("markdown").isNull(), "no markdown")
    reason = reason.when(F.coalesce(F.size("regions"), F.lit(0)) <= 0, "no regions").when(~sure, "no valid confidence").when(over, "over budget")
    sha = F.sha2("asset", 256)
    told = found.withColumns({"reason": reason, "source_sha256": sha, "chunk_id": F.concat(F.lit("VC-"), F.substring(sha, 1, 12))})
    lost = F.col("reason").isNotNull()
    head = [F.concat(F.lit(f"{k}: "), v) for k, v in (("chunk_id", F.col("chunk_id")), ("source_sha256", F.col("source_sha256")), ("modality", F.lit("VISUAL_ASSET")), ("status", F.lit(UNAVAILABLE)))]
    holder = F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.lit(""), F.concat(F.lit(f"<!-- {UNAVAILABLE}: "), "reason", F.lit(" -->")), F.lit(""), F.concat(F.lit("[visual asset: "), F.coalesce("locator", F.lit("")), F.lit("]")))
    markdown = F.when(lost, holder).otherwise(F.col("markdown"))
    name = F.lit(f"{provider.name}@{provider.version}" if provider else None).cast("string")
    return told.select(
        "asset", "chunk_id", "source_sha256", F.when(lost, UNAVAILABLE).otherwise(REFINED).alias("status"), "reason", markdown.alias("markdown"), F.when(lost, F.array().cast("array<string>")).otherwise(F.col("regions")).alias("regions"),
        F.when(lost, 0.0).otherwise(F.col("confidence")).alias("confidence"), C.estimate_tokens(markdown).alias("tokens"), name.alias("provider"),
    )
