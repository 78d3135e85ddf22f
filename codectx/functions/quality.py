"""How good a completion is."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codectx.functions.text import identifier_set, strip, text

#: Weights of exact match, edit similarity and identifier F1 in the composite; of similarity and recall in the proxy's quality; of a context hit. Fixed values.
COMPOSITE, PROXY, HIT = (0.30, 0.35, 0.35), (0.65, 0.35), 0.1


def exact_match(predicted: Column, target: Column) -> Column:
    return (strip(predicted) == strip(target)).cast("double")


@F.pandas_udf(T.DoubleType())
def matched_ratio(predicted: pd.Series, target: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which isn't symmetric and has no built-in."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(predicted, target)], dtype="float64")


def edit_similarity(predicted: Column, target: Column) -> Column:
    """1 for equal texts, 0 for an empty target, else the matched ratio; only the rest reaches Python."""
    p, t = text(predicted), text(target)
    return F.when(p == t, 1.0).when(t == "", 0.0).otherwise(matched_ratio(F.when((p != t) & (t != ""), p), t))


def identifier_scores(predicted: Column, target: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of identifier sets; zeros if either is empty."""
    p, t = identifier_set(predicted), identifier_set(target)
    both = F.size(F.array_intersect(p, t)).cast("double")
    empty = (F.size(p) == 0) | (F.size(t) == 0)
    precision = F.when(empty, 0.0).otherwise(F.try_divide(both, F.size(p)))
    recall = F.when(empty, 0.0).otherwise(F.try_divide(both, F.size(t)))
    return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def composite(predicted: Column, target: Column, weights: tuple[float, float, float] = COMPOSITE) -> Column:
    return weights[0] * exact_match(predicted, target) + weights[1] * edit_similarity(predicted, target) + weights[2] * identifier_scores(predicted, target)[2]


def composite_with_context(predicted: Column, target: Column, symbols: Column) -> Column:
    """The composite, 0.1 more if the context's symbols hit the target's identifiers, 1 at most."""
    hit = F.arrays_overlap(symbols, identifier_set(target))
    return F.least(F.lit(1.0), composite(predicted, target) + F.when(hit, HIT).otherwise(0.0))


def proxy_quality(predicted: Column, target: Column, symbols: Column) -> Column:
    """Similarity and identifier recall, 0.1 more for a context hit, not capped."""
    p, t = text(predicted), text(target)
    ratio = F.when(p == t, 1.0).otherwise(matched_ratio(p, t))
    return PROXY[0] * ratio + PROXY[1] * identifier_scores(p, t)[1] + F.when(F.arrays_overlap(symbols, identifier_set(t)), HIT).otherwise(0.0)
