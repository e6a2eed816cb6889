"""DEC-03 / DEC-04 / WIN-02 / WIN-03 / SRT-03: confidence narrative and
decline reasons, computed per row with higher-order array functions.

Each row carries its own 14 attribution terms, so the running sum is a
per-row ``aggregate`` over a sorted array: no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kreditflow.functions.numeric import computed_once, given, pround, pround_sql, text

from kreditflow import constants as K
from kreditflow.functions.text import note_sql


def to_pct(logit: Column) -> Column:
    """Sigmoid clamped to [0, 1], as a percentage (SCL-18)."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)) * F.lit(100.0)


def sorted_terms(attr: Column) -> Column:
    """SRT-03: terms by |shap| descending, ties in model feature order, each with its note.

    ``attr`` holds one term per model feature in model order, so each feature's
    note is a static expression; the sort needs no comparator.
    """
    terms = []
    for i, f in enumerate(K.ALL_FEATURES):
        shap, value = f"get(a, {i}).shap", f"get(a, {i}).value"
        terms.append(f"named_struct('order', -abs({shap}), 'idx', {i}, 'feature', {text(f)}, 'shap', {shap}, 'value', {value}, 'note', {note_sql(f, shap, value)})")
    return given(attr, f"a -> sort_array(array({', '.join(terms)}))")


#: Running log-odds after 0, 1, ... terms of ``s.t``, as percentages; then a struct for each term.
_STEPS = f"""s -> get(transform(array(transform(
  aggregate(s.t, array(s.b), (acc, x) -> concat(acc, array(element_at(acc, -1) + x.shap))),
  l -> least(1D, greatest(0D, 1D / (1D + exp(-l)))) * 100D)),
  pct -> transform(s.t, (x, i) -> named_struct(
    'step', i + 1,
    'feature', x.feature,
    'shap', {pround_sql('x.shap', 4)},
    'impact_pct', {pround_sql('get(pct, i + 1) - get(pct, i)', 2)},
    'running_prob', {pround_sql('get(pct, i + 1)', 2)},
    'direction', CASE WHEN x.shap > 0 THEN 'positive' WHEN x.shap < 0 THEN 'negative' ELSE 'neutral' END,
    'note', x.note,
    'value', {pround_sql('x.value', 4)}))), 0)"""


def narrative(attr: Column, base_logit: Column) -> Column:
    """WIN-02: running log-odds over the sorted terms, one struct per step:
    ``step, feature, shap, impact_pct, running_prob, direction, note, value``.

    Only the running log-odds are folded; the sorted terms and the fold are
    each bound once, so their expressions appear once in the plan.
    """
    return given(F.struct(sorted_terms(attr).alias("t"), base_logit.cast("double").alias("b")), _STEPS)


def add_narrative(df: DataFrame, attr_col: str, base_logit: Column, out_col: str = "narrative", when: Column | None = None) -> DataFrame:
    """Adds the narrative, computed once for what reads it."""
    told = narrative(F.col(attr_col), base_logit)
    return df.withColumn(out_col, computed_once(F.when(when, told) if when is not None else told))


def final_confidence(attr: Column, base_logit: Column) -> Column:
    """Final narrative confidence (raw log-odds, not the calibrated score)."""
    return pround(to_pct(F.aggregate(attr, base_logit, lambda acc, x: acc + x["shap"])), 2)


_REASONS = f"""t -> slice(concat(slice(transform(filter(t, s -> s.shap < 0), s -> s.note), 1, 3),
  array_repeat({text(K.DEFAULT_DECLINE_REASON)}, 3)), 1, 3)"""


def decline_reasons(attr: Column) -> Column:
    """DEC-04 / WIN-03: first three negative notes, padded with the default; only the sorted terms are needed."""
    return given(sorted_terms(attr), _REASONS)
