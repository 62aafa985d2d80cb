"""Longitudinal cohort analytics on Spark DataFrames.

Irregular per-patient measurements become labelled, fixed-length history
windows, aligned with other sources, balanced, scaled and scored. Every
operator takes and returns DataFrames keyed by ``(patient_id, observation_date)``.
"""

from onsetframe.session import tune

__all__ = ["tune"]
