"""kwhlens — tariff-impact analytics on Spark.

Hourly meter readings and tariff contracts in, period statistics, cohort risk
sets, nearest-neighbour matches, balance checks and treatment-effect estimates
out.  Every public function takes and returns DataFrames and runs no action;
the caller decides when to write or collect.
"""

from kwhlens.session import get_session, checkpoint_dir, materialize  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "materialize"]
