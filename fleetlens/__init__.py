"""fleetlens: DataFrame operators for fleets of recorded network experiments.

Specs become task, parameter and expected-artifact tables; collected files are
reconciled against what was expected; lifecycle event logs are checked for
illegal or late transitions; timelines, failure roll-ups and periodic
statistics are computed in batch and with Structured Streaming.  Everything is
expressed with Spark's own expressions, joins, aggregates, windows and state.
"""

from fleetlens.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
