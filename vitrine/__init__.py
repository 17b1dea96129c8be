"""vitrine: catalogue analytics expressed as Spark DataFrame operators.

Every public operator takes a ``DataFrame`` (plus column names and
parameters) and returns a ``DataFrame``; Catalyst plans the work.

Sub-packages:

* ``functions``  column-level expressions (cell parsers, coercions, labels)
* ``operators``  DataFrame -> DataFrame operators (filters, aggregates,
  series, distributions, tags, merge, sampling, point queries, profile)
* ``sources``    CSV / JSON readers and writers, the typed ingest job
* ``plans``      fixture views over the driver tables and the registered
  queries with their SQL oracles
* ``llm``        training-data operators; optional, nothing else imports it
"""

from vitrine.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
