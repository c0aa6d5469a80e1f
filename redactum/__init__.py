"""redactum: personal-data redaction of document collections as Spark jobs.

Every public operator is a function from DataFrame(s) to DataFrame. Nothing is
collected to the driver; per-document work runs inside partitions keyed by
``doc_id`` and cross-document work (names, rosters, cases) runs as joins and
aggregations.
"""

__version__ = "0.1.0"
