"""kreditflow: credit-decision analytics as Spark DataFrame, SQL, MLlib and
Structured Streaming jobs.

Layout
------
``sources``    table readers, the derived loan table, the versioned decision log
``functions``  column expressions (features, offers, distance, validation, texts)
``operators``  DataFrame operators (profiling, evaluation, sampling, decisions,
               budget, narrative, monitoring)
``plans``      MLlib model fitting, calibration and tree attribution
``streaming``  Structured Streaming forms of the decision and budget jobs
"""

__version__ = "0.1.0"
