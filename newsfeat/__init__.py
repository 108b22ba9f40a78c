"""newsfeat: Spark-native toolkit for article-popularity analytics.

Every operator is a function ``DataFrame -> DataFrame`` (or a small family of
them) keyed by the article id, never by row position.  Sub-packages:

* ``sources``    - table readers, the ``articles`` fixture, CSV scan and sinks
* ``functions``  - column expressions (text cleaning, calendar, regex flags,
                   the stemmer) and the fixed value tables
* ``operators``  - rule fills, features, temporal counts, text mining,
                   evaluation, blending, chart data, topics, models
* ``plans``      - end-to-end pipelines and the registered query catalogue

"""

__version__ = "0.1.0"
