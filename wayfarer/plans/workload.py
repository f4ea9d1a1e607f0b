"""Workload parameters of the registered queries (shared by Spark and SQL)."""

from __future__ import annotations

import datetime as dt

# Class analyses (divergence, class patterns): the pattern miner's own defaults
# (min_freq 3, length 3) and the demo's top 15.
CLASS_MIN_FREQ, CLASS_MIN_LEN, DIVERGENCE_TOP = 3, 3, 15
# All-journey pattern report and importance: the importance defaults.
ALL_MIN_FREQ, ALL_MIN_LEN = 10, 3
# Report sizes: importance top 30, review top 10, topics of at least 50.
IMPORTANCE_TOP, REVIEW_TOP, MIN_TOPIC_SIZE = 30, 10, 50
# Export window: the last day of the data and the 7 days before it.
EXPORT_AS_OF, EXPORT_DAYS = dt.date(2024, 1, 30), 7
# Wide attribution columns: every medium of the test data, and the rest.
MEDIUM_COLUMNS = ["(not set)", "medium_direct_none", "medium_direct_not_set", "medium_google_cpc",
                  "medium_newsletter_email"]
