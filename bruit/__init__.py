"""Event analytics over short geo-tagged messages, as Spark DataFrame functions."""
