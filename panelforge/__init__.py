"""Social-panel analytics on Spark: self-disclosure labels, post vectors, prediction scoring, API-response tables."""
