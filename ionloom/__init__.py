"""ionloom: interval queries, scoring and data preparation for mass-spectrometry tables on Spark."""
