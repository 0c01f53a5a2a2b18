"""veracta: record-quality analytics, written for Spark first."""
