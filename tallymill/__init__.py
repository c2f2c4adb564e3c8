"""tallymill: Spark-native operators for auditing record-triage data."""
